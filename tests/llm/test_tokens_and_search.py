"""Token counts, token alignment and lexical search against plain versions and the libraries."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from fathomgrid.llm import lexical_search, token_alignment, token_counts  # noqa: E402
from fathomgrid.llm.queries import tokenizer  # noqa: E402

AWKWARD = ["", " ", "  ", "   a  b ", " a", "a ", "a▁b", "▁", "▁▁x", "<s> hi </s> <unk>", "<0x0A>", "\n\ta\xa0b", "\x00", "a\x00 b", "Å ﬁ 漢字 🙂",
           "　x y", "é", "x" * 5000, "the " * 3000, "<|endoftext|>", "a <|endoftext|> b", "  \n  ", "日本語" * 800, "﻿bom", " ▁ "]


@pytest.fixture(scope="module")
def texts(small):
    rng = random.Random(3)
    letters = ["a", "e", "th", " ", "  ", "▁", "\n", "é", "漢", "🙂", "<s>", "<0x41>", "\x1f", "\xa0", "ing", "Qz"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    return [None, *AWKWARD, *made, *[t for _, t in small]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids repeat, one is null, and extra columns have names that the operators use themselves."""
    rows = [(None if i == 7 else i // 2 * 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(7) for c in ("id", "t", "a", "b", "row", "pair", "n", "score", "item", "rank", "name", "salt", "count", "best")})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def test_token_counts(spark, docs, nothing, pieces, monkeypatch):
    model = token_counts.load(spark, tokenizer("piece_bpe_32k.model"))
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        got = sorted(token_counts.count(docs, model, limit=100).collect(), key=repr)
        want = [(r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
        assert [tuple(r) for r in got] == sorted(((*w, w[2] > 100) for w in want), key=repr)
    assert token_counts.count(nothing, model).count() == 0


def test_every_proven_piece_is_one_token(pieces):
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    alone = token_counts.prove(model)
    assert len(alone) > 10_000
    for part in sorted(alone):
        assert len(pieces.encode(part + " z")) == 2


def test_unproven_models_are_left_to_the_library(pieces):
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        counter = token_counts.Counter(f.read(), None)
    assert [counter.count(t) for t in AWKWARD] == [len(pieces.encode(t)) for t in AWKWARD]


def aligned(texts, byte_level, pieces):
    """Plain alignment, range by range."""
    letters = token_alignment.byte_alphabet()
    rows = []
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a = byte_level.encode(" " + (text or ""), add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        right = [(i, bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
                 for i in pieces.encode(text or "") for p in [pieces.id_to_piece(i)]]
        if not text or b"".join(t for _, t in left) != spaced or b"".join(t for _, t in right) != spaced:
            left, right = [], []
        ranges = []
        for side in (left, right):
            at, found = 0, []
            for i, t in side:
                found.append((i, at, at + len(t)))
                at += len(t)
            ranges.append(found)
        links, first = [], 0
        for i, start, end in ranges[0]:
            while first < len(ranges[1]) and ranges[1][first][2] <= start:
                first += 1
            j = first
            while j < len(ranges[1]) and ranges[1][j][1] < end:
                links.append((i, ranges[1][j][0]))
                j += 1
        ends = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, x, y = [], 0, 0
        for end in ends:
            parts = []
            for side, at in ((0, x), (1, y)):
                j = at
                while j < len(ranges[side]) and ranges[side][j][2] <= end:
                    j += 1
                parts.append(",".join(str(r[0]) for r in ranges[side][at:j]))
                x, y = (j, y) if side == 0 else (x, j)
            groups.append("|".join(parts))
        rows.append((len(left), len(right), groups, links))
    held = {}
    for *_, links in rows:
        for link in set(links):
            held[link] = held.get(link, 0) + 1
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(a, b, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), ";".join(groups) or None)
            for a, b, groups, links in rows]


@pytest.mark.parametrize("bound", [1 << 20, 300, 0])
def test_token_alignment(spark, docs, pieces, bound, monkeypatch):
    """All pairs in the broadcast table, some of them, none of them."""
    if bound < 1000:
        monkeypatch.setattr(token_alignment, "HELD_PAIRS", 50)
        monkeypatch.setattr(token_alignment, "REMEMBERED_CHARS", 5000)
        monkeypatch.setattr(token_alignment, "CHUNK", 20)
    byte_level = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, aligned([r.text for r in rows], byte_level, pieces), strict=True)]
    vocabularies = token_alignment.load(spark, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    got = token_alignment.align(docs, vocabularies, broadcast_pairs=bound).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 500 and sum(w[1] == 0 for w in want) > 100


def test_alignment_of_neighbours(pieces):
    """Texts that end and begin with white space keep their own tokens next to one another in a task."""
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer("piece_bpe_32k.model"), "rb") as g:
        vocabularies = token_alignment.Vocabularies(f.read(), g.read())
    byte_level = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    edges = ["", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\u1680", "\u200b", "\ufeff"]
    for texts in [[f"foo{a}", f"{b}bar"] for a in edges for b in edges] + [["one", "  ", "two"], ["\n", "\n", " ", " "]]:
        aligner = token_alignment.Aligner(vocabularies)
        row, number = aligner.read(texts)
        got = [";".join(aligner.written[n] for n, r in zip(number, row, strict=True) if r == i) for i in range(len(texts))]
        n_groups = aligner.totals(aligner.counts[2], row, number, len(texts)).tolist()
        want = aligned(texts, byte_level, pieces)
        assert got == [w[-1] for w in want] and n_groups == [w[2] for w in want], texts


def test_alignment_of_nothing(spark, nothing):
    vocabularies = token_alignment.load(spark, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    assert token_alignment.align(nothing, vocabularies).count() == 0


def test_pointer_jumping_on_a_long_chain():
    """Ends that never meet until the last: one group over 10,000 tokens."""
    a, b = np.append(np.arange(2, 20_000, 2), 20_001), np.append(np.arange(1, 20_000, 2), 20_001)
    left, right = token_alignment.terminals(a, b)
    assert (left == len(b) - 1).all() and (right == len(b) - 1).all()
    left, right = token_alignment.terminals(np.array([1, 2, 5]), np.array([1, 3, 5]))
    assert left.tolist() == [0, 2, 2] and right.tolist() == [0, 2, 2]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=50):
    read = [(doc, TERM.findall((text or "").translate(LOWER))) for doc, text in docs]
    n, length = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    df = {}
    for _, words in read:
        for term in set(words):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        wanted = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for doc, words in read:
            m = 50 + 50 * len(words) * n // length if length else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * words.count(t) // (1000 * words.count(t) + 20 * m)) for t in wanted if t in df and t in words)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize(("postings", "per_scan", "k"), [(1 << 20, 4096, 50), (40, 3, 50), (1000, 7, 3)])
def test_lexical_search(spark, docs, nothing, monkeypatch, postings, per_scan, k):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "ITEMS", per_scan)
    monkeypatch.setattr(lexical_search, "CHUNK", 50)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    picked = [t for _, t in rows if t and 30 < len(t) < 400][::97]
    items = [(i // 2, t) for i, t in enumerate([None, "", "...", "THE the É", "nowhere to be found zzzqqq", *picked])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("name", "item", "t", "score", "rank")})
    got = lexical_search.search(docs, table, k=k).collect()
    want = ranked(rows, items, k)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 50
    assert lexical_search.search(nothing, table).count() == 0 and lexical_search.search(docs, table.limit(0)).count() == 0


def test_nra_stops_before_the_end_of_long_lists():
    """A document far above the rest is final as soon as no other can reach it; ties with the last place stay."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 8))
        table = rng.integers(0, 5, (n, terms)) * rng.integers(0, 2, (n, terms)) * 1000
        lists = []
        for t in range(terms):
            doc = np.flatnonzero(table[:, t])
            order = np.argsort(-table[doc, t], kind="stable")
            lists.append((doc[order], -table[doc[order], t]))
        best = rng.integers(1, 15_000, int(rng.integers(0, 10)))
        docs, scores = lexical_search.nra(lists, k, best)
        total = table.sum(axis=1)
        assert (total[docs] == scores).all()
        every = np.sort(np.concatenate([total[total > 0], best]))[::-1]
        least = every[k - 1] if len(every) >= k else 1
        assert set(np.flatnonzero((total >= least) & (total > 0))) <= set(docs.tolist())


def test_digest_columns(spark):
    import __spark_entry__ as entry
    out = entry.queries()["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.filter("(n_a = 0) <> (groups_sha256 = '')").count() == 0
    assert len(hashlib.sha256(b"").hexdigest()) == out.filter("n_a > 0").selectExpr("max(length(groups_sha256))").first()[0]


def test_alignment_remembers_what_is_used(monkeypatch):
    """What a task remembers is bounded; beyond that the stretches used least go first, and results stay the same."""
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer("piece_bpe_32k.model"), "rb") as g:
        vocabularies = token_alignment.Vocabularies(f.read(), g.read())
    assert token_alignment.REMEMBERED_CHARS <= 1 << 22
    rng = random.Random(5)
    texts = [" ".join(["often", "used", *(f"rare{rng.randrange(10 ** 9)}" for _ in range(20))] * 2) for _ in range(60)]

    def read(bound):
        monkeypatch.setattr(token_alignment, "REMEMBERED_CHARS", bound)
        aligner, out = token_alignment.Aligner(vocabularies), []
        for text in texts:
            before = aligner.chars
            row, number = aligner.read([text, "often used"])
            assert before <= bound or aligner.chars < before
            links = aligner.links(row, number)
            out.append(([aligner.written[n] for n in number], *[x.tolist() for x in links],
                        [aligner.totals(c, row, number, 2).tolist() for c in aligner.counts]))
        return aligner, out

    _, want = read(1 << 30)
    aligner, got = read(5000)
    assert got == want
    aligner._forget()
    assert aligner.chars <= 2500 and {"often", "used"} <= set(aligner.numbers) and len(aligner.numbers) == len(aligner.written) == len(aligner.first) - 1
