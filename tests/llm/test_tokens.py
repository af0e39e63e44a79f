"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from fathomgrid.llm import bpe, rans  # noqa: E402
from fathomgrid.llm.queries import tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def words():
    return tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    return tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_streams_of_long_words(words, monkeypatch):
    """Words far longer than a window, in chunks of the smallest window that the lookahead allows."""
    codec = bpe.Codec(tokenizer("word_bpe_49k.json"))
    encoder = bpe.Encoder(codec)
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (300, 2000, 5000) for letters in ("ab", "aeinrst", "hahaeroni", "!?.", "éü漢")]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == words.encode(text, add_special_tokens=False).ids


def test_lookahead_of_a_worked_list():
    # c = ab waits for what follows b; d = bb outranks it and so must be seen
    assert bpe.lookahead([(1, 1, 3), (0, 1, 2)], {0: 1, 1: 1, 2: 2, 3: 2}) == 2


def test_round_trip(spark, odd, small, words):
    codec = bpe.load(spark, tokenizer("word_bpe_49k.json"))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10**6, t) for i, t in small], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs, codec).collect():
        ids = words.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark, odd, nothing, words):
    codec = bpe.load(spark, tokenizer("word_bpe_49k.json"))
    decoded = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(odd, codec), codec).collect()}
    for r in odd.collect():
        assert decoded[r.doc_id] == words.decode(words.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(nothing, codec).count() == 0


def test_decoding_splits_characters_over_tokens(pieces):
    codec = bpe.Codec(tokenizer("byte_bpe_50k.json"))
    decoder = bpe.Decoder(codec)
    decoder.STEP = 1
    ids = pieces.encode("é漢🙂 a\U0001F9D1", add_special_tokens=False).ids
    assert "".join(decoder.stream(np.array(ids, np.uint32))) == "é漢🙂 a\U0001F9D1"
    assert "".join(decoder.stream(np.array(ids[:-1], np.uint32))) == pieces.decode(ids[:-1], skip_special_tokens=False)


def test_token_files(spark, odd, small, nothing, pieces, monkeypatch):
    docs = odd.select("doc_id", "text").distinct().unionByName(spark.createDataFrame([(i + 10**6, t) for i, t in small], "doc_id long, text string"))
    at, want = 0, {}
    for doc, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = [*pieces.encode(text, add_special_tokens=False).ids, 0]
        want[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = rans.through_files(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got} == want and len(got) == len(want)
    assert rans.through_files(nothing, tokenizer("byte_bpe_50k.json")).count() == 0


def test_parts_of_any_text(pieces, monkeypatch):
    """All kinds of white space, words that agree in polynomial hashes, long words, and memory that is full."""
    rng = random.Random(7)
    morse = [bin(i).count("1") & 1 for i in range(1024)]
    twins = ["".join("ab"[x] for x in morse), "".join("ba"[x] for x in morse)]
    letters = ["a", "b", "th", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000",
               "é", "漢", "🙂", "'s", "'", ".", "12", "<|endoftext|>", "\x00", "\ufeff", "\u200b", "abcdefghijklmnopq", "\x00\x00"]
    texts = ["\n\xa0\n", "Hello.\n\xa0\nWorld", "\xa0 x", "'\xa0'", " ".join(twins), *twins, "", "\n", "a\x00", "a\x00\x00", "a"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    want = [x.ids for x in pieces.encode_batch(texts, add_special_tokens=False)]
    for bound in (1_500_000, 300):
        monkeypatch.setattr(rans, "REMEMBERED", bound)
        tokens = rans.Tokens(pieces.to_str())
        got = []
        for start in range(0, len(texts), 97):
            raw = [t.encode() for t in texts[start:start + 97]]
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            got += [x.tolist() for x in tokens.encode(np.frombuffer(b"".join(raw), np.uint8), cuts)]
        assert got == want


def test_known_parts_are_found_without_sorting(pieces, monkeypatch):
    """Slots that collide and grow give the library's ids, and what is known is looked up, not sorted again."""
    monkeypatch.setattr(rans, "SLOTS", 2, raising=False)
    tokens = rans.Tokens(pieces.to_str())
    tokens._forget()
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(300)]
    want = [x.ids for x in pieces.encode_batch(texts, add_special_tokens=False)]
    sorted_, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **b: sorted_.append(len(x)) or unique(x, *a, **b))
    for again in (False, True):
        sorted_.clear()
        for start in range(0, len(texts), 50):
            raw = [t.encode() for t in texts[start:start + 50]]
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            assert [x.tolist() for x in tokens.encode(np.frombuffer(b"".join(raw), np.uint8), cuts)] == want[start:start + 50]
        assert not again or max(sorted_, default=0) < 100
    tokens._forget()


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000])
def test_blocks(n, monkeypatch):
    monkeypatch.setattr(rans, "CHECKPOINT", 7)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint32)
    counts = np.bincount(ids, minlength=5001)
    freq = rans.scaled(counts)
    assert freq.sum() in (0, 1 << rans.SCALE_BITS) and ((freq > 0) == (counts > 0)).all()
    block = rans.encode_block(ids, freq, rans._starts(freq))
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    parts = [rans.decode_part(block, m, freq, rans._starts(freq), symbol) for m in reversed(range(len(block["states"])))]  # in any order
    assert np.array_equal(np.concatenate([p for p in reversed(parts)]) if parts else ids, ids)
    if n > 100_000:
        assert len(block["payload"]) * 8 / n < 1.02 * -(counts[counts > 0] / n * np.log2(counts[counts > 0] / n)).sum() + 0.1


def test_rare_counts_keep_a_share():
    counts = np.array([10**12, 1, 0, 1, 5])
    freq = rans.scaled(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and freq.tolist()[2] == 0 and (freq[[1, 3, 4]] > 0).all()
