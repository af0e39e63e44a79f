"""Alignment of two tokenizers' tokens over the same texts (operator 11).

Both token rows of a text spell the same bytes. Seen as byte ranges, two tokens of different rows are linked where their
ranges overlap, and the connected components of that graph are the smallest groups of tokens that spell the same bytes in
both rows. Components come from pointer jumping over many texts at once: every token points to the farthest-right token that
overlaps it (the right-hand row's token where both end together, which points to itself), and
`successor = successor[successor]` doubles the step until nothing changes; each token then knows its group's last token.

* A space between two other characters that are surely no white space begins a token in both rows and no token reaches over
  it, if the left tokenizer's words start there (byte-level pre-tokenizer, no normaliser) and the right model's pieces hold
  no space behind another character (`token_counts.prove`). Texts are cut there, and each distinct stretch is tokenised and
  aligned once a task, as long as what a task remembers stays below `REMEMBERED_CHARS`; beyond it the stretches used least are
  forgotten and aligned anew where they come again. Other tokenizers get whole texts.
* `groups` reads every text once: its counts, its groups and its distinct linked pairs of ids, which `align` stores.
* `pair_counts` counts in how many documents each pair is linked, summed inside each task before the shuffle.
* `align` adds what each document's links count. The pairs of most documents (at most `BROADCAST_PAIRS`,
  a fixed bound) are looked up in a broadcast table; the others, each in few documents, are joined by pair and summed by row.

A text has no tokens (all zeros, no groups) if it is null or empty or if either row doesn't spell space + text, such as
texts that hold the mark the piece model uses for a space. Strings of special tokens are plain text. Every row counts as a
document of its own, repeated rows and null ids too. Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import token_counts
from fathomgrid.llm.frames import Shared, arrow, column, stored, text_runs

BROADCAST_PAIRS = 1 << 20
HELD_PAIRS = 1 << 20
REMEMBERED_CHARS = 1 << 22
#: rows of results whose groups are long: the writer holds less of them at a time
GROUP_BYTES = 1 << 24
CHUNK = 1 << 20
TOGETHER = 500
ROWS = 500

#: characters that some engine takes for white space, and the piece model's own space
_DOUBTFUL = r"\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff\u2581"
_CUT = re.compile(f"(?<=[^{_DOUBTFUL}]) (?=[^{_DOUBTFUL}])")
_NEVER = re.compile("(?!)")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as letters from 256 on."""
    own = {b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


class Vocabularies:
    """Both tokenizers' files and the bytes of every id; travels to the workers."""

    def __init__(self, byte_level: str, pieces: bytes):
        self.files = byte_level, pieces
        spec = json.loads(byte_level)
        words = spec.get("pre_tokenizer") or {}
        self.cuts = (words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
                     and not spec.get("normalizer") and token_counts.prove(pieces) is not None)
        left, right = self._open()
        letters = byte_alphabet()
        vocabulary = left.get_vocab(with_added_tokens=True)
        added = {t.content for t in left.get_added_tokens_decoder().values()}
        self.left = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.left[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.right = [_piece_bytes(right.id_to_piece(i), right.is_byte(i)) for i in range(right.get_piece_size())]
        self.sizes = tuple(np.array([len(t) for t in side], np.int64) for side in (self.left, self.right))
        self.pair = "int" if len(self.left) * len(self.right) < 1 << 31 else "long"

    def _open(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        left = Tokenizer.from_str(self.files[0])
        left.encode_special_tokens = True
        left.no_truncation()
        left.no_padding()
        return left, SentencePieceProcessor(model_proto=self.files[1])

    def _together(self, stretches: list[str]) -> Iterator[tuple[int, int]]:
        """Runs of stretches that are tokenised as one text: each border in a run is one at which a text would be cut.
        Stretches at the edge of a text may end or begin with white space, which would merge with their neighbour's."""
        start = 0
        for i in range(1, len(stretches) + 1):
            if i == len(stretches) or i - start == TOGETHER or not self.cuts or not _CUT.match(f"{stretches[i - 1][-1:]} {stretches[i][:1]}", 1):
                yield start, i
                start = i

    def encoder(self):
        """A function from stretches to the ids of both rows of space + stretch for all of them, behind one another, and
        whether each is spelt in full (those that aren't have no ids)."""
        left, right = self._open()

        def rows(texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
            spaced = [" " + t for t in texts]
            for text, a, b in zip(spaced, left.encode_batch_fast(spaced, add_special_tokens=False), right.encode(texts, num_threads=1), strict=True):
                raw = text.encode()
                whole = b"".join(map(self.left.__getitem__, a.ids)) == raw and b"".join(map(self.right.__getitem__, b)) == raw
                yield (a.ids, b) if whole else None

        def encode(stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, spelt = ([], []), np.ones(len(stretches), bool)
            for start, end in self._together(stretches):
                part = stretches[start:end]
                found = list(rows([" ".join(part)]))
                if found[0] is None and len(part) > 1:
                    found = list(rows(part))
                for i, row in enumerate(found):
                    if row is None:
                        spelt[start + i] = False
                    else:
                        for side, new in zip(ids, row, strict=True):
                            side.append(np.array(new, np.int64))
            return *(np.concatenate([np.zeros(0, np.int64), *side]) for side in ids), spelt
        return encode


def load(spark, byte_level_path: str, piece_path: str) -> Shared:
    with open(byte_level_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        return Shared(spark, Vocabularies(f.read(), g.read()))


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of both rows the right-hand token that ends its component."""
    n = len(a_ends)
    over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    own = np.arange(n, n + len(b_ends))
    successor = np.concatenate([n + over_a, np.where(a_ends[over_b] == b_ends, own, over_b)]) if n else own
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n] - n, successor[n:] - n
        successor = further


class Run:
    """Tokens, links and groups of a run of stretches of text that stand behind one another."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, lengths: np.ndarray):
        self.n, self.ids = len(lengths), (a, b)
        self.ends = tuple(np.cumsum(size[ids]) for size, ids in zip(sizes, self.ids, strict=True))
        borders = np.cumsum(lengths)
        self.rows = tuple(np.searchsorted(borders, ends) for ends in self.ends)
        self.counts = tuple(np.bincount(rows, minlength=self.n) for rows in self.rows)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, left id, right id) of every overlap: one for each stretch of bytes between neighbouring ends of any row."""
        ends = np.union1d(*self.ends)
        at = np.searchsorted(self.ends[0], ends)
        return self.rows[0][at], self.ids[0][at], self.ids[1][np.searchsorted(self.ends[1], ends)]

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group numbers of both rows' tokens (rising through the run) and the stretch of each group."""
        a, b = terminals(*self.ends)
        last = np.unique(b)
        return np.searchsorted(last, a), np.searchsorted(last, b), self.rows[1][last]

    def written(self, a_group: np.ndarray, b_group: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` per stretch; `words` are each side's ids in decimal behind each of its two separators."""
        out = np.empty(len(a_group) + len(b_group), object)
        for ids, group, other, edge, (inside, last) in ((self.ids[0], a_group, b_group, "left", words[0]), (self.ids[1], b_group, a_group, "right", words[1])):
            inner = np.zeros(len(group), bool)
            inner[:-1] = group[1:] == group[:-1]
            out[np.arange(len(group)) + np.searchsorted(other, group, edge)] = np.where(inner, inside[ids], last[ids])
        cuts, flat = np.concatenate([[0], np.cumsum(self.counts[0] + self.counts[1])]).tolist(), out.tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip(cuts, cuts[1:])]  # noqa: B905, RUF007


class _Numbers(dict):
    """Numbers of the stretches that a task remembers; those met for the first time wait to be aligned."""

    def __init__(self):
        super().__init__()
        self.waiting = []

    def __missing__(self, stretch: str) -> int:
        self[stretch] = number = len(self)
        self.waiting.append(stretch)
        return number


class Aligner:
    """Aligned texts of one task. Every remembered stretch has its counts, its groups as text, and its links."""

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies, self.width = vocabularies, len(vocabularies.right)
        self.encode = vocabularies.encoder()
        self.border = _CUT if vocabularies.cuts else _NEVER
        self.words = [tuple(np.array([f"{i}{c}" for i in range(len(side))], object) for c in (",", last)) for side, last in ((vocabularies.left, "|"), (vocabularies.right, ";"))]
        self.numbers, self.chars, self.written = _Numbers(), 0, []
        self.used = np.zeros(0, np.int64)
        self.counts = np.zeros((4, 0), np.int64)  # tokens of both rows, groups, links
        self.spelt = np.zeros(0, bool)
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Only the stretches used most stay, up to half of what may be remembered."""
        names = list(self.numbers)
        size = np.fromiter((len(s) + len(w) for s, w in zip(names, self.written, strict=True)), np.int64, len(names))
        order = np.argsort(-self.used, kind="stable")
        keep = np.sort(order[np.cumsum(size[order]) <= REMEMBERED_CHARS // 2])
        self.numbers = _Numbers()
        self.numbers.update((names[i], n) for n, i in enumerate(keep.tolist()))
        self.written, self.chars = [self.written[i] for i in keep.tolist()], int(size[keep].sum())
        self.pairs = self.pairs[self._links_of(keep)]
        self.counts, self.spelt, self.used = self.counts[:, keep], self.spelt[keep], self.used[keep] // 2
        self.first = np.concatenate([[0], np.cumsum(self.counts[3])])

    def _links_of(self, number: np.ndarray) -> np.ndarray:
        """Places in `pairs` of the links of some stretches, in order."""
        n = self.counts[3][number]
        upto = np.cumsum(n) - n
        return np.repeat(self.first[number] - upto, n) + np.arange(int(n.sum()))

    def _learn(self) -> None:
        stretches, self.numbers.waiting = self.numbers.waiting, []
        a, b, spelt = self.encode(stretches)
        lengths = np.array([len(s.encode()) + 1 for s in stretches], np.int64) * spelt
        run = Run(self.vocabularies.sizes, a, b, lengths)
        row, left, right = run.links()
        a_group, b_group, group_row = run.groups()
        counts = [*run.counts, np.bincount(group_row, minlength=run.n), np.bincount(row, minlength=run.n)]
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.spelt = np.concatenate([self.spelt, spelt])
        self.used = np.concatenate([self.used, np.zeros(run.n, np.int64)])
        written = run.written(a_group, b_group, self.words)
        self.written += written
        self.pairs = np.concatenate([self.pairs, left * self.width + right])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[3])])
        self.chars += sum(map(len, stretches)) + sum(map(len, written))

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK:
            border = self.border.search(text, start + CHUNK)
            if border is None:
                break
            yield from self.border.split(text[start:border.start()])
            start = border.end()
        yield from self.border.split(text[start:])

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, stretch number) of all stretches of the texts in order; texts without tokens have none."""
        if self.chars > REMEMBERED_CHARS:
            self._forget()
        get = self.numbers.__getitem__
        found = [np.fromiter(map(get, self._stretches(t)) if t else (), np.int64) for t in texts]
        if self.numbers.waiting:
            self._learn()
        row, number = np.repeat(np.arange(len(texts)), [len(x) for x in found]), np.concatenate(found)
        self.used += np.bincount(number, minlength=len(self.used))
        odd = np.zeros(len(texts), bool)
        odd[row[~self.spelt[number]]] = True  # a stretch that isn't spelt in full leaves its text without tokens
        keep = ~odd[row]
        return row[keep], number[keep]

    def totals(self, values: np.ndarray, row: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Sums by row of a value of each stretch."""
        upto = np.concatenate([[0], np.cumsum(values[number])])
        at = np.searchsorted(row, np.arange(n + 1))
        return upto[at[1:]] - upto[at[:-1]]

    def links(self, row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times) of the distinct linked pairs of each row, in order."""
        size = max(1, len(self.written))
        distinct, times = np.unique(row * size + number, return_counts=True)
        row, number = distinct // size, distinct % size
        n, pair = self.counts[3][number], self.pairs[self._links_of(number)]
        names, place = np.unique(pair, return_inverse=True)
        width = max(1, len(names))
        distinct, back = np.unique(np.repeat(row, n) * width + place, return_inverse=True)
        return distinct // width, names[distinct % width], np.bincount(back, np.repeat(times, n), len(distinct)).astype(np.int64)


def groups(docs: DataFrame, vocabularies: Shared, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups (null without tokens), pair and times (distinct linked
    pairs, and how many links are that pair)."""
    def make():
        aligner = Aligner(vocabularies.value)
        small = np.int32 if vocabularies.value.pair == "int" else np.int64

        def step(batch):
            for names, texts in text_runs(column(batch, "id"), column(batch, "t")):
                row, number = aligner.read(texts)
                n, written, flat = len(texts), aligner.written.__getitem__, number.tolist()
                cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
                out = {c: aligner.totals(v, row, number, n) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), aligner.counts, strict=True)}
                out["groups"] = [";".join(map(written, flat[i:j])) or None for i, j in zip(cuts, cuts[1:])]  # noqa: B905, RUF007
                link_row, pair, times = aligner.links(row, number)
                cuts = np.searchsorted(link_row, np.arange(n + 1))
                yield out | {"id": names} | {c: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for c, x in (("pair", pair.astype(small)), ("times", times.astype(np.int32)))}
        return step

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("t"))
    kind = docs.schema[id_column].dataType.simpleString()
    return arrow(rows, make, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<{vocabularies.value.pair}>, times array<int>").withColumnRenamed("id", id_column)


def pair_counts(aligned: DataFrame, vocabularies: Shared) -> DataFrame:
    """(pair, count, best): pair = left id * right vocabulary + right id, the documents that hold it linked, and whether
    no other pair of its left id is held by more."""
    def make():
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def merged():
            pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
            pair, place = np.unique(pair, return_inverse=True)
            return pair, np.bincount(place, n, len(pair)).astype(np.int64)

        def step(batch):
            if batch is not None:
                pair, n = np.unique(column(batch, "pair").flatten().to_numpy(), return_counts=True)
                held.append((pair.astype(np.int64), n))
                if sum(len(x) for x, _ in held) > 2 * HELD_PAIRS:
                    held[:] = [merged()]
            if batch is None or len(held[0][0]) > HELD_PAIRS:
                pair, n = merged()
                held[:] = [(pair[:0], n[:0])]
                yield {"pair": pair, "n": n}
        return step

    width = len(vocabularies.value.right)
    counts = stored(arrow(aligned.select("pair"), make, "pair long, n long", ending=True).groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    left = F.floor(F.col("pair") / width)
    most = counts.groupBy(left.alias("left")).agg(F.max("count").alias("most"))  # at most one row per left id
    return counts.withColumn("left", left).join(most, "left").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _known(counts: DataFrame, bound: int):
    """Broadcast table of the most frequent pairs, at most `bound` of them, and the rest (None: there is none)."""
    total, rest, top = counts.count(), None, counts
    if total > bound:
        least = counts.approxQuantile("count", [1 - bound / 2 / total], bound / 4 / total)[0]
        top, rest = counts.filter(F.col("count") > least), counts.filter(F.col("count") <= least)
    found = top.toArrow()
    if found.num_rows > bound:
        raise ValueError("more pairs than the bound")
    pair, count, best = (found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return counts.sparkSession.sparkContext.broadcast((pair[order].astype(np.int64), count[order].astype(np.int64), best[order].astype(bool))), rest


def align(docs: DataFrame, vocabularies: Shared, id_column: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (null without tokens)."""
    aligned = groups(docs, vocabularies, id_column, text).withColumn("row", F.monotonically_increasing_id())
    aligned = stored(aligned, "aligned", compression="zstd", **{"parquet.block.size": str(GROUP_BYTES)})
    known, rest = _known(stored(pair_counts(aligned, vocabularies), "pairs"), broadcast_pairs)

    def found(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs in the table, and whether they are there."""
        pairs = known.value[0]
        at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        return at, pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)

    @F.arrow_udf("struct<count_sum: long, n_best: long>")
    def counted(pair: pa.Array, times: pa.Array) -> pa.Array:
        done = [np.zeros((2, 0), np.int64)]
        for start in range(0, len(pair), ROWS):  # a few rows at a time: what is made on the way stays small
            part, often = pair.slice(start, ROWS), times.slice(start, ROWS).flatten().to_numpy()
            at, inside = found(part.flatten().to_numpy().astype(np.int64))
            cuts = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy())]).astype(np.int64)
            sums = np.zeros((2, len(inside) + 1), np.int64)
            for i in (0, 1):
                sums[i, 1:][inside] = known.value[i + 1][at[inside]] * often[inside]
            done.append(np.diff(np.cumsum(sums, axis=1)[:, cuts], axis=1))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(done, axis=1)], names=["count_sum", "n_best"])

    out = aligned.withColumn("sums", counted("pair", "times")).withColumns({"count_sum": F.col("sums.count_sum"), "n_best": F.col("sums.n_best")})
    if rest is not None:
        @F.arrow_udf("boolean")
        def absent(pair: pa.Array) -> pa.Array:
            return pa.array(~found(pair.to_numpy().astype(np.int64))[1])

        links = aligned.select("row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("row", "x.pair", "x.times").filter(absent("pair")).join(rest, "pair")
        more = links.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        out = out.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select(id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
