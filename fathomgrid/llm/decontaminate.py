"""Documents that hold benchmark items, found by rare n-gram seeds and scored by local alignment (operator 5).

Words are runs of letters and digits, lower-cased. The n-grams of all items are folded into a bitmap of fixed size
(`2**log2_bits` bits, the only thing broadcast); one scan of the documents keeps those n-grams that hit it, with the words
around them. Seeds are ranked by the number of passages that hold them. Rare ones (at most `rare` passages) come first: they
join passages to items, and those pairs need nothing else. Only pairs without a rare seed in common are joined by their
frequent n-grams, so a copy that leaked thousands of times is found like one that leaked once. A seed's passages and items
are dealt over keys such that no key joins many more than `PAIRS` pairs. Every passage of a pair is aligned with the item
(Smith-Waterman on words, linear gaps), around the seeds where they are frequent, whole where they are rare; the score is
divided by that of a perfect copy. Where too few of the item's words stand in the passage to reach the threshold (common
phrases), the alignment is left out. `n_seeds` counts the seeds that joined the pair.

Items with fewer than `n` words use all their words as one seed when they have at least two; shorter, null and empty ones
match nothing. Null and empty documents match nothing. Repeated rows are each judged; the best passage of a document and
item is returned, ties to the earliest. Null ids are left out of the result. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import sketch
from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import arrow, column, stored

MATCH, MISMATCH, GAP = 2, -1, -1
PAIRS = 1 << 16


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score and the end of its passage part (the first such end)."""
    ramp = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Reader:
    def __init__(self):
        self.roll = ts.Rolling()

    def read(self, column_: pa.Array):
        """Runs of documents: first row, words, word hashes."""
        lowered = pa.array([(t or "").lower() for t in column_.to_pylist()], pa.string())
        for a, b, data, cuts in ts.pieces(lowered):
            w = ts.words(data, cuts, ts.PUNCTUATION)
            yield a, b, w, ts.word_hashes(data, w, self.roll)

    def grams(self, w: ts.Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-gram hashes and their first words."""
        at = np.flatnonzero(ts.same_row(w.row, n))
        return ts.grams(hashes, n, self.roll)[at] if len(at) else np.zeros(0, np.uint64), at


def _item_table(items: DataFrame, n: int, id_column: str, text: str) -> DataFrame:
    def make():
        reader = Reader()

        def step(batch):
            ids = column(batch, "id")
            for a, b, w, hashes in reader.read(column(batch, "t")):
                count = np.diff(w.first)
                grams, at = reader.grams(w, hashes, n)
                row = w.row[at]
                seeds = [(grams[row == r], at[row == r] - w.first[r]) for r in range(b - a)]
                for r in np.flatnonzero((count >= 2) & (count < n)):
                    i, j = w.first[r], w.first[r + 1]
                    seeds[r] = reader.grams(ts.Words(w.starts[i:j], w.ends[i:j], w.row[i:j], np.array([0, j - i])), hashes[i:j], int(count[r]))
                yield {"item": ids.slice(a, b - a), "size": count, "words": [hashes[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:], strict=True)],
                       "seeds": [s.view(np.int64).tolist() for s, _ in seeds], "places": [p.tolist() for _, p in seeds]}
        return step

    rows = items.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return arrow(rows, make, "item long, size long, words binary, seeds array<long>, places array<long>")


def _pairs(spots: DataFrame, seeds: DataFrame, rare: int) -> DataFrame:
    """Passages and items with a seed in common, each pair once: p, item, size, n_seeds and between which shifts to align."""
    grams = seeds.groupBy("item", "size", "h").agg(F.min("q").alias("q0"), F.max("q").alias("q1"))
    seen = spots.groupBy("h").agg(F.count("*").alias("n"))
    held = grams.groupBy("h").agg(F.count("*").alias("m"))
    ranked = stored(grams.join(seen, "h").join(held, "h").withColumn("keys", F.ceil(F.col("n") * F.col("m") / PAIRS)), "seeds")
    # every such seed stands for PAIRS joined rows, so they are few
    busy = ranked.filter("keys > 1").select("h", "keys").distinct()
    dealt = spots.join(busy, "h", "left").withColumn("key", F.pmod(F.xxhash64("p"), F.coalesce("keys", F.lit(1)))).drop("keys")

    def met(some: DataFrame):
        spread = some.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1)))
        return dealt.join(spread, ["h", "key"]).groupBy("p", "item", "size")

    whole = (F.lit(0).cast("long").alias("lo"), F.lit(1 << 40).alias("hi"))
    near = stored(met(ranked.filter(F.col("n") <= rare)).agg(F.count("*").alias("n_seeds")).select("*", *whole), "near")
    far = met(ranked.filter(F.col("n") > rare)).agg(
        F.count("*").alias("n_seeds"), F.min(F.col("first") - F.col("q1")).alias("lo"), F.max(F.col("last") - F.col("q0")).alias("hi"))
    return near.unionByName(far.join(near.select("p", "item"), ["p", "item"], "left_anti"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 4, threshold: float = 0.4, rare: int = 64, log2_bits: int = 24, id_column: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) whose best alignment reaches `threshold`: id, item_id, score, first_word, n_words, n_seeds."""
    spark = docs.sparkSession
    known = stored(_item_table(items, n, item_id, item_text), "items")
    seeds = known.select("item", "size", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("item", "size", F.col("x.seeds").alias("h"), F.col("x.places").alias("q"))
    longest = known.agg(F.max("size"), F.min(F.when(F.col("size") >= 2, F.col("size")))).first()
    reach, lengths = int(longest[0] or 0), sorted(range(min(n, int(longest[1] or n)), n + 1))

    def fold():
        def step(batch):
            at = np.unique(ts.mix(column(batch, "h").to_numpy().view(np.uint64)) >> np.uint64(64 - log2_bits)).astype(np.int64)
            yield {"at": at}
        return step

    bitmap = np.zeros(max(1, (1 << log2_bits) // 8), np.uint8)
    for row in arrow(seeds.select("h"), fold, "at long").distinct().collect():  # at most 2**log2_bits
        bitmap[row[0] >> 3] |= np.uint8(1 << (row[0] & 7))
    bitmap = spark.sparkContext.broadcast(bitmap)

    def scan():
        reader = Reader()
        around = reach + reach // 2 + 8

        def step(batch):
            ids = column(batch, "id")
            for a, _, w, hashes in reader.read(column(batch, "t")):
                found, where = [], []
                for size in lengths:
                    grams, at = reader.grams(w, hashes, size)
                    slot = (ts.mix(grams) >> np.uint64(64 - log2_bits)).astype(np.int64)
                    hit = (bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    found.append(grams[hit])
                    where.append(at[hit])
                found, where = np.concatenate(found), np.concatenate(where)
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                found, where = found[order], where[order]
                row = w.row[where]
                new = np.flatnonzero(np.r_[True, (where[1:] - where[:-1] > 2 * around) | (row[1:] != row[:-1])])
                out = {c: [] for c in ("id", "first_word", "words", "hits", "places")}
                for i, j in zip(new.tolist(), [*new[1:].tolist(), len(where)], strict=True):
                    r = row[i]
                    start, end = max(w.first[r], where[i] - around), min(w.first[r + 1], where[j - 1] + around)
                    out["id"].append(ids[a + int(r)].as_py())
                    out["first_word"].append(int(start - w.first[r]))
                    out["words"].append(hashes[start:end].tobytes())
                    out["hits"].append(found[i:j].view(np.int64).tolist())
                    out["places"].append((where[i:j] - start).tolist())
                yield out
        return step

    narrow = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    passages = stored(arrow(narrow, scan, "id long, first_word long, words binary, hits array<long>, places array<long>").withColumn("p", F.monotonically_increasing_id()), "passages")
    spots = passages.select("p", F.explode(F.arrays_zip("hits", "places")).alias("x")).groupBy("p", F.col("x.hits").alias("h")).agg(
        F.min("x.places").alias("first"), F.max("x.places").alias("last"))
    pairs = _pairs(stored(spots, "hits"), seeds, rare)

    def score():
        def step(batch):
            words, item = column(batch, "words"), column(batch, "item_words")
            lo, hi = column(batch, "lo").to_numpy(), column(batch, "hi").to_numpy()
            first = column(batch, "first_word").to_numpy()
            value, start, length = [], [], []
            for i in range(len(lo)):
                b, a = np.frombuffer(item[i].as_py(), np.uint64), np.frombuffer(words[i].as_py(), np.uint64)
                slack = len(b) // 2 + 8
                left = max(0, int(lo[i]) - slack)
                part = a[left:int(hi[i]) + len(b) + slack]
                if np.isin(b, part).sum() / len(b) < threshold:  # no alignment scores more than a match for each of these words
                    part = part[:0]
                best, end = align(b, part)
                back = align(b[::-1], part[:end][::-1])[1]
                value.append(best / (MATCH * len(b)))
                start.append(int(first[i]) + left + end - back)
                length.append(back)
            yield {c: column(batch, c) for c in ("id", "item", "n_seeds")} | {"score": value, "first_word": start, "n_words": length}
        return step

    whole = pairs.join(passages.select("p", "id", "first_word", "words"), "p").join(known.select("item", F.col("words").alias("item_words")), "item")
    scored = arrow(whole, score, "id long, item long, n_seeds long, score double, first_word long, n_words long").filter(F.col("score") >= threshold)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("score", -F.col("first_word"), "n_words", "n_seeds")).alias("b"))
    return best.select(F.col("id").alias(id_column), F.col("item").alias(item_id), F.col("b.score").alias("score"), (-F.col("b.col2")).alias("first_word"), F.col("b.n_words").alias("n_words"), F.col("b.n_seeds").alias("n_seeds"))


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents without contaminated ones."""
    found = stored(contaminated(docs, items, id_column=id_column, **options).select(id_column).distinct(), "contaminated")
    return sketch.without(docs, found, id_column)
