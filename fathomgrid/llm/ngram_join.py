"""Near-duplicate documents by an exact Jaccard join on word n-grams (operator 1).

A document is the set of its distinct word n-grams (fewer words: the whole sequence as one). Two link when the Jaccard
similarity is at least `percent`. The join is PPJoin-like:

* Rare first: n-grams are ordered by the magnitude of their estimated frequency, then by hash. The frequencies come from a
  sketch over the whole corpus whose width follows the corpus (up to `LOG2_CELLS`: 64 MB broadcast), so that frequent
  passages stay out of the prefixes at every size. Any order is right, whatever the sketch says.
* Prefix: linked sets share an n-gram among the first `n - ceil(percent n) + 1`. Equal sets are found first and only one
  document of each has a prefix. A second sketch drops prefix n-grams that occur in one prefix only, so what is shuffled are
  n-grams that may join.
* What is shuffled by n-gram are a few numbers a row. The suffix filter compares 512 parity bits of hash buckets, which bound
  the symmetric difference from below. For pairs with leaders length and suffix filters are judged once for each distinct pair.
  Where groups are joined pair by pair the rows that are left carry their parity bits, and all filters are conditions of that
  join: it compares the pairs of a group but makes rows of those only that pass.
* Equal sets are one class. In each n-gram's group every class first meets only the group's leaders (at most `LEADERS`, drawn
  anew for each n-gram: linear in the group). Of all its leaders at most `DRAWN` are looked at more closely, and at most `PICKS`
  of those that pass the filters. Pairs are distinct, so each is verified once, on the whole texts. After components are built, only groups that still hold several components are joined pair by pair,
  across components only: every component is exact and groups of near copies are never expanded. Links inside a component are
  left out by this; `links` verifies all candidate pairs and returns each link.

Empty and null texts have an empty set and are alone. Repeated rows and ties need no order: the component is named by its
smallest id. Null ids get the component of their class. Extra columns play no part. Hashes have 58 bits within the order;
two different sets with one 64-bit fingerprint raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import sketch
from fathomgrid.llm import textscan as ts
from fathomgrid.llm.components import components
from fathomgrid.llm.frames import arrow, column, stored

LEADERS, DRAWN, PICKS, SALTS = 8, 96, 24, 8
LOG2_CELLS, ROWS = 27, 256
PARITY = tuple(f"p{i}" for i in range(8))
_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Shingles:
    """Hashes of the n-grams of a run of documents, row after row."""

    def __init__(self, k: int):
        self.k, self.roll = k, ts.Rolling()

    def read(self, data: np.ndarray, cuts: np.ndarray) -> None:
        w = ts.words(data, cuts)
        hashes = ts.word_hashes(data, w, self.roll, lower=True)
        whole = ts.grams(hashes, self.k, self.roll)[ts.same_row(w.row, self.k)]
        count = np.diff(w.first)
        grams = np.maximum(count - self.k + 1, 0)
        short = np.flatnonzero((count > 0) & (count < self.k))
        if len(short):
            sums = self.roll.prefix(hashes)
            alone = self.roll.spans(sums, w.first[short], w.first[short + 1])
            whole = np.insert(whole, np.concatenate([[0], np.cumsum(grams)])[short], alone)
            grams[short] = 1
        self.hashes, self.cuts = whole, np.concatenate([[0], np.cumsum(grams)])


def _tokens(hashes: np.ndarray, sizes: sketch.Magnitudes) -> np.ndarray:
    """Sortable tokens, rare first: six bits of frequency magnitude, then the hash."""
    return sizes.of(hashes) << np.uint64(58) | hashes >> np.uint64(6)


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((percent * (na + nb)) / F.lit(100 + percent))


def _long_enough(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _alike(percent: int) -> Column:
    """Suffix filter on two classes with column prefixes a and b."""
    differ = sum((F.bit_count(F.col("a" + p).bitwiseXOR(F.col("b" + p))) for p in PARITY[1:]), F.bit_count(F.col("a" + PARITY[0]).bitwiseXOR(F.col("b" + PARITY[0]))))
    return differ <= F.col("an") + F.col("bn") - 2 * _overlap(F.col("an"), F.col("bn"), percent)


def _may_meet(percent: int) -> Column:
    """Length, positional and suffix filters on two prefix rows with column prefixes a and b."""
    na, nb = F.col("an"), F.col("bn")
    return _long_enough(na, nb, percent) & (F.least(na - F.col("apos"), nb - F.col("bpos")) >= _overlap(na, nb, percent)) & _alike(percent)


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the length and suffix filters."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("s").alias(side), *[F.col(c).alias(side + c) for c in ("n", *PARITY)]), side)
    return pairs.filter(_long_enough(F.col("an"), F.col("bn"), percent) & _alike(percent)).select("a", "b")


def _named(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(side + c) for c in ("s", "n", "pos", *PARITY, *columns)])


def _drawn(column: str, most: int) -> Column:
    """At most so many values of an array, drawn anew for each class `a`."""
    drawn = F.sort_array(F.transform(column, lambda x: F.struct(F.xxhash64(x, F.col("a")).alias("draw"), x.alias("b"))))
    return F.transform(F.slice(drawn, 1, most), lambda x: x["b"])


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared once each on whole texts."""
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(classes, "s").select("s", F.col("rep").alias("id")), "wanted")
    texts = stored(sketch.only(docs, wanted.select("id"), "id").join(wanted, "id").select("s", "t"), "texts")
    both = pairs.join(texts.select(F.col("s").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("s").alias("b"), F.col("t").alias("tb")), "b")

    def make():
        shingles, last = Shingles(k), [None, None]

        def sets(text: bytes) -> np.ndarray:
            if last[0] != text:
                data = np.frombuffer(text, np.uint8)
                shingles.read(data, np.array([0, len(data)]))
                last[:] = text, np.unique(shingles.hashes)
            return last[1]

        def step(batch):
            left, right = column(batch, "ta").cast(pa.binary()), column(batch, "tb").cast(pa.binary())
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                b = sets(right[i].as_py())
                data = np.frombuffer(left[i].as_py(), np.uint8)
                shingles.read(data, np.array([0, len(data)]))
                a = np.unique(shingles.hashes)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * same >= percent * (len(a) + len(b) - same)
            keep = pa.array(keep)
            yield {"a": column(batch, "a").filter(keep), "b": column(batch, "b").filter(keep)}
        return step

    return arrow(both.select("a", "b", "ta", "tb"), make, "a long, b long")


def _candidates(docs: DataFrame, k: int, percent: int, id_column: str, text: str, log2_counters: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (id, t), sets of all documents, classes of equal sets, and prefix n-grams of classes that may be shared."""
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    def make_values():
        shingles = Shingles(k)

        def values(batch):
            for _, _, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                shingles.read(data, cuts)
                yield shingles.hashes
        return values

    size = sketch.text_bytes(narrow, "t")
    counts = sketch.magnitudes(narrow.select("t"), make_values, log2_counters or sketch.width_for(size // 16, most=LOG2_CELLS))  # one to three n-grams a cell

    def sets_of(shingles, data, cuts):
        """Per document the sorted distinct tokens."""
        shingles.read(data, cuts)
        tokens, at = _tokens(shingles.hashes, counts.value), shingles.cuts.tolist()
        return [np.unique(tokens[i:j]) for i, j in zip(at, at[1:])]  # noqa: B905, RUF007

    def make_sets():
        shingles = Shingles(k)

        def step(batch):
            ids = column(batch, "id")
            for a, b, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                sets = sets_of(shingles, data, cuts)
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if n.sum() else np.zeros(0, np.uint64)
                first = np.concatenate([[0], np.cumsum(n)])
                full = np.flatnonzero(n)
                left, right, parity = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((8, len(n)), np.uint64)
                if len(full):
                    left[full] = np.add.reduceat(ts.mix(flat ^ _LEFT), first[full])
                    right[full] = np.add.reduceat(ts.mix(flat ^ _RIGHT), first[full])
                    bucket = ts.mix(flat) & np.uint64(511)
                    for i in range(8):
                        bit = np.where(bucket >> np.uint64(6) == i, np.uint64(1) << (bucket & np.uint64(63)), 0)
                        parity[i, full] = np.bitwise_xor.reduceat(bit, first[full])
                yield {"id": ids.slice(a, b - a), "n": n, "s": pa.array(left.view(np.int64), mask=n == 0), "s2": right.view(np.int64)} | {
                    p: parity[i].view(np.int64) for i, p in enumerate(PARITY)}
        return step

    sets = stored(arrow(narrow, make_sets, "id long, n long, s long, s2 long, " + ", ".join(f"{p} long" for p in PARITY)), "sets")

    same = F.when(F.min("s2") == F.max("s2"), F.min("id")).when(F.min("s2") < F.max("s2"), F.raise_error(F.lit("two sets share a fingerprint")))
    classes = stored(sets.filter("s is not null").groupBy("s").agg(same.alias("rep"), F.max("n").alias("n"), *[F.max(p).alias(p) for p in PARITY]), "classes")

    leads = sketch.id_test(classes.select("rep").filter("rep is not null"))

    def leading(batch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Texts of representatives (and, rarely, others: the same rows again): copies alone make no n-gram repeat."""
        ids, texts = column(batch, "id"), column(batch, "t")
        keep = pa.array(leads(ids) | ids.is_null().to_numpy(zero_copy_only=False))
        for i in range(0, len(ids), ROWS):  # a few rows are copied at a time
            yield from ts.pieces(texts.slice(i, ROWS).filter(keep.slice(i, ROWS)), ts.SCAN_BYTES)

    def make_prefixes():
        shingles = Shingles(k)

        def values(batch):
            found = []
            for _, _, data, cuts in leading(batch):
                found += [s[:_prefix(len(s), percent)] for s in sets_of(shingles, data, cuts)]
            return found
        return values

    log2_width = sketch.width_for(size // 8)
    bits = sketch.repeated_bits(narrow, make_prefixes, log2_width)

    def make_rows():
        shingles = Shingles(k)

        def step(batch):
            for _, _, data, cuts in leading(batch):
                sets = [tokens for tokens in sets_of(shingles, data, cuts) if len(tokens)]
                if sets:
                    s = np.array([np.add.reduce(ts.mix(tokens ^ _LEFT)) for tokens in sets], np.uint64).view(np.int64)
                    n = np.array([len(tokens) for tokens in sets])
                    size = np.array([_prefix(x, percent) for x in n.tolist()])
                    row = np.repeat(np.arange(len(n)), size)
                    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    token = np.concatenate([tokens[:x] for tokens, x in zip(sets, size.tolist(), strict=True)])
                    hit = sketch.may_repeat(bits.value, token, log2_width)
                    yield {"token": token[hit].view(np.int64), "s": s[row[hit]], "n": n[row[hit]], "pos": pos[hit]}
        return step

    return narrow, sets, classes, stored(arrow(narrow, make_rows, "token long, s long, n long, pos long"), "tokens")


def _shared(prefixes: DataFrame, by: str) -> DataFrame:
    """The distinct rows whose n-gram stands in rows with different values of `by`."""
    groups = prefixes.groupBy("token").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo <> hi").select("token")
    return prefixes.join(groups, "token").distinct()


def links(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text", log2_counters: int | None = None) -> DataFrame:
    """All links between different sets, each once: a, b (class ids, a < b). Documents of one class link as well.

    Every candidate pair of classes is verified, so the cost grows with the square of a group of near copies; the rows of
    an n-gram's group are dealt over `SALTS` keys.
    """
    narrow, _, classes, prefixes = _candidates(docs, k, percent, id_column, text, log2_counters)
    joined = stored(_shared(prefixes, "s").join(classes.select("s", *PARITY), "s"), "prefixes")
    left = _named(joined, "a").withColumn("salt", F.pmod(F.xxhash64("as"), F.lit(SALTS)))
    right = _named(joined, "b").withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    pairs = left.join(right, ["token", "salt"]).filter("`as` < bs").filter(_may_meet(percent))
    return _verify(pairs.select(F.col("as").alias("a"), F.col("bs").alias("b")).distinct(), narrow, classes, k, percent)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text", log2_counters: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, class_id (fingerprint of its set, null when empty), component_id."""
    narrow, sets, classes, prefixes = _candidates(docs, k, percent, id_column, text, log2_counters)
    ours = F.xxhash64("token")  # a draw is a class seen through its n-gram, and gives it back
    drawn = prefixes.select("token", F.col("s").bitwiseXOR(ours).alias("draw"))
    led = drawn.groupBy("token").agg(F.min("draw").alias("lo"), F.max("draw").alias("hi"), F.array(*[F.min(F.when(F.pmod("draw", F.lit(LEADERS)) == i, F.col("draw"))) for i in range(LEADERS)]).alias("draws"))
    led = led.filter("lo <> hi").select("token", F.explode(F.array_compact("draws")).alias("draw"))
    leaders = stored(led.select("token", F.col("draw").bitwiseXOR(ours).alias("b")), "leaders")
    star = prefixes.select("token", F.col("s").alias("a")).join(leaders, "token").filter("a <> b").groupBy("a").agg(F.collect_set("b").alias("found"))
    star = _may_link(star.select("a", F.explode(_drawn("found", DRAWN)).alias("b")), classes, percent).groupBy("a").agg(F.collect_set("b").alias("found"))
    star = star.select("a", F.explode(_drawn("found", PICKS)).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = stored(star, "star")
    labels = components(_verify(star, narrow, classes, k, percent))
    rest = prefixes.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    rest = stored(_shared(stored(rest, "labelled"), "label").join(classes.select("s", *PARITY), "s"), "rest")
    across = _named(rest, "a", "label").join(_named(rest, "b", "label"), "token").filter("`as` < bs and alabel <> blabel").filter(_may_meet(percent))
    across = across.select(F.col("as").alias("a"), F.col("bs").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(_verify(across, narrow, classes, k, percent)))

    named = classes.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    least = stored(named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    names = stored(named.join(least, "label").select("s", "component_id"), "names")
    return sets.join(names, "s", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("s").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
