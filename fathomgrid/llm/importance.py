"""Importance resampling towards good text (operator 8).

Documents are bags of hashed word unigrams and bigrams (`BUCKETS` buckets). Two bag-of-n-grams models are counted, one of
target documents and one of all documents; a document's log weight is the sum of log ratios over its n-grams. Gumbel noise,
drawn from a hash of seed and id, is added, and the documents with the `k` largest sums are a sample without replacement in
proportion to the weights. The k-th sum is found exactly by refining a histogram, so nothing is sorted in one task.

The target model may be fitted on at most `max_target` target documents, those with the smallest hash of their id; everything
else covers all documents. Null and empty texts have log weight 0. Null ids draw their noise from the seed alone. Ties at the
k-th sum go to smaller ids; repeated rows share one fate. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import arrow, column, stored

BUCKETS = 10_000
BINS = 1000


class Features:
    def __init__(self):
        self.roll = ts.Rolling()

    def read(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams, and the document of each."""
        w = ts.words(data, cuts)
        hashes = ts.word_hashes(data, w, self.roll, lower=True)
        two = ts.same_row(w.row, 2)
        found = np.concatenate([ts.mix(hashes), ts.grams(hashes, 2, self.roll)[two]]) if len(hashes) else hashes
        return (found % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([w.row, w.row[:-1][two]]) if len(hashes) else w.row


def _counts(docs: DataFrame) -> np.ndarray:
    def run(batches):
        features, total = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, cuts in ts.pieces(column(batch, "t")):
                total += np.bincount(features.read(data, cuts)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "c": pa.array(total[at], pa.int64())})

    out = np.zeros(BUCKETS)
    for row in docs.select("t").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():  # BUCKETS rows
        out[row.bucket] = row.c
    return out


def log_weights(docs: DataFrame, target_ids: DataFrame, id_column: str = "doc_id", text: str = "text", max_target: int = 10_000) -> DataFrame:
    """(id, log_weight, n_grams) of every document; `target_ids` has the ids of target documents in its first column."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    chosen = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_target)
    target = _counts(rows.join(F.broadcast(chosen), "id", "left_semi"))  # at most max_target ids
    raw = _counts(rows)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        features = Features()

        def step(batch):
            ids = column(batch, "id")
            for a, b, data, cuts in ts.pieces(column(batch, "t")):
                found, row = features.read(data, cuts)
                yield {"id": ids.slice(a, b - a), "log_weight": np.bincount(row, ratio.value[found], minlength=b - a), "n_grams": np.bincount(row, minlength=b - a)}
        return step

    return arrow(rows, make, "id long, log_weight double, n_grams long").withColumnRenamed("id", id_column)


def kth_largest(df: DataFrame, value: str, k: int) -> float | None:
    """The exact k-th largest value of a column: the histogram bin that holds it is refined until it holds one value."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if n == 0 or k <= 0:
        return None
    if k >= n:
        return low
    while low < high:
        width = (high - low) / BINS
        held = df.filter(F.col(value).between(low, high))
        if width <= 0 or low + width <= low:
            values = [r[0] for r in held.groupBy(value).count().orderBy(F.desc(value)).limit(BINS).collect()]
            sizes = {r[0]: r[1] for r in held.filter(F.col(value).isin(values)).groupBy(value).count().collect()}
            for x in values:
                k -= sizes[x]
                if k <= 0:
                    return x
            high = values[-1]
            continue
        place = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = sorted(held.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in bins:
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = 0.5, seed: int = 7, id_column: str = "doc_id", text: str = "text", max_target: int = 10_000) -> DataFrame:
    """One row per document: id, log_weight, n_grams, gumbel_key, selected (one of the `fraction` of rows with the largest keys)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column)), 11) + 0.5) / F.lit(float(1 << 53))
    scored = log_weights(docs, target_ids, id_column, text, max_target)
    scored = stored(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    k = int(scored.count() * fraction)
    least = kth_largest(scored, "gumbel_key", k)
    if least is None:
        return scored.withColumn("selected", F.lit(False))
    spare = k - scored.filter(F.col("gumbel_key") > least).count()
    last = scored.filter(F.col("gumbel_key") == least).groupBy(id_column).agg(F.count("*").alias("n")).orderBy(id_column).limit(spare).agg(F.max(id_column)).first()[0]
    return scored.withColumn("selected", (F.col("gumbel_key") > least) | ((F.col("gumbel_key") == least) & (F.coalesce(F.col(id_column) <= F.lit(last), F.lit(last is None)))))
