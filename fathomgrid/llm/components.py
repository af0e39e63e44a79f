"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.frames import stored


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Connect each node's neighbours to its smallest one: larger neighbours (`both`) or smaller ones only."""
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if both:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every linked node and the smallest node it reaches. Rounds grow with the logarithm of the longest chain."""
    pairs = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    state = None
    while True:
        now = tuple(pairs.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == state:
            break
        state = now
        pairs = stored(_star(_star(pairs, True), False), "links")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
