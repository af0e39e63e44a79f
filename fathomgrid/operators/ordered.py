"""Ordered passes that do not put a whole mission into one task.

Many sonar operators look along a mission: previous ping, last known pose, running count. Rows are
cut into slices of the ordering column: each (mission, slice) is scanned on its own, what its edge
rows know is carried to the other slices of the mission, and both are joined on (mission, slice).
A slice has a fixed width in the unit of the column, so its number is a plain expression: no pass
over the data, the same plan at every size, and as many slices as the mission is long. Rows of a
slice are bounded by the recorder's rate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.config import Scale

MISSION = ("mission_id",)
SLICE = "_slice"
HALO = "_halo"


@dataclass(frozen=True)
class Slices:
    """Slices of an ordering column, `width` wide; without a width the table is one slice."""

    column: str
    width: float | None = None

    @property
    def single(self) -> bool:
        return self.width is None

    @classmethod
    def fit(cls, column: str, scale: Scale = Scale()) -> "Slices":
        """The usual width for a column: stamps in nanoseconds, times in seconds, else row numbers."""
        if column.endswith("_ns"):
            return cls(column, scale.slice_s * 1e9)
        return cls(column, scale.slice_s if column in scale.seconds else float(scale.slice_rows))

    def assign(self, df: DataFrame, output: str = SLICE, value: Column | None = None) -> DataFrame:
        """Add the slice number of the ordering column (or of `value`) as `output`."""
        if self.single:
            return df.withColumn(output, F.lit(0).cast("long"))
        value = F.col(self.column) if value is None else value
        return df.withColumn(output, F.floor(value.cast("double") / F.lit(self.width)).cast("long"))

    def start_of(self, number: int) -> float:
        """Lower edge of slice `number`."""
        return math.inf if self.single else number * self.width


def with_halo(df: DataFrame, slices: Slices, width) -> DataFrame:
    """Rows tagged with their slice, plus copies (`_halo` true) in every later slice that starts
    within `width` after them."""
    own = slices.assign(df)
    if slices.single:
        return own.withColumn(HALO, F.lit(False))
    both = slices.assign(own, "_reach", F.col(slices.column) + F.lit(width))
    return (both.withColumn("_to", F.explode(F.sequence(SLICE, "_reach")))
            .withColumn(HALO, F.col("_to") != F.col(SLICE))
            .withColumn(SLICE, F.col("_to")).drop("_to", "_reach"))


@dataclass(frozen=True)
class Look:
    kind: str
    expr: Column


def previous(expr: Column) -> Look:
    """Value at the row just before."""
    return Look("previous", expr)


def latest(expr: Column) -> Look:
    """Last non-NULL value at or before the row."""
    return Look("latest", expr)


def upcoming(expr: Column) -> Look:
    """First non-NULL value at or after the row."""
    return Look("upcoming", expr)


def running(expr: Column) -> Look:
    """Sum up to and including the row."""
    return Look("running", expr)


def position() -> Look:
    """1-based number of the row."""
    return Look("running", F.lit(1).cast("long"))


def scan(df: DataFrame, looks: dict[str, Look], *, keys: Sequence[str] = MISSION,
         order: Sequence[str] = ("t", "seq"), slices: Slices | None = None) -> DataFrame:
    """Add one column per look. `order` must be a total order inside a key; its first column must
    be numeric and is the one that is sliced."""
    slices = slices or Slices.fit(order[0])
    part = [*keys, SLICE]
    rows = slices.assign(df)
    by = Window.partitionBy(*part).orderBy(*order)
    up = by.rowsBetween(Window.unboundedPreceding, 0)
    # `first` over a frame that ends at unboundedFollowing is quadratic: walk backwards instead.
    down = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
        Window.unboundedPreceding, 0)
    local = {
        # boxed, so that a NULL value and a missing row stay apart
        "previous": lambda e: F.lag(F.struct(e.alias("v"))).over(by),
        "latest": lambda e: F.last(e, ignorenulls=True).over(up),
        "upcoming": lambda e: F.last(e, ignorenulls=True).over(down),
        "running": lambda e: F.sum(e).over(up),
    }
    found = {name: local[look.kind](look.expr) for name, look in looks.items()}
    inside = rows.select("*", *[c.alias(n) for n, c in found.items()])

    # What a slice tells others stands in its last row (for `upcoming`, in its first row).
    is_last, is_first = F.lead(F.lit(True)).over(by).isNull(), F.lag(F.lit(True)).over(by).isNull()
    edge = {
        "previous": lambda n: F.struct(looks[n].expr.alias("v")),
        "latest": lambda n: found[n],
        "upcoming": lambda n: F.when(is_first, found[n]),
        "running": lambda n: found[n],
    }
    edges = rows.select(*part, is_last.alias("_last"), is_first.alias("_first"), *[
        edge[look.kind](n).alias(f"_s_{n}") for n, look in looks.items()])
    forward = any(look.kind == "upcoming" for look in looks.values())
    edges = edges.filter("_last or _first" if forward else "_last")
    # other slices only: ranges on the slice number leave out the slice itself
    before = Window.partitionBy(*keys).orderBy(SLICE).rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rangeBetween(Window.unboundedPreceding, -1)
    at_last = lambda c: F.when(F.col("_last"), c)
    carried = {
        "previous": lambda c: F.last(at_last(c), ignorenulls=True).over(before),
        "latest": lambda c: F.last(at_last(c), ignorenulls=True).over(before),
        "upcoming": lambda c: F.last(c, ignorenulls=True).over(after),
        "running": lambda c: F.sum(at_last(c)).over(before),
    }
    carry = edges.select(*part, "_last", *[
        carried[look.kind](F.col(f"_s_{n}")).alias(f"_c_{n}") for n, look in looks.items()]).filter("_last").drop("_last")
    merge = {
        "previous": lambda n: F.coalesce(F.col(n), F.col(f"_c_{n}"))["v"],
        "latest": lambda n: F.coalesce(F.col(n), F.col(f"_c_{n}")),
        "upcoming": lambda n: F.coalesce(F.col(n), F.col(f"_c_{n}")),
        "running": lambda n: F.when(F.col(n).isNull(), F.col(f"_c_{n}")).otherwise(
            F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))),
    }
    return inside.join(carry, part, "left").select(*df.columns, *[merge[look.kind](n).alias(n) for n, look in looks.items()])


def newest(df: DataFrame, n: int, *, keys: Sequence[str] = MISSION, order: Sequence[str] = ("t", "seq"),
           slices: Slices | None = None) -> DataFrame:
    """The newest `n` rows per key. A first cut inside each slice of the key keeps a hot key from
    being ranked by one task."""
    cut = slices or Slices.fit(order[0])
    newest_first = [F.col(c).desc() for c in order]
    first = Window.partitionBy(*keys, "_share").orderBy(*newest_first)
    last = Window.partitionBy(*keys).orderBy(*newest_first)
    return (cut.assign(df, "_share")
            .withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
            .withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n)
            .drop("_share", "_rank"))


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], *, keys: Sequence[str] = MISSION,
                      accuracy: int = 10_000) -> DataFrame:
    """Percentiles with linear interpolation, one `array<double>` column `q` per key; NULL for a
    key without values.

    A sketch brackets every wanted rank within 2 / `accuracy` of the rows. Then values below a
    bracket are only counted, and the few inside are counted value by value and ranked. No row is
    shuffled by its value, or by its key: brackets are broadcast.
    """
    clean = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    around = sorted({min(1.0, max(0.0, p + d / accuracy)) for p in probs for d in (-2, 2)})
    place = {p: i for i, p in enumerate(around)}
    low, high = ([place[min(1.0, max(0.0, p + d / accuracy))] for p in probs] for d in (-2, 2))
    sketch = clean.groupBy(*keys).agg(F.percentile_approx("_v", around, accuracy).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                      F.count("_v").alias("_total"))
    edges = []
    for i, p in enumerate(probs):
        lo = F.col("_min") if p * accuracy <= 2 else F.col("_q")[low[i]]
        hi = F.col("_max") if (1 - p) * accuracy <= 2 else F.col("_q")[high[i]]
        edges.append(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi")))
    wanted = sketch.select(*keys, "_total", F.explode(F.array(*edges)).alias("_w"))
    brackets = sketch.select(*keys, F.transform(F.array(*edges), lambda e: F.struct(e["i"].alias("i"), e["lo"].alias("lo"), e["hi"].alias("hi"))).alias("_b"))
    near = clean.join(F.broadcast(brackets), list(keys))  # one narrow row a key: the values stay where they are
    # per key and bracket one row for all values below it, one per value inside it, one for all above it; the
    # bracket holds every wanted rank or the one next to it, so the nearest value stands for those outside
    side = F.when(F.col("_v") < F.col("_b.lo"), -1).when(F.col("_v") > F.col("_b.hi"), 1).otherwise(0)
    spots = near.filter("_v is not null").select(*keys, "_v", F.explode("_b").alias("_b")).withColumn("_side", side)
    counted = spots.groupBy(*keys, F.col("_b.i").alias("_i"), "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_in")).agg(
        F.count(F.lit(1)).alias("_n"), F.when(F.col("_side") < 0, F.max("_v")).otherwise(F.min("_v")).alias("_v"))
    upto = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_n").over(upto)).join(
        wanted.select(*keys, "_total", F.col("_w.i").alias("_i"), F.col("_w.p").alias("_p")), [*keys, "_i"])
    at = F.col("_p") * (F.col("_total") - 1)
    begin = F.col("_end") - F.col("_n")
    pick = lambda r: F.max(F.when((begin <= r) & (r < F.col("_end")), F.col("_v")))
    points = ranked.groupBy(*keys, "_i").agg(pick(F.floor(at)).alias("lo"), pick(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("f"))
    one = points.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo")))).alias(f"_p{i}") for i in range(len(probs))])
    return sketch.select(*keys).join(one.select(*keys, F.array(*[f"_p{i}" for i in range(len(probs))]).alias("q")), list(keys), "left")
