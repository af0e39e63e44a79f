"""Per-ping array maths: scaling, bottom return, slant correction, world projection.

Scaling and correction are array expressions. The bottom-return search looks at runs of samples;
as nested array lambdas that is interpreted sample by sample, so it is one Arrow function over
whole batches instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomgrid.config import Bottom

FULL_SCALE = 65535.0
PROFILE = "settle int, slant_m double"


def scale_db(raw: Column, min_db: Column, max_db: Column) -> Column:
    return F.transform(raw, lambda s: min_db + s / F.lit(FULL_SCALE) * (max_db - min_db))


def _runs(hit: np.ndarray, length: int) -> np.ndarray:
    """For a (rows, n) boolean array: does a run of `length` hits start at each column?"""
    n = hit.shape[1] - length + 1
    out = hit[:, :n].copy()
    for k in range(1, length):
        out &= hit[:, k:k + n]
    return out


def search_bottom(db: np.ndarray, start_mm, length_mm, results, params: Bottom) -> tuple[np.ndarray, np.ndarray]:
    """Settle index and bottom slant (NaN: none) of a batch of equally long pings, (rows, n)."""
    rows, n = db.shape
    settle = np.full(rows, params.ringing_fallback, np.int64)
    if n >= params.ringing_search + params.ringing_persistence and rows:
        target = db[:, :params.ringing_search].max(axis=1, keepdims=True) - params.ringing_drop_db
        quiet = _runs(db[:, :params.ringing_search] < target, params.ringing_persistence)
        found = quiet.any(axis=1)
        settle[found] = quiet[found].argmax(axis=1)
    slant = np.full(rows, np.nan)
    begin = settle + params.noise_window
    enough = n >= begin + params.persistence
    for at in np.unique(settle[enough]):
        pick = np.flatnonzero(enough & (settle == at))
        part = db[pick]
        floor = part[:, at:at + params.noise_window].sum(axis=1) / params.noise_window
        loud = _runs(part > (floor + params.threshold_db)[:, None], params.persistence)
        loud[:, :at + params.noise_window] = False
        found = loud.any(axis=1)
        index, who = loud[found].argmax(axis=1), pick[found]
        slope = index / np.maximum(results[who] - 1, 1)
        slant[who] = (start_mm[who] + slope * length_mm[who]) / 1000.0
    return settle, slant


def _bottom(params: Bottom):
    @F.arrow_udf(PROFILE)
    def bottom(db: pa.Array, start_mm: pa.Array, length_mm: pa.Array, results: pa.Array) -> pa.Array:
        sizes = np.diff(db.offsets.to_numpy())
        values = db.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (start_mm, length_mm, results)]
        settle, slant = np.zeros(len(db), np.int32), np.full(len(db), np.nan)
        for size in np.unique(sizes):
            pick = np.flatnonzero(sizes == size)
            block = values[(ends[pick] - size)[:, None] + np.arange(size)]
            settle[pick], slant[pick] = search_bottom(block, *[c[pick] for c in columns], params)
        return pa.StructArray.from_arrays(
            [pa.array(settle), pa.array(slant, mask=np.isnan(slant))], ["settle", "slant_m"])

    return bottom


def bottom_return(db: Column, start_mm: Column, length_mm: Column, results: Column,
                  params: Bottom = Bottom()) -> Column:
    """struct(settle, slant_m): where ringing has decayed, and the slant range of the first bottom
    return (NULL when the ping is too short or shows none)."""
    return _bottom(params)(db, start_mm, length_mm, results)


def ground_samples(db: Column, start_mm: Column, length_mm: Column, results: Column, altitude: Column,
                   offset_m: Column, sign: Column) -> Column:
    """array<struct<y, v>> of one side: slant corrected, samples in the water column dropped."""
    # bound once through a one-element array: expressions inside a lambda are evaluated per element
    bound = F.array(F.struct((start_mm / 1000.0).alias("s"), (length_mm / 1000.0).alias("l"),
                             F.greatest(results - 1, F.lit(1)).alias("n"), altitude.alias("a"),
                             offset_m.alias("o"), sign.alias("g"), db.alias("d")))
    def project(p):
        slants = F.transform(p["d"], lambda v, i: F.struct(
            (p["s"] + i / p["n"] * p["l"]).alias("r"), v.alias("v")))
        return F.transform(F.filter(slants, lambda e: e["r"] > p["a"]), lambda e: F.struct(
            (p["g"] * (p["o"] + F.sqrt(e["r"] * e["r"] - p["a"] * p["a"]))).alias("y"), e["v"].alias("v")))

    return F.get(F.transform(bound, project), F.lit(0))
