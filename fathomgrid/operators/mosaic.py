"""Gridding of geo-referenced samples into mosaic cells, and work on the cells.

Samples: mission_id, ping_seq, sample_idx, x, y, v (intensity), rng (lateral range, NULL counts as 0).
Cells live on an unbounded lattice anchored at -half_extent, so the result does not depend on arrival order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomgrid.config import GapFill, Mosaic
from fathomgrid.functions import attitude, geodesy
from fathomgrid.operators.ordered import MISSION, exact_percentiles

# Step weights of the 3x3 distance mask.
STRAIGHT_STEP, DIAGONAL_STEP = 0.955, 1.3693
#: cells along a side of the tiles that samples are splatted in
SPLAT_TILE = 32
#: what a column of places reached from a hit costs, in steps over the arrays of a tile
SPARSE = 40
#: cells along a side of the tiles that samples are splatted and gaps filled in together
FILL_TILE = 64
#: rows of such tiles taken at once, places of arrays made at once, and bins along a side of a tile for hits near each other
FILL_ROWS, FILL_SLOTS, FILL_BINS = 1 << 16, 1 << 17, 12

# Ordering keys are decimals, not structs, so that the cell aggregation stays a hash aggregation with
# map-side combining: 18 digits of range, and 20 of ping and sample number (any int sample, pings up to
# 4e10). A number that does not fit is an error. Ranges count in steps of 2**-36 m, which is exact for
# single-precision values from 0.13 mm on.
SAMPLE_SPAN = 1 << 31
RANGE_SCALE = float(1 << 36)


def project_samples(pings: DataFrame, keys: Sequence[str] = MISSION) -> DataFrame:
    """Samples of pings (robot_x, robot_y, yaw, y_local[], intensity_db[]) without densification."""
    flat = pings.select(*keys, F.col("seq").alias("ping_seq"), "robot_x", "robot_y", "yaw",
                        F.posexplode(F.arrays_zip("y_local", "intensity_db")).alias("sample_idx", "s"))
    y = F.col("s.y_local")
    return flat.select(
        *keys, "ping_seq", "sample_idx",
        attitude.across_track_x(F.col("robot_x"), F.col("yaw"), y).alias("x"),
        attitude.across_track_y(F.col("robot_y"), F.col("yaw"), y).alias("y"),
        F.col("s.intensity_db").alias("v"), F.abs(y).alias("rng"))


def cell_number(at: Column, params: Mosaic) -> Column:
    return F.floor((at + params.half_extent_m) / params.cell_m)


def cell_center(number: Column, params: Mosaic) -> Column:
    return (number + 0.5) * params.cell_m - params.half_extent_m


def place_key(ping: Column, sample: Column) -> Column:
    """Place of a sample in the order of pings and of samples inside a ping."""
    return (ping.cast("decimal(11,0)") * F.lit(SAMPLE_SPAN).cast("decimal(10,0)") + sample.cast("decimal(10,0)")).cast("decimal(20,0)")


def nearness_key(near: Column, ping: Column, sample: Column) -> Column:
    """Order key of the closest sample: smallest range first, the latest among equals."""
    steps = F.floor(near.cast("double") * RANGE_SCALE).cast("decimal(17,0)")
    return (-steps * F.lit(str(10**20)).cast("decimal(21,0)")).cast("decimal(38,0)") + place_key(ping, sample)


def _order_keys() -> dict[str, Column]:
    ping, sample = F.col("ping_seq").cast("long"), F.col("sample_idx").cast("int")
    return {
        # latest ping, last sample in it
        "newest": place_key(ping, sample),
        # first ping to hit the cell, but the last of its samples there
        "oldest": place_key(-ping, sample),
        # smallest single-precision range; among equals the latest sample
        "closest": nearness_key(F.coalesce(F.abs(F.col("rng")).cast("float"), F.lit(0.0).cast("float")), ping, sample),
    }


#: Cell policies that show one real sample: name -> aggregate over samples (value, order key).
#: Register another policy by adding an entry here.
POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    name: F.max_by for name in ("closest", "oldest", "newest")}
ORDER_KEYS: dict[str, Callable[[], Column]] = {name: (lambda n=name: _order_keys()[n]) for name in POLICIES}


def register_policy(name: str, order_key: Callable[[], Column]) -> None:
    """Add a cell policy: the sample with the largest order key is shown."""
    POLICIES[name] = F.max_by
    ORDER_KEYS[name] = order_key


def mosaic(samples: DataFrame, params: Mosaic = Mosaic(), *, policies: Sequence[str] | None = None,
           keys: Sequence[str] = MISSION) -> DataFrame:
    """Cells (keys, cx, cy): sum, wsum, count and one column per policy, in one aggregation.

    With bilinear splatting each sample adds to its four surrounding cells; counts and policies
    belong to the cell the sample lies in, so a cell may have weight but a count of 0. Samples go to
    the tile their cells lie in (a few at a border to two or four) and add to them there: one row a
    sample is shuffled, not four cells with their planes. A task holds the cells of a tile, not its
    samples. Streams are combined cell by cell.
    """
    policies = list(POLICIES) if policies is None else list(policies)
    tile = []
    if params.bilinear and not samples.isStreaming:
        tile = ["_tx", "_ty"]
        for t, c in zip(tile, ("x", "y"), strict=True):
            low = F.floor((F.col(c) + params.half_extent_m) / params.cell_m - 0.5)
            samples = samples.withColumn(t, F.explode(F.array_distinct(F.array(*[F.floor((low + d) / SPLAT_TILE) for d in (0, 1)]))))
        samples = samples.repartition(*keys, *tile)
    ranked = samples.select(*keys, *tile, "x", "y", "v", *[ORDER_KEYS[p]().alias(f"_{p}") for p in policies])
    home_x, home_y = cell_number(F.col("x"), params), cell_number(F.col("y"), params)
    if not params.bilinear:
        cells = ranked.select("*", home_x.alias("cx"), home_y.alias("cy"), F.lit(1.0).alias("w"), F.lit(True).alias("home"))
    else:
        gx = (F.col("x") + params.half_extent_m) / params.cell_m - 0.5
        gy = (F.col("y") + params.half_extent_m) / params.cell_m - 0.5
        based = ranked.select("*", gx.alias("gx"), gy.alias("gy"), F.floor(gx).alias("ix"), F.floor(gy).alias("iy"),
                              home_x.alias("hx"), home_y.alias("hy"))
        fx, fy = F.col("gx") - F.col("ix"), F.col("gy") - F.col("iy")
        corners = F.array(*[
            F.struct((F.col("ix") + dx).alias("cx"), (F.col("iy") + dy).alias("cy"),
                     ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w"))
            for dy in (0, 1) for dx in (0, 1)])
        cells = (based.withColumn("c", F.explode(corners)).filter(F.col("c.w") > params.min_splat_weight)
                 .select(*keys, *tile, "v", *[f"_{p}" for p in policies], "c.cx", "c.cy", "c.w",
                         ((F.col("c.cx") == F.col("hx")) & (F.col("c.cy") == F.col("hy"))).alias("home")))
    for t, c in zip(tile, ("cx", "cy")):  # noqa: B905
        cells = cells.filter(F.floor(F.col(c) / SPLAT_TILE) == F.col(t))
    home = F.col("home")
    return cells.groupBy(*keys, *tile, "cx", "cy").agg(
        F.sum(F.col("v") * F.col("w")).alias("sum"), F.sum("w").alias("wsum"), F.count(F.when(home, 1)).alias("count"),
        *[POLICIES[p](F.col("v"), F.when(home, F.col(f"_{p}"))).alias(p) for p in policies]).drop(*tile)


def shown_value(mode: str, params: Mosaic = Mosaic()) -> Column:
    """The value a cell shows under a policy, NULL for an empty cell."""
    if mode == "average":
        return F.when(F.col("wsum") >= params.min_shown_weight, F.col("sum") / F.col("wsum"))
    if mode not in POLICIES:
        raise ValueError(f"unknown cell policy {mode!r}")
    return F.when(F.col("count") > 0, F.col(mode))


def render(cells: DataFrame, mode: str = "average", params: Mosaic = Mosaic(), *,
           keys: Sequence[str] = MISSION) -> DataFrame:
    """keys, cx, cy, count, value."""
    return cells.select(*keys, "cx", "cy", "count", shown_value(mode, params).alias("value"))


def extent(cells: DataFrame, params: Mosaic = Mosaic(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Occupied world box, its shape in cells, and the share of cells in it that were hit.

    The denominator is the tight box of hit cells, not a padded array.
    """
    edge = lambda n: n * params.cell_m - params.half_extent_m
    box = cells.filter("count > 0").groupBy(*keys).agg(
        F.min("cx").alias("x_lo"), F.max("cx").alias("x_hi"), F.min("cy").alias("y_lo"), F.max("cy").alias("y_hi"),
        F.count(F.lit(1)).alias("occupied"))
    columns, rows = F.col("x_hi") - F.col("x_lo") + 1, F.col("y_hi") - F.col("y_lo") + 1
    return box.select(
        *keys, edge(F.col("x_lo")).alias("xmin"), edge(F.col("x_hi") + 1).alias("xmax"),
        edge(F.col("y_lo")).alias("ymin"), edge(F.col("y_hi") + 1).alias("ymax"),
        columns.alias("columns"), rows.alias("rows"), "occupied",
        (100.0 * F.col("occupied") / (columns * rows)).alias("coverage_pct"))


def contrast_limits(cells: DataFrame, params: Mosaic = Mosaic(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Display range per key (vmin, vmax): percentiles of the non-empty values, (0, 1) without any."""
    probs = [p / 100.0 for p in params.percentiles]
    found = exact_percentiles(cells, "value", probs, keys=keys)
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    top = F.when(high - low < 1e-6, low + 1e-6).otherwise(high)
    return found.select(*keys, F.coalesce(low, F.lit(0.0)).alias("vmin"), F.coalesce(top, F.lit(1.0)).alias("vmax"))


def with_limits(cells: DataFrame, params: Mosaic = Mosaic(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Cells with the display range of their key. Ranges are one narrow row a key and are broadcast: joined by key, all cells of
    a mission would meet in one task."""
    return cells.join(F.broadcast(contrast_limits(cells, params, keys=keys)), list(keys))


def _within(g: int) -> list[int]:
    """How far along x a hit may lie, for each distance 0..g along y, to be within the gap distance; -1: nowhere."""
    far = lambda a, d: STRAIGHT_STEP * abs(a - d) + DIAGONAL_STEP * min(a, d)
    return [max((a for a in range(g + 1) if far(a, d) <= g), default=-1) for d in range(g + 1)]


def _crowded(at: np.ndarray, tile: int, g: int, least: int) -> np.ndarray:
    """Which hits can take part in a fill: all hits in the box of a filled cell lie within 2g of each other, so one with fewer
    than `least` hits in the bins around it (of 2g cells or more, itself included) takes part in none."""
    width = tile + 2 * g
    side = max(2 * g, -(-width // FILL_BINS))
    bins = (width - 1) // side + 1
    own = at // (width * width)
    some = np.flatnonzero(np.bincount(own)[own] >= least)
    there, own = np.unique(own[some], return_inverse=True)
    bx, by = at[some] % (width * width) // width // side, at[some] % width // side
    around = np.zeros((len(there), bins + 2, bins + 2), np.int32)
    around[:, 1:-1, 1:-1] = np.bincount((own * bins + bx) * bins + by, minlength=len(there) * bins * bins).reshape(-1, bins, bins)
    around = around[:, :-2] + around[:, 1:-1] + around[:, 2:]
    around = around[:, :, :-2] + around[:, :, 1:-1] + around[:, :, 2:]
    return some[around[own, bx, by] >= least]


def _sparse(at: np.ndarray, known: np.ndarray, tile: int, g: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places without a hit that are filled, and their values, in work that follows the hits: each reaches all places around it."""
    width, within = tile + 2 * g, _within(g)
    dx, dy = (d.ravel() for d in np.meshgrid(np.arange(-g, g + 1), np.arange(-g, g + 1), indexing="ij"))
    x, y = (at % (width * width) // width)[:, None] + dx, (at % width)[:, None] + dy
    inside = (x >= g) & (x < g + tile) & (y >= g) & (y < g + tile)
    place, where = np.unique((at[:, None] + (dx * width + dy))[inside], return_inverse=True)
    wide = lambda a: np.bincount(where, np.broadcast_to(a, inside.shape)[inside], len(place))
    near, total = np.bincount(where, minlength=len(place)), wide(known[:, None])
    filled = (near >= least) & (wide(np.abs(dx) <= np.array(within)[np.abs(dy)]) > 0) & ~np.isin(place, at)
    return place[filled], total[filled] / near[filled]


def _dense(at: np.ndarray, known: np.ndarray, tile: int, g: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by the arrays of whole tiles, a few tiles at once. Box sum and distance are separable."""
    width, within = tile + 2 * g, _within(g)
    there, own = np.unique(at // (width * width), return_inverse=True)
    inner, shifts = slice(g, g + tile), [(d, slice(g + d, g + d + tile)) for d in range(-g, g + 1)]
    many, found = max(1, FILL_SLOTS // (width * width)), []
    for low in range(0, len(there), many):
        some = (own >= low) & (own < low + many)
        shape = (min(many, len(there) - low), width, width)
        spot = (own[some] - low) * width * width + at[some] % (width * width)
        hit, total = np.zeros(shape, bool), np.zeros(shape)
        hit.reshape(-1)[spot], total.reshape(-1)[spot] = True, known[some]
        # along x first: hits no farther than 0..g, their sum and number in each row, then along y over those
        reach = [hit[:, inner]]
        for d in range(1, g + 1):
            reach.append(reach[-1] | hit[:, g - d:g - d + tile] | hit[:, g + d:g + d + tile])
        near = sum(hit[:, s].astype(np.int32) for _, s in shifts)
        total = sum(total[:, s] for _, s in shifts)
        close = np.zeros((shape[0], tile, tile), bool)
        for d, s in shifts:
            if within[abs(d)] >= 0:
                close |= reach[within[abs(d)]][:, :, s]
        near = sum(near[:, :, s] for _, s in shifts)
        filled = np.nonzero(close & (near >= least) & ~hit[:, inner, inner])
        total = sum(total[:, :, s] for _, s in shifts)[filled]
        found.append(((there[low + filled[0]] * width + filled[1] + g) * width + filled[2] + g, total / near[filled]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (at[:0], known[:0])  # noqa: B905


def _fill(at: np.ndarray, count: np.ndarray, value: np.ndarray, tile: int, g: int, least: int, dense: bool | None = None) -> tuple[np.ndarray, ...]:
    """(place, count, value, filled) of tiles, from the cells in and up to g around each; NaN is no value. A place is
    (tile's number * width + x) * width + y with x and y from 0, g before the tile, and width = tile + 2g. `dense` None:
    each tile in the way that is less work."""
    width = tile + 2 * g
    hits = np.flatnonzero(count > 0)
    known = np.nan_to_num(value[hits])
    crowded = _crowded(at[hits], tile, g, least)
    own = at[hits][crowded] // (width * width)
    few = np.bincount(own)[own] * (2 * g + 1) * SPARSE < width * tile if dense is None else np.full(len(own), not dense)
    found = []
    for some, fill in ((few, _sparse), (~few, _dense)):
        if some.any():
            found.append(fill(at[hits][crowded][some], known[crowded][some], tile, g, least))
    places, values = (np.concatenate(c) for c in zip(*found)) if found else (at[:0], value[:0])  # noqa: B905
    x, y = at % (width * width) // width, at % width
    shown = np.flatnonzero(((count > 0) | ~np.isnan(value)) & (x >= g) & (x < g + tile) & (y >= g) & (y < g + tile))
    # a cell with a value but no hit may be filled as well, and shows the mean then
    shown = shown[(count[shown] > 0) | ~np.isin(at[shown], places)]
    return (np.concatenate([at[shown], places]), np.concatenate([count[shown], np.zeros(len(places), count.dtype)]),
            np.concatenate([value[shown], values]), np.repeat([False, True], [len(shown), len(places)]))


def _one_tile(dense: bool | None):
    def fill(cx: np.ndarray, cy: np.ndarray, count: np.ndarray, value: np.ndarray, x0: int, y0: int, tile: int, g: int, least: int) -> tuple[np.ndarray, ...]:
        """(cx, cy, count, value, filled) of a tile at (x0, y0) from the cells in and up to g around it; NaN is no value."""
        width = tile + 2 * g
        place, *rest = _fill((cx - x0 + g) * width + (cy - y0 + g), count, value, tile, g, least, dense)
        return (place // width + x0 - g, place % width + y0 - g, *rest)
    return fill


fill_tile, fill_sparse, fill_dense = _one_tile(None), _one_tile(False), _one_tile(True)


def _added(at: np.ndarray, parts: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct places, and the sums of the parts there."""
    span = int(at.max(initial=-1)) + 1
    if span <= 32 * len(at):
        places = np.flatnonzero(np.bincount(at, minlength=span))
        return places, [np.bincount(at, p, span)[places] for p in parts]
    places, where = np.unique(at, return_inverse=True)
    return places, [np.bincount(where, p, len(places)) for p in parts]


def _splat_parts(rows: pa.RecordBatch, number: np.ndarray, tile: int, g: int, params: Mosaic) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places that samples add to in their tiles, and what they add: value times weight, weight, 1 for a value, 1 for a hit."""
    width = tile + 2 * g
    v = rows.column("v")
    known = v.is_valid().to_numpy(zero_copy_only=False)
    v = np.where(known, v.to_numpy(zero_copy_only=False), 0.0)
    ux, uy = ((rows.column(c).to_numpy(zero_copy_only=False) + params.half_extent_m) / params.cell_m for c in ("x", "y"))
    tx, ty = (rows.column(c).to_numpy(zero_copy_only=False) * tile - g for c in ("_tx", "_ty"))
    shift = 0.5 if params.bilinear else 0.0
    ix, iy = np.floor(ux - shift), np.floor(uy - shift)
    fx, fy = ux - shift - ix, uy - shift - iy
    hx, hy = np.floor(ux) - ix, np.floor(uy) - iy
    ix, iy = ix.astype(np.int64) - tx, iy.astype(np.int64) - ty
    found = []
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)) if params.bilinear else ((0, 0),):
        w = (fx if dx else 1 - fx) * (fy if dy else 1 - fy) if params.bilinear else np.ones(len(v))
        x, y = ix + dx, iy + dy
        some = np.flatnonzero((w > (params.min_splat_weight if params.bilinear else 0)) & (x >= 0) & (x < width) & (y >= 0) & (y < width))
        w = w[some]
        found.append(((number[some] * width + x[some]) * width + y[some], v[some] * w, w, known[some].astype(np.float64),
                      ((hx[some] == dx) & (hy[some] == dy)).astype(np.float64)))
    at, *parts = (np.concatenate(c) for c in zip(*found, strict=True))
    return at, parts


def _cell_parts(rows: pa.RecordBatch, number: np.ndarray, tile: int, g: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of cells in their tiles, with count and value."""
    x, y = (rows.column(c).to_numpy(zero_copy_only=False) - (rows.column(t).to_numpy(zero_copy_only=False) * tile - g) for c, t in (("cx", "_tx"), ("cy", "_ty")))
    width = tile + 2 * g
    return (number * width + x) * width + y, [rows.column(c).to_numpy(zero_copy_only=False) for c in ("count", "value")]


def _fill_rows(rows: DataFrame, keys: Sequence[str], spots: Sequence[Column], tile: int, g: int, least: int,
               parts: Callable, add: Callable, shown: Callable) -> DataFrame:
    """Deal rows to tiles (`spots`: the tiles along x and y that a row belongs to) and fill those, many tiles at once.

    Rows of a tile come one after the other. Some `FILL_ROWS` of them are put into the cells of their tiles together
    (`parts`, `add`); a tile that goes on is kept as cells, so a task holds neither all rows of a tile nor arrays of many.
    """
    names, width = [*keys, "_tx", "_ty"], tile + 2 * g
    size = width * width
    # any order that keeps tiles together will do; led by a hash, few rows are compared by more than a number
    tiled = (rows.withColumn("_tx", F.explode(spots[0])).withColumn("_ty", F.explode(spots[1]))
             .repartition(*names).sortWithinPartitions(F.xxhash64(*names), *names))
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys]
                          + list(T.StructType.fromDDL("cx long, cy long, count long, value double, filled boolean")))
    target = to_arrow_schema(schema)

    def made(heads: pa.RecordBatch, at: np.ndarray, sums: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, count, value, filled = _fill(at, *shown(*sums), tile, g, least)
        number, x, y = place // size, place % size // width, place % width
        tx, ty = (heads.column(c).to_numpy(zero_copy_only=False) * tile - g for c in ("_tx", "_ty"))
        columns = [tx[number] + x, ty[number] + y, count, value, filled]
        for low in range(0, len(place), FILL_ROWS):
            some = slice(low, low + FILL_ROWS)
            own = [heads.column(k).take(pa.array(number[some])) for k in keys]
            rest = [pa.array(c[some], mask=np.isnan(c[some]) if c.dtype == np.float64 else None) for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, *rest], target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, left = [], 0, None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if not held or (many < FILL_ROWS and batch is not None):
                continue
            block, held, many = pa.concat_batches(held), [], 0
            new = np.zeros(block.num_rows, bool)
            for name in names:
                value = block.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= value[1:] != value[:-1]
            heads = block.select(names).take(pa.array(np.concatenate([[0], np.flatnonzero(new)])))
            at, sums = parts(block, np.cumsum(new))
            if left:
                # the tile that was not over: the first one here, or one of its own
                if left[0].to_pylist() != heads.slice(0, 1).to_pylist():
                    heads, at = pa.concat_batches([left[0], heads]), at + size
                at, sums = np.concatenate([left[1], at]), [np.concatenate(c) for c in zip(left[2], sums, strict=True)]
            at, sums = add(at, sums)
            last = heads.num_rows - 1
            over = at < last * size
            left = heads.slice(last), at[~over] - last * size, [s[~over] for s in sums]
            yield from made(heads, at[over], [s[over] for s in sums])
        if left:
            yield from made(*left)

    return tiled.mapInArrow(run, schema)


def _from_to(a: Column, b: Column) -> Column:
    """The one or two tiles that a row belongs to along an axis."""
    return F.when(a == b, F.array(a)).otherwise(F.array(a, b))


def _gap(params: Mosaic, gaps: GapFill) -> int:
    return max(1, round(gaps.max_gap_m / params.cell_m))


def fill_gaps(rendered: DataFrame, params: Mosaic = Mosaic(), gaps: GapFill = GapFill(), *,
              keys: Sequence[str] = MISSION, tile: int = 256) -> DataFrame:
    """Fill empty cells near data with the mean of the measured cells around them.

    Takes keys, cx, cy, count, value; returns the same with `filled`. A cell is filled when it has
    no hit, lies within the gap distance of a hit cell, and enough hit cells are in the box around
    it. A hit cell with too little weight to be shown counts as 0 in that mean. Cells without a place are left out.

    Cells go to the tile of `tile` by `tile` cells they lie in, and those within the gap distance of
    its border to the tile beyond as well: one shuffle of about (1 + 2 g / tile)^2 rows a cell. Tiles
    are filled many at a time, so that few cells a tile cost little: hits without enough others near
    take part in no fill; the rest are spread hit by hit, or over the arrays of a tile where it has many.
    """
    g = _gap(params, gaps)
    keys, tile = list(keys), max(tile, 2 * g + 1)
    spots = [_from_to(*[F.floor((F.col(c) + d) / tile) for d in (-g, g)]) for c in ("cx", "cy")]
    rows = rendered.select(*keys, F.col("cx").cast("long"), F.col("cy").cast("long"), F.col("count").cast("long"), F.col("value").cast("double")).filter("cx is not null and cy is not null")
    return _fill_rows(rows, keys, spots, tile, g, gaps.min_neighbors, lambda block, number: _cell_parts(block, number, tile, g),
                      lambda at, sums: (at, sums), lambda count, value: (count, value))


def filled_mosaic(samples: DataFrame, params: Mosaic = Mosaic(), gaps: GapFill = GapFill(), *,
                  keys: Sequence[str] = MISSION, tile: int = FILL_TILE) -> DataFrame:
    """`fill_gaps` of the average cells of samples (`mosaic`, `render`) in one shuffle: samples go to the tiles whose cells, or
    cells within the gap distance, they add to, and are splatted and filled there. No cell is shuffled. Samples without a
    place (NULL or NaN) are left out."""
    g = _gap(params, gaps)
    keys, tile = list(keys), max(tile, 2 * g + 1)
    # of the cells a sample adds to, the first one along an axis, and how many there are beyond it
    first, more = (0.5, 1) if params.bilinear else (0.0, 0)
    low = [F.floor((F.col(c) + params.half_extent_m) / params.cell_m - first) for c in ("x", "y")]
    spots = [_from_to(F.floor((c - g) / tile), F.floor((c + more + g) / tile)) for c in low]
    rows = samples.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")]).filter("not isnan(x) and not isnan(y) and x is not null and y is not null")

    def shown(total, weight, known, hits):
        seen = (weight >= params.min_shown_weight) & (known > 0)
        return hits.astype(np.int64), np.divide(total, weight, out=np.full(len(total), np.nan), where=seen)

    return _fill_rows(rows, keys, spots, tile, g, gaps.min_neighbors, lambda block, number: _splat_parts(block, number, tile, g, params), _added, shown)


def tile_cells(cells: DataFrame, origin: Column, zoom: Column, params: Mosaic = Mosaic()) -> DataFrame:
    """Add the slippy-tile key (z, tile_x, tile_y) of every cell centre; `origin` as in `geodesy.local_to_gps`."""
    gps = geodesy.local_to_gps(origin, cell_center(F.col("cx"), params), cell_center(F.col("cy"), params))
    at = geodesy.tile_xy(gps["lat"], gps["lon"], zoom)
    return cells.withColumns({"z": zoom, "tile_x": F.floor(at["x"]), "tile_y": F.floor(at["y"])})


def merge_cells(partial: DataFrame, *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Cells from partially combined cells (the output of `raster.densify`, or of earlier runs)."""
    at = {p: (F.col(f"{p}_ping"), F.col(f"{p}_sample")) for p in ("closest", "oldest", "newest")}
    order = {"closest": nearness_key(F.col("closest_near"), *at["closest"]), "oldest": place_key(-at["oldest"][0], at["oldest"][1]), "newest": place_key(*at["newest"])}
    return partial.groupBy(*keys, "cx", "cy").agg(
        F.sum("sum").alias("sum"), F.sum("wsum").alias("wsum"), F.sum("count").alias("count"),
        *[F.max_by(p, by).alias(p) for p, by in order.items()])
