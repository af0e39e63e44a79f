"""Queries over geo-referenced samples: cells, policies, contrast, gaps, colours, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.config import Mosaic
from fathomgrid.operators import display
from fathomgrid.operators import mosaic as grid
from fathomgrid.plans import tables
from fathomgrid.plans.catalog import CELLS, NEAREST_CELLS, R, query, r6, with_

SCATTER = Mosaic(bilinear=False)
ORIGIN = (43.69, 7.30)


def _amplitude(value):
    """Mean intensity on a linear scale: means in dB are fractions of 4e-6 and would tie when rounded."""
    amplitude = F.pow(F.lit(10.0), value / 20)
    steps = amplitude * 1e9
    # in whole steps, as SQL rounds; Spark's own rounding goes by decimal text and takes most of a gap-filled cell's time
    return F.when(steps < 2.0 ** 51, F.floor(steps + 0.5) / 1e9).otherwise(F.round(amplitude, 9)).alias("amplitude")


def _cells(spark, d):
    return grid.mosaic(tables.samples(spark, d))


def _shown(spark, d):
    """Average cells; no policy columns are asked for, so none are computed."""
    return grid.render(grid.mosaic(tables.samples(spark, d), policies=()))


@query(with_(NEAREST_CELLS, f"SELECT mission_id, cx, cy, {R('avg(v)', 'mean', 8)}, count(*) AS n FROM n GROUP BY mission_id, cx, cy"))
def mosaic_mean(spark, d):
    """Eight decimals: intensities are multiples of 4e-6, so means of few of them tie at six."""
    cells = grid.mosaic(tables.samples(spark, d), SCATTER, policies=())
    return cells.select("mission_id", "cx", "cy", r6(F.col("sum") / F.col("wsum"), "mean", 8), F.col("count").alias("n"))


@query(with_(CELLS, f"SELECT mission_id, cx, cy, count, {R('closest')}, {R('oldest')}, {R('newest')} FROM hits"))
def mosaic_planes(spark, d):
    cells = grid.mosaic(tables.samples(spark, d), SCATTER)
    return cells.select("mission_id", "cx", "cy", "count", r6("closest"), r6("oldest"), r6("newest"))


@query(with_(CELLS, f"SELECT mission_id, cx, cy, count, {R('sum', digits=8)}, {R('wsum')}, {R('pow(10e0, value / 20)', 'amplitude', 9)}, {R('closest')}, {R('oldest')}, {R('newest')} FROM cells"))
def mosaic_splat(spark, d):
    cells = _cells(spark, d)
    return cells.select("mission_id", "cx", "cy", "count", r6("sum", digits=8), r6("wsum"), _amplitude(grid.shown_value("average")),
                        r6("closest"), r6("oldest"), r6("newest"))


@query(with_(CELLS, f"SELECT mission_id, cx, cy, count, {R('closest', 'value')} FROM cells WHERE closest IS NOT NULL"))
def mosaic_render_closest(spark, d):
    cells = grid.mosaic(tables.samples(spark, d), policies=("closest",))
    return grid.render(cells, "closest").filter("value is not null").select("mission_id", "cx", "cy", "count", r6("value"))


@query(with_(CELLS, f"""SELECT mission_id, {R('min(cx) * 0.25e0 - 30e0', 'xmin')}, {R('(max(cx) + 1) * 0.25e0 - 30e0', 'xmax')},
{R('min(cy) * 0.25e0 - 30e0', 'ymin')}, {R('(max(cy) + 1) * 0.25e0 - 30e0', 'ymax')}, max(cx) - min(cx) + 1 AS columns, max(cy) - min(cy) + 1 AS rows,
count(*) AS occupied, {R('100e0 * count(*) / ((max(cx) - min(cx) + 1) * (max(cy) - min(cy) + 1))', 'coverage_pct')} FROM hits GROUP BY mission_id"""))
def coverage(spark, d):
    out = grid.extent(grid.mosaic(tables.samples(spark, d), SCATTER, policies=()))
    return out.select("mission_id", r6("xmin"), r6("xmax"), r6("ymin"), r6("ymax"), "columns", "rows", "occupied", r6("coverage_pct"))


LIMITS = CELLS + """,
lim AS (SELECT mission_id, quantile_cont(value, 0.02) AS vmin, quantile_cont(value, 0.98) AS vmax FROM cells GROUP BY mission_id)"""


@query(with_(LIMITS, f"SELECT mission_id, {R('vmin')}, {R('vmax')} FROM lim"))
def contrast_limits(spark, d):
    return grid.contrast_limits(_shown(spark, d)).select("mission_id", r6("vmin"), r6("vmax"))


NORM = LIMITS + """,
nv AS (SELECT mission_id, cx, cy, value, CASE WHEN value IS NOT NULL THEN greatest(0e0, least(1e0, (value - vmin) / (vmax - vmin))) END AS u FROM cells JOIN lim USING (mission_id))"""


@query(with_(NORM, "SELECT mission_id, cx, cy, coalesce(CAST(trunc(u * 255) AS INTEGER), 0) AS pixel FROM nv"))
def normalize_8bit(spark, d):
    joined = grid.with_limits(_shown(spark, d))
    return joined.select("mission_id", "cx", "cy", display.to_8bit(F.col("value"), F.col("vmin"), F.col("vmax")).alias("pixel"))


def _ramp(*channels) -> str:
    """SQL rows (i, r, g, b) of a palette: a table of its 256 levels."""
    rows = []
    for i in range(256):
        x = i * (1.0 / 255)
        rows.append((i, *[int(min(1.0, max(0.0, slope * x + offset)) * 255) for slope, offset in channels]))
    return "(VALUES " + ", ".join(map(str, rows)) + ") p(i, r, g, b)"


@query(with_(NORM + """,
ix AS (SELECT *, CASE WHEN u IS NULL THEN 0 ELSE CAST(trunc(greatest(0e0, least(1e0, pow(u, 0.8e0) + 0.1e0)) * 255) AS INTEGER) END AS i FROM nv)""",
             f"SELECT mission_id, cx, cy, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CASE WHEN value IS NULL THEN 0 ELSE 255 END AS a "
             f"FROM ix JOIN {_ramp((1.6, 0.0), (1.15, -0.05), (0.9, -0.35))} USING (i)"))
def display_rgba(spark, d):
    joined = grid.with_limits(_shown(spark, d))
    settings = display.Display(gamma=0.8, brightness=0.1, colormap="Gold")
    return display.colourise(joined, settings).select("mission_id", "cx", "cy", "r", "g", "b", "a")


@query(with_(NEAREST_CELLS, f"""SELECT mission_id, cx, cy, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, 255 AS a FROM (
SELECT mission_id, cx, cy, CAST(trunc(greatest(0e0, least(1e0, (arg_max(v, row(ping_seq, sample_idx)) - -55e0) / (-25e0 - -55e0))) * 255) AS INTEGER) AS i
FROM n GROUP BY mission_id, cx, cy) JOIN {_ramp((1.25, 0.0), (0.7812, 0.0), (0.4975, 0.0))} USING (i)"""))
def display_manual_range(spark, d):
    cells = grid.render(grid.mosaic(tables.samples(spark, d), SCATTER, policies=("newest",)), "newest", SCATTER)
    settings = display.Display(auto_range=False, vmin_db=-55.0, vmax_db=-25.0)
    return display.colourise(cells, settings).select("mission_id", "cx", "cy", "r", "g", "b", "a")


GAPS = CELLS + """,
ax AS (SELECT mission_id, cx + dx AS cx, cy, sum(coalesce(value, 0e0)) AS total, count(*) AS k, min(abs(dx)) AS ax
  FROM cells, (SELECT unnest(range(-3, 4)) AS dx) WHERE count > 0 GROUP BY mission_id, cx + dx, cy),
near AS (SELECT mission_id, cx, cy + dy AS cy, sum(total) AS total, sum(k) AS k, min(0.955e0 * abs(ax - abs(dy)) + 1.3693e0 * least(ax, abs(dy))) AS dist
  FROM ax, (SELECT unnest(range(-3, 4)) AS dy) GROUP BY mission_id, cx, cy + dy),
fill AS (SELECT n.mission_id, n.cx, n.cy, total / k AS fv FROM near n LEFT JOIN hits h USING (mission_id, cx, cy)
  WHERE h.count IS NULL AND n.dist <= 3 AND n.k >= 3)"""


@query(with_(GAPS, f"""SELECT coalesce(c.mission_id, f.mission_id) AS mission_id, coalesce(c.cx, f.cx) AS cx, coalesce(c.cy, f.cy) AS cy,
coalesce(c.count, 0) AS count, {R('pow(10e0, coalesce(f.fv, c.value) / 20)', 'amplitude', 9)}, f.fv IS NOT NULL AS filled
FROM (SELECT * FROM cells WHERE count > 0 OR value IS NOT NULL) c FULL JOIN fill f ON f.mission_id = c.mission_id AND f.cx = c.cx AND f.cy = c.cy"""))
def gap_fill(spark, d):
    return grid.filled_mosaic(tables.samples(spark, d)).select("mission_id", "cx", "cy", "count", _amplitude(F.col("value")), "filled")


TILES = CELLS + """,
ll AS (SELECT 43.69e0 + degrees(((cy + 0.5e0) * 0.25e0 - 30e0) / 6378137e0) AS lat,
  7.30e0 + degrees(((cx + 0.5e0) * 0.25e0 - 30e0) / (6378137e0 * cos(radians(43.69e0)))) AS lon FROM hits),
tl AS (SELECT 19 AS z, CAST(floor((lon + 180e0) / 360e0 * pow(2e0, 19)) AS BIGINT) AS tile_x,
  CAST(floor((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * pow(2e0, 19)) AS BIGINT) AS tile_y FROM ll)"""


def _tiles(spark, d):
    lat, lon = ORIGIN
    origin = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    cells = grid.mosaic(tables.samples(spark, d), SCATTER, policies=())
    return grid.tile_cells(cells, origin, F.lit(19)).groupBy("z", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("cells"))


@query(with_(TILES, "SELECT z, tile_x, tile_y, count(*) AS cells FROM tl GROUP BY z, tile_x, tile_y"))
def tile_counts(spark, d):
    return _tiles(spark, d)


@query(with_(TILES, "SELECT z, tile_x, tile_y, count(*) AS cells FROM tl GROUP BY z, tile_x, tile_y ORDER BY z, tile_x, tile_y LIMIT 96"))
def tile_update(spark, d):
    """Tiles requested per view update: column by column, at most 96."""
    return _tiles(spark, d).orderBy("z", "tile_x", "tile_y").limit(96)
