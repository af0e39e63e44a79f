"""Queries against their SQL on repeated tables: more rows a mission, and equal stamps."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import check
from fathomgrid.config import Mosaic, Tracking
from fathomgrid.operators import mosaic, raster
from fathomgrid.operators.sequential import lock_altitude

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Some 900 pings a mission, and three events at every stamp, of which many are of one mission."""
    folder = str(tmp_path_factory.mktemp("copies"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (i AS vec_id) FROM range(9000) r(i) JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM '{SF}/embeddings.parquet') e "
                f"ON k = i % (SELECT count(*) FROM '{SF}/embeddings.parquet')) TO '{folder}/embeddings.parquet'")
    con.execute(f"""COPY (SELECT * REPLACE (event_id * 3 + r AS event_id, user_id // 10 * 10 + event_id % 2 AS user_id,
        CASE WHEN r = 0 THEN event_type WHEN r = 1 THEN 'view' ELSE CASE WHEN event_id % 3 = 0 THEN 'signup' ELSE 'click' END END AS event_type)
        FROM '{SF}/events.parquet', range(3) t(r)) TO '{folder}/events.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["image_windows", "gps_reckon", "pinger_world"])
def test_query_on_copies(spark, copies, name):
    assert sorted(os.listdir(copies)) == ["embeddings.parquet", "events.parquet"]
    result = check.compare(spark, check.oracle(copies), name, copies)
    assert result.startswith("ok"), result


def test_lock_starts_at_the_plain_mean():
    """Added oldest first, in doubles: another rounding would move a sample over the altitude."""
    found = [i / 63 * 30000 / 1000 for i in (16, 13, 19)]
    out, _ = lock_altitude(np.array(found), Tracking(bootstrap_pings=3, agreement_m=3.0))
    assert out[-1] == (found[0] + found[1] + found[2]) / 3 and (found[0] + found[1] + found[2]) / 3 != found[0]


@pytest.mark.parametrize("share", [0.002, 0.02, 0.4])
def test_gaps_of_tiles_with_few_cells(share):
    """Work that follows the cells gives what the arrays of a whole tile give, and is taken where it is less."""
    tile, g, rng = 64, 3, np.random.default_rng(7)
    width = tile + 2 * g
    for x0, y0 in ((0, 0), (-64, 128)):
        code = rng.choice(width * width, int(width * width * share), replace=False)
        cells = (code // width + x0 - g, code % width + y0 - g, rng.integers(0, 3, len(code)), np.where(rng.random(len(code)) < 0.2, np.nan, rng.normal(-40, 5, len(code))))
        found = [sorted(zip(*(c.tolist() for c in way), strict=True)) for way in (
            mosaic.fill_tile(*cells, x0, y0, tile, g, 3), mosaic.fill_sparse(*cells, x0, y0, tile, g, 3), mosaic.fill_dense(*cells, x0, y0, tile, g, 3))]
        assert all(repr([(x, y, n, f) for x, y, n, _, f in way]) == repr([(x, y, n, f) for x, y, n, _, f in found[0]]) for way in found)
        assert all(np.allclose([r[3] for r in way], [r[3] for r in found[0]], rtol=1e-12, equal_nan=True) for way in found)


def test_gaps_of_scattered_tiles_are_cheap(monkeypatch):
    """Tiles with a handful of cells don't make a tile's arrays."""
    monkeypatch.setattr(mosaic, "fill_dense", None)
    one = [np.array([0, 2, 4]), np.array([0, 2, 0]), np.ones(3, np.int64), np.array([-10.0, -20.0, -30.0])]
    x, y, count, value, filled = mosaic.fill_tile(*one, 0, 0, 256, 3, 3)
    assert filled.sum() > 0 and np.allclose(value[filled], -20.0) and count.sum() == 3


@pytest.mark.parametrize("name", ["normalize_8bit", "display_rgba", "contrast_limits"])
def test_cells_are_not_gathered_by_mission(spark, name):
    """Three missions must not be three tasks: limits come to the cells, even where Spark doesn't know how few they are."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin [mission_id" in plan


def test_pings_are_densified_in_bounded_runs(monkeypatch):
    """A batch of pings is not put on even grids all at once, and runs give the same cells."""
    n, wide, rng = 1500, 100, np.random.default_rng(3)
    offsets, lateral = pa.array(np.arange(n + 1) * wide, pa.int32()), np.tile(np.linspace(-30, 30, wide), n)
    fields = {"robot_x": pa.array(np.arange(n) * 0.2), "robot_y": pa.array(rng.normal(size=n)), "yaw": pa.array(np.zeros(n)),
              "y_local": pa.ListArray.from_arrays(offsets, pa.array(lateral)), "intensity_db": pa.ListArray.from_arrays(offsets, pa.array(rng.normal(-40, 5, n * wide)))}
    before = [x.take(pa.array(np.maximum(np.arange(n) - 1, 0))) for x in fields.values()]
    prev = pa.StructArray.from_arrays(before, names=list(fields), mask=pa.array(np.arange(n) % 100 == 0))
    batch = pa.RecordBatch.from_pydict({"mission_id": pa.array(np.zeros(n, np.int64)), "seq": pa.array(np.arange(n)), **fields, "prev": prev})
    target = pa.schema([("mission_id", pa.int64()), ("ping_seq", pa.int64()), ("sample_idx", pa.int32()), *[(c, pa.float64()) for c in ("x", "y", "v", "rng")]])
    rows, whole = [], raster._samples

    def watched(some, *args):
        rows.append(some.num_rows)
        return whole(some, *args)

    def samples():
        return pa.Table.from_batches(raster._emit(("mission_id",), Mosaic(), target, False, False)(iter([batch])))

    monkeypatch.setattr(raster, "_samples", watched)
    got = samples()
    assert sum(rows) == n and max(rows) * wide <= raster.RUN_SAMPLES + wide
    monkeypatch.setattr(raster, "_runs", lambda batch: [(0, batch)])
    want = samples()
    assert got.num_rows == want.num_rows and all(np.allclose(got[c], want[c], rtol=1e-6, atol=1e-9) for c in target.names)


def test_gaps_of_samples_in_one_shuffle(spark, monkeypatch):
    """Straight from samples, in blocks that cut tiles in pieces: what gap filling makes of the cells."""
    rng, n = np.random.default_rng(11), 900
    near = np.concatenate([rng.uniform(-40, 40, (n, 2)), rng.uniform(-17, -13, (n, 2)), np.full((40, 2), 2.0)])
    rows = [(None if m == 2 else f"m{m}", i, 0, float(x), float(y), float(v) if rng.random() < 0.9 else None, 1.0)
            for i, ((x, y), m, v) in enumerate(zip(near, rng.integers(0, 3, len(near)), rng.normal(-40, 5, len(near)), strict=True))]
    rows += [("m0", -1, 0, None, 1.0, 1.0, 1.0), ("m0", -2, 0, 1.0, None, 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "mission_id string, ping_seq long, sample_idx int, x double, y double, v double, rng double")
    plan = entry.queries()["gap_fill"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan

    def found(df):
        return {(r.mission_id, r.cx, r.cy): (r["count"], r.value, r.filled) for r in df.collect()}

    for bilinear in (True, False):
        params = Mosaic(bilinear=bilinear)
        want = found(mosaic.fill_gaps(mosaic.render(mosaic.mosaic(samples, params, policies=()), "average", params), params))
        assert sum(filled for *_, filled in want.values()) > 500 and any(v is None for _, v, _ in want.values())
        for rows_at_once, tile in ((7, 1), (50, 64), (1 << 16, 200)):
            monkeypatch.setattr(mosaic, "FILL_ROWS", rows_at_once)
            got = found(mosaic.filled_mosaic(samples, params, tile=tile))
            assert got.keys() == want.keys()
            for k, (count, value, filled) in want.items():
                assert got[k] == (count, None if value is None else pytest.approx(value, rel=1e-9), filled)


def test_scattered_tiles_are_filled_together(monkeypatch):
    """A few hits in each of many tiles: no array of a tile, no step a tile, and no work for hits that lie alone."""
    tile, g, n, rng = 64, 3, 20_000, np.random.default_rng(2)
    width = tile + 2 * g
    at = np.unique(np.arange(n).repeat(3) * width * width + rng.integers(0, width * width, 3 * n))
    at = np.concatenate([at, n * width * width + np.array([10, 12, 14]) * width + 20])
    reached, sparse = [], mosaic._sparse
    monkeypatch.setattr(mosaic, "_dense", None)
    monkeypatch.setattr(mosaic, "_sparse", lambda at, *rest: (reached.append(len(at)), sparse(at, *rest))[1])
    place, count, value, filled = mosaic._fill(at, np.ones(len(at), np.int64), np.full(len(at), -20.0), tile, g, 3)
    assert len(reached) == 1 and 3 <= reached[0] < len(at) // 10
    assert filled[place >= n * width * width].sum() > 0 and np.allclose(value, -20.0) and count.sum() <= len(at)


def test_densified_samples_take_little_beside_their_values(spark, tmp_path):
    """Three doubles a row can't be packed; sample numbers, pings and ranges can."""
    import pyarrow.parquet as pq

    entry.queries()["virtual_pings"](spark, SF).coalesce(1).write.parquet(f"{tmp_path}/out")
    (file,) = tmp_path.glob("out/*.parquet")
    found, size = pq.ParquetFile(file).metadata, {}
    for i in range(found.num_row_groups):
        for column in (found.row_group(i).column(j) for j in range(found.num_columns)):
            size[column.path_in_schema] = size.get(column.path_in_schema, 0) + column.total_compressed_size / found.num_rows
    assert found.num_rows > 1_000_000 and all(7 < size[c] < 9 for c in ("x", "y", "v"))
    assert sum(size[c] for c in ("mission_id", "ping_seq", "sample_idx", "rng")) < 0.6
