"""Exact largest inner products through a pivot-distance index (operator 3).

Vectors become integers (`floor(scale * x)`). With one more coordinate, `sqrt(M - |x|^2)` for the largest squared norm M, the
largest inner products with q are the nearest points of (q, 0). The index keys every vector by its nearest pivot and an
annulus of the distance to it; an annulus keeps its exact smallest and largest distance. A query orders annuli by the lower
bound that the triangle inequality gives and scans them in rounds, each eight times as many rows as the last; it stops when
the next bound cannot beat its k-th best score. All scores are integers, so results are exact.

Pivots come from at most `SAMPLE` vectors (those with the smallest hash of their id) by farthest-first traversal; every vector
is indexed. Annuli are cut into blocks of about `BLOCK` rows, queries into blocks of about `QUERIES`: a task holds one of each,
however many equal vectors there are. Broadcast are the pivots and one row per annulus, at most `PIVOTS * RINGS` rows.

Null vectors, and those that hold null, NaN or infinite components, take no part, nor do null ids. Vectors of different
lengths are compared as if the shorter had zeros. Ties go to the smaller id. A row never meets rows of its own id; other
repeated rows each count. Query rows that share an id are searched each on its own and then share one list of `k`. Vectors
whose squared norm does not fit `2**62` raise an error, as their products would not fit 64 bits. An empty table gives no rows. Extra
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm.frames import arrow, column, stored

SAMPLE, PIVOTS, RINGS = 4096, 64, 16
BLOCK, QUERIES = 2048, 4096
FIRST, GROWTH = 512, 8
_SLACK = 1e-9


def _matrix(column_: pa.Array, width: int) -> np.ndarray:
    rows = [np.frombuffer(x, np.int64) for x in column_.to_pylist()]
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum is an exact integer."""
    largest = float(np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0)))
    if largest < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def integers(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, v: 64-bit integers, norm, width) of the vectors that take part."""
    def make():
        def step(batch):
            ids, lists = column(batch, "id"), column(batch, "v")
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(size)])
            whole = np.floor(flat.astype(np.float64) * scale)
            square = np.concatenate([[0.0], np.cumsum(whole * whole)])
            if np.abs(whole).max(initial=0) > 2.0**31 or (square[cut[1:]] - square[cut[:-1]]).max(initial=0) > 2.0**62:
                raise ValueError(f"a vector times {scale} is too large for products of 64 bits")
            whole = whole.astype(np.int64)
            rows = [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield {"id": ids, "v": [r.tobytes() for r in rows], "norm": [int(r @ r) for r in rows], "width": size}
        return step

    value = F.col(vector)
    finite = value.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(finite).select(F.col(id_column).cast("long").alias("id"), value.cast("array<double>").alias("v"))
    return arrow(rows, make, "id long, v binary, norm long, width int")


def _pivots(rows: DataFrame, width: int, top: float) -> np.ndarray:
    sample = _lifted(_matrix(pa.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], pa.binary()), width), top)
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _plan(query: np.ndarray, norms: np.ndarray, pivots: np.ndarray, cells: dict, top: float):
    """Per query the cells by falling bound on the inner product, and those bounds."""
    d = _distances(np.column_stack([query.astype(np.float64), np.zeros(len(query))]), pivots)[:, cells["pivot"]]
    low = np.maximum(0, np.maximum(d - cells["far"], cells["near"] - d) * (1 - _SLACK) - _SLACK * (1 + d))
    bound = (norms[:, None] + top - low * low) / 2 + 1e-6 * (1 + top)
    order = np.argsort(-bound, axis=1, kind="stable")
    return order, np.take_along_axis(bound, order, axis=1)


def search(vectors: DataFrame, queries, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each row for which the column expression `queries` holds."""
    spark = vectors.sparkSession
    rows = stored(integers(vectors, id_column, vector, scale), "vectors")
    top, width, _ = rows.agg(F.max("norm"), F.max("width"), F.count("*")).first()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if top is None:
        return spark.createDataFrame([], out_schema)
    width, top = int(width), float(top)
    pivots = spark.sparkContext.broadcast(_pivots(rows, width, top))

    def assign():
        def step(batch):
            d = _distances(_lifted(_matrix(column(batch, "v"), width), top), pivots.value)
            nearest = d.argmin(axis=1)
            yield {"id": column(batch, "id"), "v": column(batch, "v"), "pivot": nearest.astype(np.int32), "d": d[np.arange(len(d)), nearest]}
        return step

    keyed = stored(arrow(rows.select("id", "v"), assign, "id long, v binary, pivot int, d double"), "keyed")
    spread = keyed.groupBy("pivot").agg(F.min("d").alias("from"), F.max("d").alias("to"))
    ring = F.least(F.lit(RINGS - 1), F.floor(F.try_divide(F.col("d") - F.col("from"), F.col("to") - F.col("from")) * RINGS)).cast("int")
    keyed = keyed.join(spread, "pivot").withColumn("cell", F.col("pivot") * RINGS + F.coalesce(ring, F.lit(0))).drop("from", "to")
    stats = sorted(keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).collect())  # at most PIVOTS * RINGS
    n = np.array([s.n for s in stats], np.int64)
    cells = {"cell": np.array([s.cell for s in stats]), "n": n, "blocks": -(-n // BLOCK), "pivot": np.array([s.cell // RINGS for s in stats]),
             "near": np.array([s.near for s in stats]), "far": np.array([s.far for s in stats])}
    known = spark.sparkContext.broadcast(cells)
    counts = spark.createDataFrame([(int(c), int(b)) for c, b in zip(cells["cell"], cells["blocks"], strict=True)], "cell int, blocks long")
    indexed = stored(keyed.join(counts, "cell").select("cell", F.pmod(F.xxhash64("id", "d"), F.col("blocks")).cast("int").alias("block"), "id", "v"), "index")

    chosen = rows.join(vectors.filter(queries).select(F.col(id_column).cast("long").alias("id")).distinct(), "id", "left_semi")
    total = chosen.count()
    parts = max(1, -(-total // QUERIES))
    state = stored(chosen.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("query_id"), "v", "norm", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("upto"),
                                 F.lit(False).alias("done"), F.array().cast("array<struct<score:bigint,vec_id:bigint>>").alias("best")), "queries")
    budget = FIRST

    while state.filter("not done").limit(1).count():
        def expand(budget=budget):
            def step(batch):
                cells, query = known.value, _matrix(column(batch, "v"), width)
                order, bound = _plan(query, column(batch, "norm").to_numpy().astype(np.float64), pivots.value, cells, top)
                upto, best = column(batch, "upto").to_numpy(), column(batch, "best").to_pylist()
                out = {c: [] for c in ("cell", "block", "last", "done")}
                for i in range(len(query)):
                    least = best[i][k - 1]["score"] if len(best[i]) >= k else -np.inf
                    open_ = int(np.searchsorted(-bound[i], -least, "right"))  # cells whose bound reaches the k-th score
                    size = np.cumsum(cells["n"][order[i, upto[i]:]])
                    last = min(open_, int(upto[i]) + int(np.searchsorted(size, budget)) + 1)
                    take = order[i, upto[i]:max(last, upto[i])]
                    blocks = cells["blocks"][take]
                    out["cell"].append(np.repeat(cells["cell"][take], blocks).tolist())
                    out["block"].append([b for x in blocks.tolist() for b in range(x)])
                    out["last"].append(max(last, int(upto[i])))
                    out["done"].append(last >= open_)  # what is left cannot reach the k-th score
                yield {c: column(batch, c) for c in ("row", "query_id", "v", "norm", "part", "best")} | out
            return step

        planned = stored(arrow(state.filter("not done"), expand, "row long, query_id long, v binary, norm long, part int, best array<struct<score:bigint,vec_id:bigint>>, "
                               "cell array<int>, block array<int>, last int, done boolean"), "planned")
        wanted = planned.select("row", "query_id", "v", "part", F.explode(F.arrays_zip("cell", "block")).alias("x")).select("row", "query_id", "v", "part", "x.cell", "x.block")
        keys = ("cell", "block", "part")
        # only blocks that some query wants leave the index, once for each block of queries that wants them
        offered = indexed.join(wanted.select(*keys).distinct().toDF(*keys), ["cell", "block"])

        def scan(left, right):
            found = {c: [] for c in ("row", "vec_id", "score")}
            if left.num_rows and right.num_rows:
                ids, names, rows = right["id"].to_numpy(), left["query_id"].to_numpy(), left["row"].to_numpy()
                scores = _products(_matrix(left["v"].combine_chunks(), width), _matrix(right["v"].combine_chunks(), width))
                for i, name in enumerate(names):
                    others = np.flatnonzero(ids != name)
                    at = others[_best(scores[i, others], ids[others], k)]
                    found["row"] += [rows[i]] * len(at)
                    found["vec_id"] += ids[at].tolist()
                    found["score"] += scores[i, at].tolist()
            return pa.table({c: pa.array(x, pa.int64()) for c, x in found.items()})

        found = wanted.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(scan, "row long, vec_id long, score long")
        merged = found.groupBy("row").agg(F.collect_list(F.struct("score", "vec_id")).alias("new"))
        ranked = F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array())), lambda x, y: F.when(x.score != y.score, F.when(x.score > y.score, -1).otherwise(1)).otherwise(
            F.when(x.vec_id < y.vec_id, -1).when(x.vec_id > y.vec_id, 1).otherwise(0))), 1, k)
        after = planned.join(merged, "row", "left").select("row", "query_id", "v", "norm", "part", F.col("last").alias("upto"), "done", ranked.alias("best"))
        state = stored(after.unionByName(state.filter("done").select(*after.columns)), "queries")
        budget *= GROWTH

    first = Window.partitionBy("query_id").orderBy(F.col("x.score").desc(), "x.vec_id")
    ranks = state.select("query_id", F.explode("best").alias("x")).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranks.select("query_id", "rank", F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
