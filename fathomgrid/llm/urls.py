"""URL filter: rules first, then the ratio of two character language models (operator 9).

A rule is a host and a path; it fits its host and all subdomains if the URL's path starts with the rule's. The longest fitting
rule decides. Pages that a rule decides are the examples: two variable-order Markov models of URL bytes are counted, of
accepted and of rejected pages, each order smoothed into the next by Witten-Bell weights (a context that was never seen falls
back to the shorter one). The score is the log-likelihood under the rejected model minus that under the accepted one, divided
by the number of bytes. One fold in five is left out of the counts; the threshold is the largest score that at most
`false_block` of its accepted pages exceed, and never below 0.

Counts are taken in each task and summed by Spark, under the bytes of the n-grams themselves: none share a counter. Models of
at most `MODEL_ROWS` n-grams and contexts are broadcast as sorted arrays. Larger ones stay a table: the distinct n-grams of
every few thousand pages (`b`) meet it in joins, and their scores go back to those pages. Rules are a short list given by
the caller.

A null URL, or one without `://`, has an empty host and path and meets no rule; null and empty URLs score 0 and are allowed.
Without examples of both kinds every score is 0. Repeated rows are each judged. Extra columns are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.frames import Shared, arrow, column, stored

ORDER, FOLDS = 6, 5
MODEL_ROWS = 1 << 20
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. Rules are (verdict, "host/path")."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the packed n-gram of ORDER bytes that ends there (zeros before the start), and bytes per URL."""
    sizes = np.array([len(u) for u in urls], np.int64)
    flat = np.frombuffer(b"".join(urls), np.uint8).astype(np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = flat.copy()
    for j in range(1, ORDER):
        keys[j:] |= np.where(place[j:] >= j, flat[:-j], 0) << np.uint64(8 * j)
    return keys, sizes


def _level(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    gram = keys & np.uint64((1 << 8 * n) - 1)
    return gram, gram >> np.uint64(8)


class Model:
    """Per order: sorted n-grams with counts, sorted contexts with totals and numbers of types."""

    def __init__(self, rows: pa.Table):
        order, key, c, types = (rows.column(name).to_numpy() for name in ("n", "key", "c", "types"))
        self.grams, self.contexts = {}, {}
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(order == n)
            at = at[np.argsort(key[at])]
            self.grams[n] = key[at].astype(np.uint64), c[at].astype(np.float64)
            at = np.flatnonzero(order == -n)
            at = at[np.argsort(key[at])]
            self.contexts[n] = key[at].astype(np.uint64), c[at].astype(np.float64), types[at].astype(np.float64)

    @staticmethod
    def _find(table, keys):
        names, *values = table
        if not len(names):
            return [np.zeros(len(keys)) for _ in values]
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        hit = names[at] == keys
        return [np.where(hit, v[at], 0.0) for v in values]

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for n in range(1, ORDER + 1):
            gram, context = _level(keys, n)
            (count,), (total, types) = self._find(self.grams[n], gram), self._find(self.contexts[n], context)
            p = np.where(total > 0, (np.minimum(count, total) + types * p) / np.maximum(total + types, 1), p)
        return np.log(np.minimum(p, 1.0))


def _count(examples: DataFrame) -> DataFrame:
    """One row per verdict, order n (contexts: -n) and n-gram: count and number of types."""
    def run(batches):
        held: dict[tuple, dict] = {}
        for batch in batches:
            verdicts, urls = np.array(batch.column(0).to_pylist(), object), [u.encode() for u in batch.column(1).to_pylist()]
            for verdict in set(verdicts):
                keys, times = np.unique(_grams([u for u, v in zip(urls, verdicts, strict=True) if v == verdict])[0], return_counts=True)
                known, seen = held.get(verdict, (keys[:0], times[:0]))
                every, back = np.unique(np.concatenate([known, keys]), return_inverse=True)
                held[verdict] = every, np.bincount(back, np.concatenate([seen, times]), len(every)).astype(np.int64)
        for verdict, (keys, times) in held.items():
            yield pa.RecordBatch.from_pydict({"verdict": pa.array([verdict] * len(keys), pa.string()), "key": pa.array(keys.view(np.int64)), "c": pa.array(times)})

    top = stored(examples.select("verdict", "u").mapInArrow(run, "verdict string, key long, c long").groupBy("verdict", "key").agg(F.sum("c").alias("c")), "url_grams")
    parts = []
    for n in range(1, ORDER + 1):
        level = top.groupBy("verdict", F.col("key").bitwiseAND((1 << 8 * n) - 1).alias("key")).agg(F.sum("c").alias("c")) if n < 8 else top
        parts.append(level.select("verdict", F.lit(n).alias("n"), "key", "c", F.lit(1).alias("types")))
        parts.append(level.groupBy("verdict", F.shiftrightunsigned("key", 8).alias("key")).agg(F.sum("c").alias("c"), F.count("*").cast("int").alias("types")).select("verdict", F.lit(-n).alias("n"), "key", "c", "types"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    return stored(every, "url_models")


def _joined(grams: DataFrame, model: DataFrame) -> DataFrame:
    """The distinct keys of `grams` with the log-likelihood under the rejected model minus that under the accepted one."""
    out = grams.select("key").distinct().withColumns({"pa": F.lit(1 / 256), "pb": F.lit(1 / 256)})
    sides = {"a": F.col("verdict") == ALLOW, "b": F.col("verdict") == BLOCK}
    for n in range(1, ORDER + 1):
        counts = model.filter(F.col("n") == n).groupBy(F.col("key").alias("gram")).agg(*[F.sum(F.when(v, F.col("c"))).alias("c" + x) for x, v in sides.items()])
        contexts = model.filter(F.col("n") == -n).groupBy(F.col("key").alias("context")).agg(
            *[F.sum(F.when(v, F.col(c))).alias(name + x) for x, v in sides.items() for c, name in (("c", "t"), ("types", "y"))])
        out = out.withColumn("gram", F.col("key").bitwiseAND((1 << 8 * n) - 1)).withColumn("context", F.shiftrightunsigned("gram", 8))
        out = out.join(counts, "gram", "left").join(contexts, "context", "left")
        p = {x: F.when(F.col("t" + x) > 0, (F.coalesce("c" + x, F.lit(0)) + F.col("y" + x) * F.col("p" + x)) / (F.col("t" + x) + F.col("y" + x))).otherwise(F.col("p" + x)) for x in sides}
        out = out.select("key", *[p[x].alias("p" + x) for x in sides])
    return out.select("key", (F.log(F.least("pb", F.lit(1.0))) - F.log(F.least("pa", F.lit(1.0)))).alias("ratio"))


def _score_by_join(flat: DataFrame, model: DataFrame, schema: str) -> DataFrame:
    def name_batches():
        rng = np.random.default_rng()

        def step(batch):
            yield {c: column(batch, c) for c in batch.schema.names} | {"b": np.full(batch.num_rows, rng.integers(1 << 63))}
        return step

    def distinct():
        def step(batch):
            names = column(batch, "b").to_numpy()
            keys, sizes = _grams([(u or "").encode() for u in column(batch, "lowered").to_pylist()])
            owner = np.repeat(names, sizes)
            for b in np.unique(names):
                mine = np.unique(keys[owner == b])
                yield {"b": np.full(len(mine), b), "key": mine.view(np.int64)}
        return step

    def score(pages, ratios):
        keys, sizes = _grams([(u or "").encode() for u in pages.column("lowered").to_pylist()])
        names, values = ratios.column("key").to_numpy().view(np.uint64), ratios.column("ratio").to_numpy()
        order = np.argsort(names)
        each = values[order][np.searchsorted(names[order], keys)] if len(keys) else np.zeros(0)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)) / np.maximum(sizes, 1)
        return pages.drop_columns(["lowered", "b"]).append_column("score", pa.array(total, pa.float64()))

    columns = ", ".join(f"`{c}` {t}" for c, t in flat.dtypes)
    named = stored(arrow(flat, name_batches, columns + ", b long"), "url_batches")
    grams = stored(arrow(named.select("b", "lowered"), distinct, "b long, key long").distinct(), "page_grams")
    ratios = grams.join(_joined(grams, model), "key").select("b", "key", "ratio")
    return named.groupBy("b").cogroup(ratios.groupBy("b")).applyInArrow(score, schema)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url: str = "url", false_block: float = 0.01) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col("u"))
    rows = pages.select(id_column, F.col(url).cast("string").alias("u")).withColumns({"host": host, "path": path}).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    examples = rows.filter("fit is not null").select("fit.verdict", F.translate("u", string.ascii_uppercase, string.ascii_lowercase).alias("u"), F.pmod(F.xxhash64("u"), F.lit(FOLDS)).alias("fold"))
    model = _count(examples.filter("fold <> 0"))
    size, kinds = model.agg(F.count("*"), F.countDistinct("verdict")).first()
    few = size <= MODEL_ROWS
    models = {}
    if few and kinds == 2:
        held = model.toArrow()  # at most MODEL_ROWS
        models = {v: Model(held.filter(pc.equal(held.column("verdict"), v))) for v in (ALLOW, BLOCK)}
    shared = Shared(pages.sparkSession, (models.get(ALLOW), models.get(BLOCK)))

    def score():
        accepted, rejected = shared.value

        def step(batch):
            urls = [(u or "").encode() for u in column(batch, "lowered").to_pylist()]
            keys, sizes = _grams(urls)
            names, back = np.unique(keys, return_inverse=True)
            both = np.zeros(len(names)) if accepted is None or rejected is None else rejected.log_probability(names) - accepted.log_probability(names)
            owner = np.repeat(np.arange(len(urls)), sizes)
            yield {c: column(batch, c) for c in batch.schema.names if c != "lowered"} | {"score": np.bincount(owner, both[back], len(urls)) / np.maximum(sizes, 1)}
        return step

    flat = rows.select(F.col(id_column), "host", "path", "fit.rule", F.col("fit.verdict").alias("given"), F.pmod(F.xxhash64("u"), F.lit(FOLDS)).alias("fold"), F.translate("u", string.ascii_uppercase, string.ascii_lowercase).alias("lowered"))
    schema = ", ".join(f"`{c}` {t}" for c, t in flat.dtypes if c != "lowered") + ", score double"
    scored = stored(arrow(flat, score, schema) if few or kinds < 2 else _score_by_join(flat, model, schema), "scores")
    threshold = scored.filter((F.col("given") == ALLOW) & (F.col("fold") == 0)).agg(F.percentile("score", F.lit(1 - false_block))).first()[0]
    threshold = max(0.0, threshold or 0.0)
    method = F.when(F.col("score") > threshold, BLOCK).otherwise(ALLOW)
    return scored.select(id_column, "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "score")
