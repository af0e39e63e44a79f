"""Language identification by interpolated Kneser-Ney character models (operator 10).

Letters are lower-cased; other characters end a word. Every letter, and the end of every word, is predicted from up to
`order - 1` characters before it in the word. Counts of all training documents are taken per task and summed by Spark, which
also derives the continuation counts of the lower orders. The model of a language is kept as sorted arrays of n-gram hashes
of `hash_bits` bits per order, so what is broadcast is at most `2 * order * 2**hash_bits` entries per language whatever the
corpus. A document gets the language with the lowest cross-entropy per predicted character.

Calibration: mean and variance of the training text's own cross-entropy per language. `fits` is false where a document's
cross-entropy exceeds `slack` times the mean plus `sigmas` standard errors for its length.

Null texts, and texts without a letter, are `und` with score 0 (fits false); so is everything when no document has a
language. Ties go to the language that sorts first. Repeated rows get equal predictions. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.frames import Shared, arrow, bounded_batches, column, stored, text_runs

BITS = 12
UNKNOWN = "und"
PIECE_CHARS = 1 << 18
REMEMBERED = 1_000_000


def letter_table() -> np.ndarray:
    """A 12-bit symbol per code point: 0 for anything but letters; letters beyond 4095 share symbols by hash."""
    codes = np.arange(0x110000, dtype=np.uint64)
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    high = 1 + (codes * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(4095)
    return np.where(alpha, np.where(codes < 4096, codes, high), 0).astype(np.uint16)


def char_grams(texts: list[str], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams ending at every letter and word end, and for each text the number of n-grams."""
    joined = "\0".join([t.lower() for t in texts]) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    symbols = table[codes].astype(np.uint64)
    at = np.arange(len(symbols))
    border = np.maximum.accumulate(np.where(symbols == 0, at, -1))
    since = at - np.concatenate([[-1], border[:-1]])
    keys = symbols.copy()
    for j in range(1, order):
        keys[j:] |= np.where(since[j:] > j, symbols[:-j], 0) << np.uint64(BITS * j)
    wanted = symbols != 0
    wanted[1:] |= symbols[:-1] != 0
    ends = np.cumsum([len(t.lower()) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(wanted)])[np.concatenate([[0], ends]).astype(np.int64)]
    return keys[wanted], np.diff(upto)


def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


class Model:
    """Sorted hash arrays: per order and language the n-gram counts, and per context its total and number of types."""

    def __init__(self, langs: list[str], order: int, bits: int, discount: float, grams: dict, contexts: dict, symbols: int):
        self.langs, self.order, self.bits, self.discount = langs, order, bits, discount
        self.grams, self.contexts, self.symbols = grams, contexts, symbols

    @staticmethod
    def _find(table, keys):
        names, values = table
        at = np.minimum(np.searchsorted(names, keys), max(len(names) - 1, 0))
        return values[:, at] * (names[at] == keys) if len(names) else np.zeros((len(values), len(keys)))

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms, one row per key and one column per language."""
        out = np.empty((len(keys), len(self.langs)), np.float32)
        hashes = {}
        for n in range(1, self.order + 1):
            gram = keys & np.uint64((1 << BITS * n) - 1)
            hashes[n] = _hash(gram, self.bits), _hash(gram >> np.uint64(BITS), self.bits)
        for i in range(len(self.langs)):
            p = np.full(len(keys), 1.0 / self.symbols)
            for n in range(1, self.order + 1):
                (count,) = self._find(self.grams[i, n], hashes[n][0])
                total, types = self._find(self.contexts[i, n], hashes[n][1])
                seen = total > 0
                total = np.where(seen, total, 1.0)
                mixed = (np.maximum(count - self.discount, 0) + self.discount * np.minimum(types, total) * p) / total
                p = np.where(seen, np.minimum(mixed, 1.0), p)
            out[:, i] = np.log(p)
        return out


class Scorer:
    """Log-probabilities of n-grams, remembering those met before in the task (a cache: forgetting changes nothing)."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        distinct = np.unique(keys)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = distinct[self.keys[at] != distinct] if len(self.keys) else distinct
        if len(new):
            if len(self.keys) > REMEMBERED:
                self._forget()
                new = distinct
            keys_all = np.concatenate([self.keys, new])
            order = np.argsort(keys_all, kind="stable")
            self.keys, self.scores = keys_all[order], np.concatenate([self.scores, self.model.log_probability(new)])[order]
        local = self.scores[np.searchsorted(self.keys, distinct)]
        return local[np.searchsorted(distinct, keys)]


def train(labelled: DataFrame, order: int = 4, hash_bits: int = 20, discount: float = 0.75):
    """Broadcast model and calibration {lang: (mean, variance)} from rows (lang, t)."""
    spark = labelled.sparkSession
    table = spark.sparkContext.broadcast(letter_table())
    bounded_batches(spark)

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for some, texts in text_runs(pa.array(np.arange(len(names))), batch.column(1), PIECE_CHARS):
                keys, sizes = char_grams(texts, table.value, order)
                own = names[some.to_numpy()]
                owner = np.repeat(np.arange(len(own)), sizes)
                for lang in sorted(set(own)):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(keys[(own == lang)[owner]], return_counts=True))
                    if sum(len(found) for found, _ in parts[1:]) > PIECE_CHARS:  # added up now and then, not for every piece
                        parts[:] = [summed(parts)]
                        if len(parts[0][0]) > REMEMBERED:
                            yield pack(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield pack(lang, *summed(parts))

    def summed(parts):
        found, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return found, np.bincount(back, np.concatenate([x for _, x in parts]), len(found)).astype(np.int64)

    def pack(lang, keys, times):
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "key": pa.array(keys.view(np.int64)), "c": pa.array(times.astype(np.int64))})

    top = stored(labelled.select("lang", "t").mapInArrow(count, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c")), "grams")
    langs = [r[0] for r in top.select("lang").distinct().orderBy("lang").collect()]
    grams, contexts, level = None, None, top
    for n in range(order, 0, -1):
        one = level.withColumn("n", F.lit(n))
        ctx = one.groupBy("lang", "n", F.shiftrightunsigned("key", BITS).alias("key")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        grams, contexts = (one, ctx) if grams is None else (grams.unionByName(one), contexts.unionByName(ctx))
        level = level.groupBy("lang", F.col("key").bitwiseAND((1 << BITS * (n - 1)) - 1).alias("key")).agg(F.count("*").alias("c"))

    def hashed():
        def step(batch):
            yield {c: column(batch, c) for c in batch.schema.names if c != "key"} | {
                "key": _hash(column(batch, "key").to_numpy().view(np.uint64), hash_bits).astype(np.int64)}
        return step

    grams = arrow(grams.select("lang", "n", "key", "c"), hashed, "lang string, n int, key long, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c")).toArrow()
    contexts = arrow(contexts, hashed, "lang string, n int, key long, total long, types long").groupBy("lang", "n", "key").agg(
        F.sum("total").alias("total"), F.sum("types").alias("types")).toArrow()

    def sorted_arrays(found: pa.Table, values: list[str]) -> dict:
        names, n, key = np.array(found["lang"].to_pylist(), object), found["n"].to_numpy(), found["key"].to_numpy().view(np.uint64)
        numbers = np.array([found[v].to_numpy() for v in values], np.float64)
        out = {}
        for i, lang in enumerate(langs):
            mine = names == lang
            for k in range(1, order + 1):
                at = np.flatnonzero(mine & (n == k))
                at = at[np.argsort(key[at])]
                out[i, k] = key[at], numbers[:, at]
        return out

    symbols = 1 + top.select(F.col("key").bitwiseAND((1 << BITS) - 1)).distinct().count()
    model = Shared(spark, Model(langs, order, hash_bits, discount, sorted_arrays(grams, ["c"]), sorted_arrays(contexts, ["total", "types"]), symbols))
    where = {lang: i for i, lang in enumerate(langs)}

    def own():
        def step(batch):
            lang = np.array([where[x] for x in column(batch, "lang").to_pylist()], np.int64)
            scores = model.value.log_probability(column(batch, "key").to_numpy().view(np.uint64))
            cost = -scores[np.arange(len(lang)), lang].astype(np.float64)
            times = column(batch, "c").to_numpy().astype(np.float64)
            yield {"lang": column(batch, "lang"), "c": times, "cost": times * cost, "square": times * cost * cost}
        return step

    sums = arrow(top, own, "lang string, c double, cost double, square double").groupBy("lang").agg(*[F.sum(x).alias(x) for x in ("c", "cost", "square")]).collect()
    calibration = {r.lang: (r.cost / r.c, max(r.square / r.c - (r.cost / r.c) ** 2, 1e-6)) for r in sums}
    return model, table, calibration


def predict(docs: DataFrame, model, table, calibration: dict, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), slack: float = 1.5, sigmas: float = 8.0) -> DataFrame:
    """Docs' id and `keep` columns with lang_pred, score, cross_entropy, n_predicted and fits."""
    order = model.value.order
    langs = model.value.langs

    def make():
        scorer = Scorer(model.value)
        mean = np.array([calibration[x][0] for x in langs])
        deviation = np.sqrt([calibration[x][1] for x in langs])

        def step(batch):
            end = 0
            for some, texts in text_runs(column(batch, id_column), column(batch, "__t"), PIECE_CHARS):
                a, b = end, end + len(some)
                end = b
                keys, sizes = char_grams(texts, table.value, order)
                n, has = len(sizes), sizes > 0
                total = np.zeros((n, max(len(langs), 1)))
                if len(keys) and langs:
                    cuts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                    total[has] = np.add.reduceat(scorer(keys), cuts[has], axis=0, dtype=np.float64)
                entropy = -total / np.maximum(sizes, 1)[:, None]
                best = np.argmin(entropy, axis=1)
                least = entropy[np.arange(n), best]
                known = has & bool(langs)
                if langs:
                    posterior = 1.0 / np.exp((least[:, None] - entropy) * np.minimum(sizes, 60)[:, None]).sum(axis=1)
                    fits = known & (least <= slack * mean[best] + sigmas * deviation[best] / np.sqrt(np.maximum(sizes, 1)))
                else:
                    posterior, fits = np.zeros(n), known
                yield {c: column(batch, c).slice(a, b - a) for c in (id_column, *keep)} | {
                    "lang_pred": [langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], "score": np.where(known, posterior, 0.0),
                    "cross_entropy": pa.array(least, mask=~known), "n_predicted": sizes, "fits": fits}
        return step

    chosen = docs.select(id_column, *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "__t")
    return arrow(chosen, make, schema + ", lang_pred string, score double, cross_entropy double, n_predicted long, fits boolean")


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Train on labelled documents that are not held out, predict all."""
    labelled = docs.filter(F.col(lang).isNotNull() & ~held_out(id_column)).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"))
    return predict(docs, *train(labelled), id_column=id_column, text=text, keep=keep)
