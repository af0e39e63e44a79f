"""Ranked lexical search of a set of items in all documents, by NRA (operator 12).

Documents stay where they lie: a task turns its documents into blocks of at most `BLOCK_POSTINGS` postings, sorts each term's
postings by impact, and reads the lists from the top only, never by document (no random access). For every document met an
item keeps a lower bound (the impacts read) and an upper bound (for lists in which it wasn't met yet, the impact the list has
come down to). A document whose upper bound lies below the item's k-th lower bound is out; one that might tie stays. Reading
ends when no unmet document can get in and every document that is left is known exactly, so membership, ties and scores are
final. The k best so far go on to the task's next blocks: most of their documents fall to the first bounds. Tasks' lists
of at most k documents an item meet in a ranking by item, in two steps so that none sees a row for every task.

Corpus statistics (documents with terms, terms, documents per item term) are exact sums over all documents. Items are handled
`ITEMS` at a time, each such set with a scan of its own; what is broadcast is one set and its counts.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case; null texts have none.
An item is a row: repeated item ids get a ranking each, with null items (no terms) having none. A document is a row too;
repeated rows may fill several ranks, and null ids come after all others of the same score. Documents with score 0 don't
count. An empty table on either side gives no rows. Extra columns play no part. Long texts are read in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import Shared, arrow, column, stored

ITEMS = 4096
BLOCK_POSTINGS = 1 << 20
CHUNK = 1 << 20
SALTS = 64
UNIT = 1_000_000_000

_PLAIN = bytes(0x20 if space else low for space, low in zip(ts.PUNCTUATION.tolist(), ts.LOWER.tolist(), strict=True))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a chunk at a time."""
    plain, start = text.translate(_PLAIN), 0
    while len(plain) - start > CHUNK:
        end = plain.find(b" ", start + CHUNK)
        if end < 0:
            break
        yield plain[start:end].split()
        start = end
    yield plain[start:].split()


class Vocabulary:
    """Numbers of the terms of a set of items, and each item's term numbers (once each)."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.numbers, self.items = {}, []
        for row, text in items:
            own = {self.numbers.setdefault(t, len(self.numbers)) for part in terms(text) for t in part}
            if own:
                self.items.append((row, np.array(sorted(own), np.int64)))

    def read(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms of a text, and the numbers and occurrences of those that are known."""
        n, found = 0, []
        for part in terms(text):
            n += len(part)
            numbers = np.fromiter(map(self.numbers.get, part, repeat(-1)), np.int64, len(part))
            found.append(numbers[numbers >= 0])
        number, tf = np.unique(np.concatenate(found), return_counts=True)
        return n, number, tf


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    texts = column(batch, "t")
    for i in range(len(texts)):
        yield texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""


def statistics(docs: DataFrame, vocabulary: Shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms, and documents per known term, of a table with a column t (binary)."""
    def make():
        known = vocabulary.value
        df, sums = np.zeros(len(known.numbers), np.int64), [0, 0]

        def step(batch):
            if batch is not None:
                for text in _texts(batch):
                    n, number, _ = known.read(text)
                    sums[0] += n > 0
                    sums[1] += n
                    df[number] += 1
            else:
                at = np.flatnonzero(df)
                yield {"what": np.append(at, [-1, -2]), "n": np.append(df[at], sums)}
        return step

    df = np.zeros(len(vocabulary.value.numbers), np.int64)
    found = dict(arrow(docs.select("t"), make, "what long, n long", ending=True).groupBy("what").agg(F.sum("n")).collect())  # one entry per term of the set
    documents, length = found.pop(-1, 0), found.pop(-2, 0)
    df[list(found)] = list(found.values())
    return documents, length, df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Lists:
    """Impact-sorted posting lists of a block of documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((-impact, term))
        order = order[impact[order] > 0]
        self.doc, self.falling = doc[order], -impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def cut(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[term], self.first[term + 1])
        return self.doc[part], self.falling[part]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block, with exact scores, that may be among the best k beside the scores `best` of other documents.

    Every list holds documents and their negated impacts, highest impact first. All lists are read down to a common
    impact, which is halved in every round.
    """
    lists = [x for x in lists if len(x[0])]
    top = np.sort(best)[::-1][:k]
    floor = int(top[k - 1]) if len(top) == k else 1
    place = np.zeros(len(lists), np.int64)
    front = np.array([-falling[0] for _, falling in lists], np.int64)
    docs, lower, met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(lists)), bool)
    level = int(front.max(initial=0))
    while len(lists):
        admit = int(front.sum()) >= floor  # may a document that no list has shown get in?
        if not admit and (not len(docs) or not (front[None, :] * ~met).any()):
            break
        level //= 2
        for i, (doc, falling) in enumerate(lists):
            end = int(np.searchsorted(falling, -level, "right")) if level else len(doc)
            new, impact = doc[place[i]:end], -falling[place[i]:end]
            place[i], front[i] = end, -falling[end] if end < len(doc) else 0
            if not len(new):
                continue
            at = np.searchsorted(docs, new)
            known = np.zeros(len(new), bool)
            inside = at < len(docs)
            known[inside] = docs[at[inside]] == new[inside]
            lower[at[known]] += impact[known]
            met[at[known], i] = True
            if admit and not known.all():
                fresh, order = new[~known], np.argsort(new[~known])
                spot = at[~known][order]
                docs, lower = np.insert(docs, spot, fresh[order]), np.insert(lower, spot, impact[~known][order])
                met = np.insert(met, spot, np.arange(len(lists)) == i, axis=0)
        if len(lower) + len(top) >= k:
            both = np.concatenate([lower, top])
            floor = max(floor, int(np.partition(both, len(both) - k)[len(both) - k]))
        stays = lower + (~met) @ front >= floor
        docs, lower, met = docs[stays], lower[stays], met[stays]
    return docs, lower


class Search:
    """The best k documents of every item over the blocks of a task."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, k: int):
        self.vocabulary, self.weight, self.k = vocabulary, weight, k
        nothing = np.zeros(0, np.int64)
        self.best = {row: (nothing, nothing, np.zeros(0, bool)) for row, _ in vocabulary.items}  # score, id, id is null

    def block(self, ids: np.ndarray, nulls: np.ndarray, doc: np.ndarray, term: np.ndarray, share: np.ndarray) -> None:
        lists = Lists(doc, term, self.weight[term] * share, len(self.weight))
        for row, own in self.vocabulary.items:
            score, name, null = self.best[row]
            docs, found = nra([lists.cut(t) for t in own.tolist()], self.k, score)
            if len(docs):
                score, name, null = np.concatenate([score, found]), np.concatenate([name, ids[docs]]), np.concatenate([null, nulls[docs]])
                order = np.lexsort((name, null, -score))[:self.k]
                self.best[row] = score[order], name[order], null[order]


def _ranked(docs: DataFrame, vocabulary: Shared, documents: int, length: int, weight, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of every item."""
    def make():
        known = vocabulary.value
        search = Search(known, weight.value, k)
        held, size = [], 0

        def flush():
            nonlocal held, size
            if size:
                ids = np.array([h[0] or 0 for h in held], np.int64)
                nulls = np.array([h[0] is None for h in held])
                search.block(ids, nulls, np.repeat(np.arange(len(held)), [len(h[1]) for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
            held, size = [], 0

        def step(batch):
            nonlocal size
            if batch is not None:
                for name, text in zip(column(batch, "id").to_pylist(), _texts(batch), strict=True):
                    n, number, tf = known.read(text)
                    if len(number):
                        m = 50 + 50 * n * documents // length
                        held.append((name, number, UNIT * tf // (1000 * tf + 20 * m)))
                        size += len(number)
                        if size >= BLOCK_POSTINGS:
                            flush()
            else:
                flush()
                for row, (score, name, null) in search.best.items():
                    yield {"item": np.full(len(score), row), "doc_id": pa.array(name, pa.int64(), mask=null), "score": score}
        return step

    return arrow(docs, make, "item long, doc_id long, score long", ending=True)


def _best(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """item id, rank (from 1), doc_id, score: the best k documents of every item row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    rows = stored(items.select(F.col(item_column).alias("name"), F.col(text).cast("string").cast("binary").alias("t")).filter("t is not null")
                  .withColumn("item", F.monotonically_increasing_id()), "items")
    found = []
    numbered = iter(rows.select("item", "t").toLocalIterator())
    while chunk := [(r.item, bytes(r.t)) for r in islice(numbered, ITEMS)]:
        vocabulary = Shared(spark, Vocabulary(chunk))
        documents, length, df = statistics(texts, vocabulary)
        if documents:
            weight = spark.sparkContext.broadcast(weights(documents, df))
            found.append(_ranked(texts, vocabulary, documents, length, weight, k))
    if not found:
        return rows.limit(0).select(F.col("name").alias(item_column), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_column), F.lit(0).cast("long").alias("score"))
    best = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    best = _best(_best(best, k, "item", "salt"), k, "item")
    return best.join(rows.select("item", "name"), "item").select(F.col("name").alias(item_column), "rank", F.col("doc_id").alias(id_column), "score")
