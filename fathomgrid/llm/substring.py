"""Removal of repeated word windows behind a count-min prefilter (operator 6).

A window is `k` consecutive words of one document. Words covered by a window that also starts earlier (smaller id, or
same document and earlier start) go; windows are judged on the input.

1. Every window is represented by its anchor, the smallest hash of the shorter word runs inside it. Equal windows have
   equal anchors at equal places, so the number of anchor occurrences is never below the number of window occurrences.
   Each task counts its anchors in a sparse count-min sketch (two rows, counters that stop at two, since only "more than
   once" is asked); sketches are merged block by block. The merged sketch overestimates, so no repeated window is lost.
2. A second scan emits only windows whose anchor is estimated to repeat, once per document, and groups them exactly by a
   64-bit hash of the whole window: partial minima, then a join back. Repeats within a document are found where it is
   scanned.
3. Documents meet the starts of their removed windows and are rewritten.

Null and empty texts have no words; repeated rows with one id count as one document each, judged against smaller ids only.
Null ids are never removed from and never remove. Extra columns play no part. The broadcast is the merged sketch as bits,
`2 * 2**log2_width / 8` bytes: the width follows the size of the input up to 2**29 (128 MB); beyond that more windows are
grouped exactly and the result stays the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import sketch
from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import arrow, column

_ROW = np.uint64(0x9E3779B97F4A7C15)


class Scan:
    """Windows and anchors of a run of documents."""

    def __init__(self, k: int):
        self.k, self.part = k, max(1, k // 2)
        self.roll = ts.Rolling()

    def read(self, data: np.ndarray, cuts: np.ndarray) -> None:
        self.words = ts.words(data, cuts)
        hashes = ts.word_hashes(data, self.words, self.roll)
        self.whole = ts.same_row(self.words.row, self.k)
        self.window = ts.grams(hashes, self.k, self.roll)
        self.parts = ts.grams(hashes, self.part, self.roll)
        self.least = ts.sliding(self.parts, self.k - self.part + 1)

    def anchors(self) -> np.ndarray:
        """Hash at every position that is the smallest of some window."""
        reach = self.k - self.part
        pad = np.zeros(reach, np.uint64)
        best = ts.sliding(np.concatenate([pad, np.where(self.whole, self.least, 0), pad]), reach + 1, np.maximum)
        return self.parts[self.parts == best[:len(self.parts)]] if len(self.window) else pad[:0]

    def repeated(self, bits: list[np.ndarray], log2_width: int) -> np.ndarray:
        """Positions of whole windows that are estimated to occur more than once."""
        at = np.flatnonzero(self.whole)
        if not len(at):
            return at
        least = self.least[at]
        change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        hit = sketch.may_repeat(bits, least[change], log2_width)
        return at[np.repeat(hit, np.diff(np.r_[change, len(least)]))]

    def first_in_document(self, at: np.ndarray) -> np.ndarray:
        """Whether each window position is the first of its content in its document."""
        key = ts.mix(self.window[at] ^ (self.words.row[at].astype(np.uint64) * _ROW))
        first = np.zeros(len(at), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return first


def anchor_bits(docs: DataFrame, k: int, text: str, log2_width: int):
    def make():
        scan = Scan(k)

        def values(batch):
            for _, _, data, cuts in ts.pieces(column(batch, text), ts.SCAN_BYTES):
                scan.read(data, cuts)
                yield scan.anchors()
        return values
    return sketch.repeated_bits(docs.select(text), make, log2_width)


def remove_repeats(docs: DataFrame, k: int = 20, id_column: str = "doc_id", text: str = "text", log2_width: int | None = None,
                   keep: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """One row per document: id, the columns `keep`, n_words, n_removed, kept (the remaining words joined by one space; with
    `as_is` the text itself where nothing is removed), kept_sha256."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    narrow = rows.select("id", "t")
    kept_columns = rows.dtypes[2:]
    log2_width = log2_width or sketch.width_for(sketch.text_bytes(narrow, "t") // 8)  # about five counters per anchor
    bits = anchor_bits(narrow, k, "t", log2_width)

    def make():
        scan = Scan(k)

        def step(batch):
            ids = column(batch, "id")
            for a, b, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                scan.read(data, cuts)
                at = scan.repeated(bits.value, log2_width)
                at = at[scan.first_in_document(at)]
                if len(at):
                    row = scan.words.row[at]
                    yield {"h": scan.window[at].view(np.int64), "id": ids.slice(a, b - a).take(pa.array(row)), "start": (at - scan.words.first[row]).astype(np.int32)}
        return step

    windows = arrow(narrow, make, "h long, id long, start int")
    firsts = windows.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("h", "first_id")
    removed = windows.join(firsts, "h").filter("id > first_id").groupBy("id").agg(F.collect_list("start").alias("starts"))

    def rewrite():
        scan = Scan(k)

        def step(batch):
            ids, found = column(batch, "id"), column(batch, "starts")
            lists, known = found.flatten().to_numpy(zero_copy_only=False), found.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(known, found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            cut = np.concatenate([[0], np.cumsum(size)])
            for a, b, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                scan.read(data, cuts)
                w = scan.words
                at = scan.repeated(bits.value, log2_width)
                own = at[~scan.first_in_document(at)]
                others = lists[cut[a]:cut[b]].astype(np.int64) + np.repeat(w.first[:-1], size[a:b])
                gone = ts.cover(np.concatenate([own, others]), k, len(w.starts))
                sums = np.concatenate([[0], np.cumsum(gone)])
                raw, kept = data.tobytes(), []
                for r in range(b - a):
                    i, j = w.first[r], w.first[r + 1]
                    if as_is and sums[i] == sums[j]:
                        kept.append(raw[cuts[r]:cuts[r + 1]])
                        continue
                    keep = np.flatnonzero(~gone[i:j]) + i
                    kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)]))
                yield {c: column(batch, c).slice(a, b - a) for c, _ in kept_columns} | {"id": ids.slice(a, b - a), "n_words": np.diff(w.first), "n_removed": sums[w.first[1:]] - sums[w.first[:-1]],
                       "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return step

    schema = ", ".join(["id long", *[f"{c} {t}" for c, t in kept_columns], "n_words long, n_removed long, kept string, kept_sha256 string"])
    return arrow(rows.join(removed, "id", "left"), rewrite, schema).withColumnsRenamed({"id": id_column} | {f"keep_{i}": c for i, c in enumerate(keep)})
