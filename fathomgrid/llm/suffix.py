"""Removal of byte strings that also start in a smaller document, by bucket-pointer refinement (operator 4).

Every `k`-byte string is a suffix prefix; suffixes are dealt to buckets and buckets refined until they are equal to depth `k`:

1. A string belongs to the bucket of its anchor, the smallest hash of the shorter grams inside it. Anchors that occur once
   (by a count-min sketch, which never misses a repeat) hold no repeated string. Runs of neighbouring strings with one anchor
   are a segment.
2. Equal segments are matched first: one shuffle finds the smallest document of each, and that document learns which segments
   it is the first to hold. Any other segment of a repeated anchor stands in a smaller document and goes as a whole.
3. Where one anchor has different segments (two bitmaps name such anchors and the first copies of their segments, never
   missing one), their strings are refined: initial buckets are the first `q` bytes, then buckets
   are sorted on the bucket identifiers `q`, `2q`, ... bytes later. Identifiers are updated in place and each round reuses
   those of the last, so `k` bytes take log2(k / q) rounds; buckets of one suffix are left alone. Every segment comes with its
   smallest document. Anchors with more than `crowded` segments are refined by Spark instead, string by string
   on the identity of all `k` bytes, with partial minima: no task holds a bucket without a bound.
4. Documents meet the segments they hold first and the removed strings of those, and are cut.

Null and empty texts have no bytes. Rows that repeat an id count as one document each and never remove from one another.
Null ids neither remove nor lose anything. Extra columns play no part. A segment is known by 32 bits of its anchor and 64 bits
of its content (by the latter inside a document), a string of a crowded anchor by 64 bits of the anchor and 64 of its own; the
rest of step 3 compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import sketch
from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import arrow, column, stored

_ROW = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20


class Scan:
    """Strings, anchors and segments of a run of documents."""

    def __init__(self, k: int):
        self.k, self.part = k, max(1, k // 2)
        self.roll = ts.Rolling()

    def read(self, data: np.ndarray, cuts: np.ndarray) -> None:
        self.data, self.cuts = data, cuts
        self.row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self.sums = self.roll.prefix(self.roll.bytes[data])
        n = max(0, len(data) - self.part + 1)
        self.parts = self.roll.spans(self.sums, slice(0, n), slice(self.part, n + self.part)) if n else np.zeros(0, np.uint64)
        self.least = ts.sliding(self.parts, self.k - self.part + 1)
        self.whole = ts.same_row(self.row, self.k)

    def anchors(self) -> np.ndarray:
        reach = self.k - self.part
        if not len(self.least):
            return self.least
        pad = np.zeros(reach, np.uint64)
        best = ts.sliding(np.concatenate([pad, np.where(self.whole, self.least, 0), pad]), reach + 1, np.maximum)
        return self.parts[self.parts == best[:len(self.parts)]]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First string, number of strings (at most `k`, so marks fit a long), anchor and content hash of every segment."""
        at = np.flatnonzero(self.whole)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64)
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (self.least[at[1:]] != self.least[at[:-1]]) | (self.row[at[1:]] != self.row[at[:-1]])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        cap = self.k
        if (size > cap).any():  # long runs of one anchor (repetitive text) are cut
            pieces = -(-size // cap)
            first = np.repeat(first, pieces) + cap * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            size = np.diff(np.r_[first, len(at)])
        start = at[first]
        return start, size, self.least[start], self.roll.spans(self.sums, start, start + size + self.k - 1)


def _short(anchor: np.ndarray) -> np.ndarray:
    """The 32 bits of an anchor that the table of segments holds; anchors that share them count as one with many segments."""
    return anchor.astype(np.uint32).view(np.int32)


def _copy(content: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Hash of a segment in a document."""
    return ts.mix(content ^ ts.mix(document.astype(np.int64).view(np.uint64) + _ROW))


def _distinct(row: np.ndarray, content: np.ndarray) -> np.ndarray:
    """First index of every (document, content)."""
    return np.sort(np.unique(ts.mix(content ^ (row.astype(np.uint64) * _ROW)), return_index=True)[1])


def refine(text: np.ndarray, k: int, q: int = 8) -> np.ndarray:
    """Bucket identifiers of all positions such that equal identifiers mean equal `k` bytes (the last k - 1 are arbitrary)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(k, np.uint8)]).astype(np.uint64)
    depth = min(q, k)
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = key << np.uint64(8) | padded[j:n + j]
    order = np.argsort(key)  # equal keys may stand in any order
    bucket = np.empty(n + k, np.int64)
    bucket[n:] = -1
    head = np.maximum.accumulate(np.where(np.r_[True, key[order][1:] != key[order][:-1]], np.arange(n), 0))
    bucket[order] = head
    active = order  # by bucket
    while depth < k:
        step = min(depth, k - depth)
        ids = bucket[active]
        same = np.r_[False, ids[1:] == ids[:-1]]
        shared = same | np.r_[same[1:], False]
        active = active[shared]
        if not len(active):
            break
        ids, later = bucket[active], bucket[active + step]
        order = np.argsort(ids * (n + 1) + later + 1)
        active, ids, later = active[order], ids[order], later[order]
        opens = np.r_[True, ids[1:] != ids[:-1]]
        base = np.maximum.accumulate(np.where(opens, np.arange(len(ids)), 0))
        head = np.maximum.accumulate(np.where(opens | np.r_[True, later[1:] != later[:-1]], np.arange(len(ids)), 0))
        bucket[active] = ids + head - base
        depth += step
    return bucket[:n]


def _earlier(texts: list[bytes], docs: np.ndarray, k: int) -> list[int]:
    """For each segment the bit mask of its strings that also stand in a segment with a smaller document."""
    size = np.array([len(t) for t in texts], np.int64)
    bucket = refine(np.frombuffer(b"".join(texts), np.uint8), k)
    strings = size - k + 1
    owner = np.repeat(np.arange(len(texts)), strings)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    ids = bucket[(np.cumsum(size) - size)[owner] + place]
    order = np.argsort(ids)
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[owner][order], first), np.diff(np.r_[first, len(ids)]))
    hit = least < docs[owner]
    out = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(out, owner[hit], np.int64(1) << place[hit])
    return out.tolist()


def _contents(texts: list[bytes], roll: ts.Rolling) -> np.ndarray:
    """Content hashes of segments from their bytes, as `Scan.segments` gives them."""
    ends = np.cumsum([len(t) for t in texts])
    return roll.spans(roll.prefix(roll.bytes[np.frombuffer(b"".join(texts), np.uint8)]), np.r_[0, ends[:-1]], ends)


def _lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column behind one another, and how many each row has (null: none)."""
    return lists.flatten(), np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)


def remove_repeats(docs: DataFrame, k: int = 50, id_column: str = "doc_id", text: str = "text", log2_width: int | None = None, crowded: int = 2000) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""
    if k > 62:
        raise ValueError("segments are marked in a long: k is at most 62")
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    log2_width = log2_width or sketch.width_for(sketch.text_bytes(narrow, "t") // 4)

    def make_anchors():
        scan = Scan(k)

        def values(batch):
            for _, _, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                scan.read(data, cuts)
                yield scan.anchors()
        return values

    bits = sketch.repeated_bits(narrow.select("t"), make_anchors, log2_width)

    def found():
        """Distinct segments of every document whose anchor may repeat."""
        scan = Scan(k)

        def step(batch):
            ids = column(batch, "id")
            for a, _, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                scan.read(data, cuts)
                start, _, anchor, content = scan.segments()
                hit = np.flatnonzero(sketch.may_repeat(bits.value, anchor, log2_width))
                hit = hit[_distinct(scan.row[start[hit]], content[hit])]
                if len(hit):
                    yield {"anchor": _short(anchor[hit]), "content": content[hit].view(np.int64), "id": ids.take(pa.array(a + scan.row[start[hit]]))}
        return step

    known = narrow.filter("id is not null")
    segments = arrow(known, found, "anchor int, content long, id long")
    firsts = stored(segments.groupBy("anchor", "content").agg(F.min("id").alias("first_id")), "segments", compression="zstd")

    # both bitmaps follow the number of mixed anchors and of their segments, not the text
    mixed = stored(firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "mixed")
    sizes = mixed.agg(F.count("*"), F.sum("n")).first()
    mixed_width, first_width = (min(log2_width, sketch.width_for(16 * (n or 0))) for n in sizes)
    crowded_width = min(log2_width, 24)
    mixed_bits = sketch.member_bits(mixed.select(F.col("anchor").cast("long")), mixed_width)
    crowded_bits = sketch.member_bits(mixed.filter(F.col("n") > crowded).select(F.col("anchor").cast("long")), crowded_width)

    def of_mixed(batch):
        at = np.flatnonzero(sketch.may_repeat(mixed_bits.value, column(batch, "anchor").to_numpy().astype(np.int64).view(np.uint64), mixed_width))
        return [np.repeat(_copy(column(batch, "content").to_numpy()[at].view(np.uint64), column(batch, "first_id").to_numpy()[at]), 2)]

    first_bits = sketch.repeated_bits(firsts, lambda: of_mixed, first_width)

    def spelled():
        """Bytes of the segments of mixed anchors, from the first document of each (and, rarely, from another one)."""
        scan = Scan(k)

        def step(batch):
            for batch_id, a, data, cuts in ((column(batch, "id"), a, data, cuts) for a, _, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES)):
                scan.read(data, cuts)
                start, size, anchor, content = scan.segments()
                short = _short(anchor).astype(np.int64).view(np.uint64)
                hit = np.flatnonzero(sketch.may_repeat(mixed_bits.value, short, mixed_width))
                name = batch_id.to_numpy()[a + scan.row[start[hit]]]
                keep = sketch.may_repeat(first_bits.value, _copy(content[hit], name), first_width)
                hit, name = hit[keep], name[keep]
                new = _distinct(scan.row[start[hit]], content[hit])
                hit, name = hit[new], name[new]
                if not len(hit):
                    continue
                raw = data.tobytes()
                yield {"anchor": anchor[hit].view(np.int64), "id": name, "crowded": sketch.may_repeat(crowded_bits.value, short[hit], crowded_width),
                       "bytes": [raw[s:e] for s, e in zip(start[hit].tolist(), (start[hit] + size[hit] + k - 1).tolist(), strict=True)]}
        return step

    texts = stored(arrow(known, spelled, "anchor long, id long, crowded boolean, bytes binary"), "mixed_texts", compression="zstd")

    def refined():
        names, rows, last, roll = [], [], [None, 0], ts.Rolling()

        def flush():
            if rows:
                yield {"id": list(names), "content": _contents(rows, roll).view(np.int64), "mask": _earlier(rows, np.array(names, np.int64), k)}
            names.clear()
            rows.clear()
            last[1] = 0

        def step(batch):
            if batch is None:
                yield from flush()
                return
            for anchor, name, raw in zip(*(column(batch, c).to_pylist() for c in ("anchor", "id", "bytes")), strict=True):
                if last[1] >= CHUNK_BYTES and anchor != last[0]:
                    yield from flush()
                last[0] = anchor
                last[1] += len(raw)
                names.append(name)
                rows.append(raw)
        return step

    few = texts.filter("not crowded").repartition("anchor").sortWithinPartitions("anchor").select("anchor", "id", "bytes")
    marked = arrow(few, refined, "id long, content long, mask long", ending=True).filter("mask <> 0")

    def strings():
        roll = ts.Rolling()

        def step(batch):
            for anchor, name, raw in zip(*(column(batch, c).to_pylist() for c in ("anchor", "id", "bytes")), strict=True):
                hashes = ts.grams(roll.bytes[np.frombuffer(raw, np.uint8)], k, roll)
                n, content = len(hashes), _contents([raw], roll).view(np.int64)
                yield {"anchor": np.full(n, anchor), "id": np.full(n, name), "content": np.repeat(content, n), "place": np.arange(n), "h": hashes.view(np.int64)}
        return step

    each = arrow(texts.filter("crowded").select("anchor", "id", "bytes"), strings, "anchor long, id long, content long, place int, h long")
    least = each.groupBy("anchor", "h").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id < last_id").select("anchor", "h", "first_id")
    crowd = each.join(least, ["anchor", "h"]).filter("id > first_id").groupBy("id", "content").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))

    marks = marked.unionByName(crowd).groupBy("id").agg(F.collect_list(F.struct("content", "mask")).alias("marks"))
    own = firsts.groupBy(F.col("first_id").alias("id")).agg(F.collect_list("content").alias("own"))

    def cut():
        scan = Scan(k)
        bit = np.int64(1) << np.arange(k, dtype=np.int64)

        def step(batch):
            ids = column(batch, "id")
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            (own, n_own), (marks, n_marks) = _lists(column(batch, "own")), _lists(column(batch, "marks"))
            own, (marked, masks) = own.to_numpy(), (x.to_numpy() for x in marks.flatten())
            own_cuts, mark_cuts = np.concatenate([[0], np.cumsum(n_own)]), np.concatenate([[0], np.cumsum(n_marks)])
            for a, b, data, cuts in ts.pieces(column(batch, "t"), ts.SCAN_BYTES):
                scan.read(data, cuts)
                start, size, anchor, content = scan.segments()

                def names(content, row):
                    return ts.mix(content.view(np.uint64) ^ (row.astype(np.uint64) * _ROW))

                row, rows = scan.row[start], np.arange(b - a)
                name = names(content, row)
                gone = np.zeros(len(data), bool)
                later = np.flatnonzero(named[a:b][row] & sketch.may_repeat(bits.value, anchor, log2_width))
                later = later[~np.isin(name[later], names(own[own_cuts[a]:own_cuts[b]], np.repeat(rows, n_own[a:b])))]
                if len(later):
                    ends = start[later] + size[later] + k - 1
                    gone = np.cumsum(np.bincount(start[later], minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1))[:-1] > 0
                some = slice(mark_cuts[a], mark_cuts[b])
                if len(marked[some]) and len(start):
                    keys, back = np.unique(names(marked[some], np.repeat(rows, n_marks[a:b])), return_inverse=True)
                    found = np.zeros(len(keys), np.int64)
                    np.bitwise_or.at(found, back, masks[some])
                    at = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == name)
                    seg, place = np.nonzero((found[at[hit]][:, None] & bit != 0) & (np.arange(k) < size[hit][:, None]))
                    gone |= ts.cover(start[hit[seg]] + place, k, len(data))
                sums = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~(gone[:-1] & (scan.row[1:] == scan.row[:-1]))
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = [(data[i:j][~gone[i:j]] if sums[i] != sums[j] else data[i:j]).tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield {"id": ids.slice(a, b - a), "n_bytes": np.diff(cuts), "n_removed": sums[cuts[1:]] - sums[cuts[:-1]], "n_spans": spans[cuts[1:]] - spans[cuts[:-1]],
                       "kept": kept, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return step

    return arrow(narrow.join(own, "id", "left").join(marks, "id", "left"), cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("id", id_column)
