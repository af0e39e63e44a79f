"""Packets of log contents, read in byte ranges that don't depend on one another.

Where a frame begins depends on where the one before it ended, back to the start of the log. A range of bytes doesn't know
that, but it can say for every offset at which reading may enter it where reading leaves it and how many frames lie between:
each mark leads to the first mark behind its frame, so following these links (by doubling) gives the way from every mark at
once. The ranges' maps are small; composed along a log they give each range its real entry and its first packet number, and
a second pass over the ranges emits the packets as whole columns.

A range carries the bytes of the longest frame behind its end. Ranges are stored once and read by both passes; the second
one joins the entries by range, which moves the ranges themselves only if the entries outgrow Spark's broadcast limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomgrid.session import written

# Frame layout.
MARK = b"BR"
HEADER, TRAILER = 8, 2
LONGEST = HEADER + 0xFFFF + TRAILER

RANGE_BYTES = 4 << 20
STOPPED = -1


def walk(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, payload length) of the frames in a log, one after the other. Junk between frames is skipped; a frame that
    runs past the end stops the walk."""
    at, last = data.find(MARK), len(data) - HEADER
    while 0 <= at < last:
        size = int.from_bytes(data[at + 2:at + 4], "little")
        end = at + HEADER + size + TRAILER
        if end > len(data):
            return
        yield at, size
        at = data.find(MARK, end)


class Range:
    """Marks of one range (offsets within the log) and what each leads to."""

    def __init__(self, data: np.ndarray, start: int, stop: int, total: int):
        self.data, self.start, self.stop = data, start, stop
        both = (data[:-1] == MARK[0]) & (data[1:] == MARK[1])
        self.marks = np.flatnonzero(both[:stop - start]) + start
        framed = self.marks < total - HEADER
        at = self.marks[framed] - start
        self.size = np.zeros(len(self.marks), np.int64)
        self.size[framed] = data[at + 2].astype(np.int64) | data[at + 3].astype(np.int64) << 8
        self.end = self.marks + HEADER + self.size + TRAILER
        self.alive = framed & (self.end <= total)
        self.next = np.where(self.alive, np.searchsorted(self.marks, self.end), len(self.marks))

    def ways(self) -> tuple[np.ndarray, np.ndarray]:
        """For every mark where reading from it leaves the range (`STOPPED`: it ends there) and the frames on the way."""
        own = np.arange(len(self.marks))
        onward = self.next < len(self.marks)
        successor, frames = np.where(onward, self.next, own), onward.astype(np.int64)
        while not np.array_equal(further := successor[successor], successor):
            frames, successor = frames + frames[successor], further
        left = np.where(self.alive, np.maximum(self.end, self.stop), STOPPED)
        return left[successor], frames + self.alive[successor]

    def from_entry(self, entry: int) -> np.ndarray:
        """Marks of the frames from an entry on."""
        found, i, follow, alive = [], int(np.searchsorted(self.marks, entry)), self.next.tolist(), self.alive
        while i < len(follow) and alive[i]:
            found.append(i)
            i = follow[i]
        return np.array(found, np.int64)

    def columns(self, entry: int, first: int) -> dict[str, pa.Array]:
        """Packets from an entry on, numbered from `first`."""
        which = self.from_entry(entry)
        at, size = self.marks[which] - self.start, self.size[which]
        body, data = at + HEADER, self.data
        upto = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        # weighted by nothing: the plain byte sum, modulo 2^16
        true = upto[body + size] - upto[at] & 0xFFFF
        pair = lambda i: data[i].astype(np.int32) | data[i + 1].astype(np.int32) << 8
        given = pair(body + size)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        payload = b"".join([data[i:j].tobytes() for i, j in zip(body.tolist(), (body + size).tolist(), strict=True)])
        return {"seq": pa.array(first + np.arange(len(at))), "offset": pa.array(at + self.start), "packet_id": pa.array(pair(at + 4)),
                "src": pa.array(data[at + 6].astype(np.int32)), "dst": pa.array(data[at + 7].astype(np.int32)),
                "payload": pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(payload)]),
                "checksum": pa.array(given), "checksum_ok": pa.array(given == true)}


def _range(batch: pa.RecordBatch, i: int, width: int) -> Range:
    start, total = batch.column("_start")[i].as_py(), batch.column("_total")[i].as_py()
    return Range(np.frombuffer(batch.column("_data")[i].as_buffer(), np.uint8), start, min(start + width, total), total)


def packets(blobs: DataFrame, schema: str, *, keys: Sequence[str], content: str = "content", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets (`schema`) of log contents (keys, binary), numbered from 0 within each row of `blobs`."""
    keys, at = list(keys), ("_log", "_range")
    owner = [T.StructField(k, blobs.schema[k].dataType) for k in keys]
    # Spark cuts the ranges itself: a Python worker would hold a batch of whole logs
    whole = blobs.filter(F.length(content) > 0).select(*keys, F.monotonically_increasing_id().alias("_log"), F.col(content).alias("_content"))
    starts = F.sequence(F.lit(0), F.length("_content") - 1, F.lit(range_bytes))
    cut = whole.select("*", F.posexplode(starts).alias("_range", "_start")).select(
        *keys, "_log", F.col("_range").cast("long"), F.col("_start").cast("long"), F.length("_content").cast("long").alias("_total"),
        F.substring("_content", F.col("_start") + 1, F.lit(range_bytes + LONGEST)).alias("_data"))

    # small row groups, so that the ranges of one large log are read by many tasks
    ranges = written(cut, "log_ranges", **{"parquet.block.size": 2 * (range_bytes + LONGEST)})

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = _range(batch, i, range_bytes)
                left, frames = r.ways()
                reach = int(np.searchsorted(r.marks, r.start + LONGEST)) + 1  # no frame of an earlier range ends further on
                yield pa.RecordBatch.from_pydict({
                    "_log": batch.column("_log").slice(i, 1), "_range": batch.column("_range").slice(i, 1), "stop": [r.stop],
                    "marks": [r.marks[:reach]], "left": [left[:reach]], "frames": [frames[:reach]]})

    mapped = ranges.select(*at, "_start", "_total", "_data").mapInArrow(maps, "_log long, _range long, stop long, marks array<long>, left array<long>, frames array<long>")

    def compose(log: pd.DataFrame) -> pd.DataFrame:
        entry, first, out = 0, 0, []
        for r in log.sort_values("_range").itertuples():
            out.append((r[1], r[2], entry, first))
            if entry == STOPPED or entry >= r.stop:
                continue
            i = int(np.searchsorted(r.marks, entry))
            if i < len(r.marks):
                entry, first = int(r.left[i]), first + int(r.frames[i])
            else:
                entry = int(r.stop)
        return pd.DataFrame(out, columns=["_log", "_range", "_entry", "_first"])

    entries = mapped.groupBy("_log").applyInPandas(compose, "_log long, _range long, _entry long, _first long")
    result = T.StructType([*owner, *T.StructType.fromDDL(schema)])
    target = to_arrow_schema(result)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _range(batch, i, range_bytes).columns(batch.column("_entry")[i].as_py(), batch.column("_first")[i].as_py())
                rows = pa.array(np.full(len(found["seq"]), i))
                cells = [batch.column(k).take(rows) for k in keys] + [found[f.name] for f in list(target)[len(keys):]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, target, strict=True)], schema=target)

    return ranges.join(entries.filter(F.col("_entry") != STOPPED), list(at)).mapInArrow(emit, result)
