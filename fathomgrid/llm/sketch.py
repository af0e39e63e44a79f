"""Count-min sketches of 64-bit values, gathered sparsely in each task and merged block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import Shared, arrow, column, stored

ROWS = 2
LOG2_BLOCK = 17
LOG2_COUNT_BLOCK, HELD = 18, 1 << 20
LOG2_WIDEST = 29
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def slot(values: np.ndarray, row: int, log2_width: int) -> np.ndarray:
    return (ts.mix(values ^ _SALTS[row]) >> np.uint64(64 - log2_width)).astype(np.int64)


def width_for(size: int, least: int = 16, most: int = LOG2_WIDEST) -> int:
    return min(max(least, int(size).bit_length()), most)


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def repeated_bits(docs: DataFrame, make_values: Callable[[], Callable[[pa.RecordBatch], Iterable[np.ndarray]]], log2_width: int):
    """Two-row sketch of the values of all batches, as broadcast bits "estimated to occur more than once".

    Counters stop at two, which is all that is asked of them. A task sends a block's cells once for every `HELD` values, however
    few values a batch has. The broadcast is `ROWS * 2**log2_width / 8` bytes.
    """
    block = min(LOG2_BLOCK, log2_width)

    def make():
        values_of, held, size = make_values(), [], [0]

        def flush():
            values = np.concatenate(held)
            held.clear()
            size[0] = 0
            for row in range(ROWS):
                places, counts = np.unique(slot(values, row, log2_width), return_counts=True)
                places = np.repeat(places, np.minimum(counts, 2))
                cells = places & ((1 << block) - 1)
                names, at = np.unique(places >> block, return_index=True)
                ends = [*at[1:], len(cells)]
                yield {"row": np.full(len(names), row, np.int32), "block": names.astype(np.int32),
                       "cells": [_packed(cells[a:b]) for a, b in zip(at, ends, strict=True)]}

        def step(batch):
            for values in () if batch is None else values_of(batch):
                held.append(values)
                size[0] += len(values)
                if size[0] >= HELD:
                    yield from flush()
            if batch is None and size[0]:
                yield from flush()
        return step

    def merge(key, parts):
        seen = np.zeros(1 << block, np.uint8)
        for cell in parts.column("cells").to_pylist():
            cell = _unpacked(cell)
            seen[cell] = np.minimum(seen[cell] + 1, 2)
            seen[cell[1:][cell[1:] == cell[:-1]]] = 2
        bits = np.packbits(seen > 1, bitorder="little").tobytes()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    merged = arrow(docs, make, "row int, block int, cells binary", ending=True).groupBy("row", "block").applyInArrow(merge, "row int, block int, bits binary")
    bits = [np.zeros(max(1, (1 << log2_width) // 8), np.uint8) for _ in range(ROWS)]
    step = max(1, (1 << block) // 8)
    for row in merged.collect():  # bounded by the width
        bits[row["row"]][row["block"] * step:(row["block"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits)


def may_repeat(bits: list[np.ndarray], values: np.ndarray, log2_width: int) -> np.ndarray:
    hit = np.ones(len(values), bool)
    for row in range(ROWS):
        place = slot(values, row, log2_width)
        hit &= (bits[row][place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return hit


class Magnitudes:
    """Estimated frequency levels of 64-bit values: four bits a cell, one power of two a level, from half the mean load on."""

    def __init__(self, cells: np.ndarray, log2_width: int):
        self.cells, self.log2_width = cells, log2_width

    def of(self, values: np.ndarray) -> np.ndarray:
        place = slot(values, 0, self.log2_width)
        return (self.cells[place >> 1] >> ((place & 1) << 2).astype(np.uint8) & 15).astype(np.uint64)


def _steps(places: np.ndarray, kind=np.uint16) -> bytes:
    """Sorted places as steps of 8 or 16 bits; the largest step only moves on."""
    most = int(np.iinfo(kind).max)
    steps = np.diff(places, prepend=0)
    far = steps // most
    out = np.full(len(steps) + int(far.sum()), most, kind)
    out[np.cumsum(far + 1) - 1] = steps % most
    return out.tobytes()


def _places(steps: bytes, kind=np.uint16) -> np.ndarray:
    steps = np.frombuffer(steps, kind)
    return np.cumsum(steps, dtype=np.int64)[steps != np.iinfo(kind).max]


def _packed(places: np.ndarray) -> bytes:
    """Sorted places as steps of the size that takes less, and a byte that tells the size."""
    kind = np.uint8 if places[-1] < 368 * len(places) else np.uint16
    return _steps(places, kind) + bytes([np.dtype(kind).itemsize])


def _unpacked(steps: bytes) -> np.ndarray:
    return _places(steps[:-1], np.uint8 if steps[-1] == 1 else np.uint16)


def magnitudes(docs: DataFrame, make_values: Callable[[], Callable[[pa.RecordBatch], Iterable[np.ndarray]]], log2_width: int) -> Shared:
    """Counts of all values in one row of cells, broadcast as `Magnitudes` (half a byte a cell).

    Tasks send the cells they hit as steps between them, one to two bytes a value; each block of cells is counted in one
    array that takes in whatever comes, so memory doesn't grow with the corpus.
    """
    block = min(LOG2_COUNT_BLOCK, log2_width)
    blocks = 1 << (log2_width - block)

    def make():
        values_of, held, size = make_values(), [], [0]

        def flush():
            places = np.sort(np.concatenate(held))
            held.clear()
            size[0] = 0
            names, at = np.unique(places >> block, return_index=True)
            ends = [*at[1:], len(places)]
            yield {"block": names.astype(np.int32), "cells": [_packed(places[a:b].astype(np.int64) & ((1 << block) - 1)) for a, b in zip(at, ends, strict=True)]}

        def step(batch):
            for values in () if batch is None else values_of(batch):
                held.append(slot(values, 0, log2_width).astype(np.uint32))
                size[0] += len(values)
                if size[0] >= HELD:
                    yield from flush()
            if batch is None and size[0]:
                yield from flush()
        return step

    def count():
        totals = {}

        def step(batch):
            if batch is None:
                for name, total in totals.items():
                    yield {"block": [name], "load": [int(total.sum())], "levels": [np.log2(total + 1.0).astype(np.uint8).tobytes()]}
                return
            for name, cells in zip(column(batch, "block").to_pylist(), column(batch, "cells").to_pylist(), strict=True):
                if name not in totals:
                    totals[name] = np.zeros(1 << block, np.int64)
                totals[name] += np.bincount(_unpacked(cells), minlength=1 << block)
            yield from ()
        return step

    hit = arrow(docs, make, "block int, cells binary", ending=True).repartition(max(1, blocks // 8), "block")
    counted = stored(arrow(hit, count, "block int, load long, levels binary", ending=True), "magnitudes")
    load = (counted.agg(F.sum("load")).first()[0] or 0) >> log2_width
    least = max(0, load.bit_length() - 2)

    def pack():
        def step(batch):
            for name, levels in zip(column(batch, "block").to_pylist(), column(batch, "levels").to_pylist(), strict=True):
                level = np.clip(np.frombuffer(levels, np.uint8).astype(np.int16) - least, 0, 15).astype(np.uint8)
                yield {"block": [name], "cells": [(level[::2] | level[1::2] << 4).tobytes()]}
        return step

    cells = np.zeros(1 << log2_width >> 1, np.uint8)
    for row in arrow(counted.select("block", "levels"), pack, "block int, cells binary").toLocalIterator():  # bounded by the width
        cells[row["block"] << block >> 1:][:1 << block >> 1] = np.frombuffer(row["cells"], np.uint8)
    return Shared(docs.sparkSession, Magnitudes(cells, log2_width))


def member_bits(values: DataFrame, log2_width: int):
    """Broadcast bits of a set of longs (one column): never misses a member."""
    def make():
        def step(batch):
            return [np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)]
        return step
    return repeated_bits(values, make, log2_width)


def id_test(ids: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Function from an array of ids to marks that are true wherever the id is among `ids` (one column; rarely elsewhere)."""
    size = width_for(64 * ids.count(), least=20)  # grows with the number of ids: few rows pass by mistake
    bits = member_bits(ids.select(F.col(ids.columns[0]).cast("long")), size)
    return lambda key: may_repeat(bits.value, key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size)


def _split(docs: DataFrame, ids: DataFrame, id_column: str, name: str) -> DataFrame:
    """The rows of `docs` with a column that is true wherever the id is among `ids` (and, rarely, elsewhere)."""
    known = id_test(ids)

    def make():
        def step(batch):
            yield {c: column(batch, c) for c in batch.schema.names if c != "__id"} | {name: pa.array(known(column(batch, "__id")))}
        return step

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return arrow(docs.withColumn("__id", F.col(id_column).cast("long")), make, f"{schema}, {name} boolean")


def only(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is among `ids` (one column); others hardly enter the shuffle."""
    names = ids.toDF(id_column).distinct()
    return _split(docs, names, id_column, "__in").filter("__in").drop("__in").join(names, id_column, "left_semi").select(*docs.columns)


def without(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id isn't among `ids` (one column); only rows that may be enter a shuffle."""
    names = ids.toDF(id_column).distinct()
    split = _split(docs, names, id_column, "__in")
    doubtful = split.filter("__in").drop("__in").join(names, id_column, "left_anti").select(*docs.columns)
    return split.filter("not __in").select(*docs.columns).unionByName(doubtful)
