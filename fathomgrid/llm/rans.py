"""Token ids as files of rANS-coded blocks, and back (operator 7).

`write_tokens` tokenises documents in id order, counts ids over the whole corpus, scales the counts once to a shared table of
`2**SCALE_BITS`, and codes consecutive documents in independent blocks: interleaved range asymmetric numeral system states
("lanes", 64-bit with 32-bit words), with the lanes' states and the place in the stream recorded every `CHECKPOINT` steps and
a CRC-32 of the ids. A data set is three tables in a folder of shared storage, written by Spark's own writers: `blocks` (a
row per block), `frequencies` (one row) and `parts` (tokens per range of ids). `read_tokens` decodes every block by itself, a
checkpoint at a time, and verifies the checksums.

Null texts are empty; every document ends with `end_id`. Null document ids sort first. Repeated ids keep a row each, in no
fixed order among themselves. An empty table gives a data set without blocks. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import textscan as ts
from fathomgrid.llm.frames import arrow, column, shared_folder

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES = 4096
BLOCK_TOKENS = 1 << 20
CHECKPOINT = 128
REMEMBERED = 1_500_000
SLOTS = 1 << 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


#: first bytes of white space beyond ASCII in UTF-8, and the ASCII controls that only some engines count as space
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def _wide(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII and of those controls."""
    at = np.flatnonzero(_LEAD[data])
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    dash = (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return at[(a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & dash | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


class Tokens:
    """Ids by the tokenizers library, for runs of documents.

    The byte-level pre-tokenizer never joins characters across the start of a word with its leading space, so a text is cut
    there; every distinct part is encoded once and remembered. Parts of up to 15 bytes are known by all their bytes and their
    length, as two numbers, and found through a table of slots (open addressing); longer ones by their bytes in a dict. Distinct parts are encoded many at a time,
    each behind a line break, and told apart by the line break's id; where that doesn't come out even, one by one. Texts with
    other than ASCII white space or with special tokens are set aside first and encoded whole. What is remembered is bounded
    by `REMEMBERED` parts and lives as long as the worker process, in a module made there (objects of this class live as long
    as a task); Spark doesn't account for that memory.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.line = self.tokenizer.token_to_id("\u010a")
        kept = vars(sys.modules.setdefault("_tokens_of_this_worker", types.ModuleType("_tokens_of_this_worker")))
        name = hashlib.sha256(spec.encode()).hexdigest()
        if name not in kept:
            kept.clear()
        self.kept = kept.setdefault(name, {})
        if not self.kept:
            self._forget()

    def _forget(self) -> None:
        self.kept |= {"slots": np.zeros(SLOTS, np.int32), "long": {}}
        self.kept |= {c: (np.zeros(1, kind), n) for c, kind, n in (("low", np.uint64, 1), ("high", np.uint64, 1), ("at", np.int64, 1), ("first", np.int64, 0), ("size", np.int64, 0), ("ids", np.uint32, 0))}

    low, high, at, first, size, ids = (property(lambda self, c=c: self.kept[c][0][:self.kept[c][1]]) for c in ("low", "high", "at", "first", "size", "ids"))
    slots, long = (property(lambda self, c=c: self.kept[c]) for c in ("slots", "long"))

    def _add(self, name: str, values: np.ndarray) -> None:
        """Values at the end of an array that has room to spare."""
        held, n = self.kept[name]
        if n + len(values) > len(held):
            held = np.concatenate([held[:n], np.zeros(len(values) + n // 4, held.dtype)])
        held[n:n + len(values)] = values
        self.kept[name] = held, n + len(values)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    @staticmethod
    def _parts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """First bytes of all parts: words with a space before them, and what white space is left."""
        w = ts.words(data, cuts)
        first = np.zeros(len(data) + 1, bool)
        first[cuts] = True
        inside = w.starts > cuts[w.row]
        attached = inside & (data[w.starts - 1] == 0x20)
        first[np.where(attached, w.starts - 1, w.starts)] = True
        first[w.ends] = True  # white space after a word, or the next word
        first[(w.starts - 1)[inside & ~attached]] = True  # the last of a run that doesn't end in a space stands alone
        letter = _LETTER[data]
        first[1:-1] |= letter[:-1] & ~letter[1:] & (data[1:] < 0x80)  # what follows a word's letters is never part of it
        return np.flatnonzero(first[:-1])

    def _learn(self, texts: list[bytes]) -> np.ndarray:
        """Encode new parts; their places in `first` and `size`."""
        runs, sizes = [], np.zeros(len(texts), np.int64)
        blank = [i for i, t in enumerate(texts) if not t.strip()]
        alone, order = list(blank), []
        solid = np.setdiff1d(np.arange(len(texts)), blank)
        for a in range(0, len(solid), 2000):
            part = solid[a:a + 2000]
            ids = self._ids("\n" + b"\n".join([texts[i] for i in part.tolist()]).decode())
            at = np.flatnonzero(ids == self.line)
            if len(at) != len(part):
                alone += part.tolist()
                continue
            sizes[part] = np.diff(np.append(at, len(ids))) - 1
            runs.append(ids[ids != self.line])
            order.append(part)
        for i in alone:
            runs.append(self._ids(texts[i].decode()))
            sizes[i] = len(runs[-1])
        order = np.concatenate([*order, np.array(alone, np.int64)]).astype(np.int64)
        first = np.zeros(len(texts), np.int64)
        first[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        places = len(self.first) + np.arange(len(texts))
        for name, values in (("ids", np.concatenate(runs)), ("first", first), ("size", sizes)):
            self._add(name, values)
        return places

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (ts.mix(low ^ high * _SPREAD) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries of parts (0, which is nobody's: not known), from their slot on to the first that is free."""
        known_low, known_high = self.low, self.high
        entry = self.slots[slot]
        other = np.flatnonzero((entry > 0) & ((known_low[entry] != low) | (known_high[entry] != high)))
        at = slot[other]
        while len(other):
            at = at + 1 & len(self.slots) - 1
            now = self.slots[at]
            entry[other] = now
            go = (now > 0) & ((known_low[now] != low[other]) | (known_high[now] != high[other]))
            other, at = other[go], at[go]
        return entry

    def _enter(self, slot: np.ndarray, first: int) -> None:
        """New entries, numbered from `first` on, each in the first free slot from its own on."""
        entry = first + np.arange(len(slot), dtype=np.int32)
        while len(entry):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], slot[left] + 1 & len(self.slots) - 1

    def _short(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of parts that are known by two numbers; -1 for the few whose key is another part's."""
        slot = self._slot(low, high)
        entry = self._find(slot, low, high)
        new = np.flatnonzero(entry == 0)
        if len(new):
            which = new[np.unique(ts.mix(low[new] ^ ts.mix(high[new])), return_index=True)[1]]
            places = self._learn([raw[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            known = len(self.at)
            for name, values in (("low", low[which]), ("high", high[which]), ("at", places)):
                self._add(name, values)
            if 2 * len(self.at) > len(self.slots):  # at most half of the slots are taken
                self.kept["slots"], known = np.zeros(1 << (2 * len(self.at)).bit_length(), np.int32), 1
            self._enter(self._slot(self.low[known:], self.high[known:]), known)
            entry[new] = self._find(self._slot(low[new], high[new]), low[new], high[new])
        return np.where(entry > 0, self.at[entry], -1)

    def _long(self, parts: list[bytes]) -> list[int]:
        new = [p for p in dict.fromkeys(parts) if p not in self.long]
        if new:
            self.long.update(zip(new, self._learn(new).tolist(), strict=True))
        return [self.long[p] for p in parts]

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """Ids of every document of a run."""
        raw = data.tobytes()
        odd = np.append(_wide(data), [m.start() for m in self.special.finditer(raw)]).astype(np.int64)
        aside = np.unique(np.searchsorted(cuts, odd, "right") - 1).tolist()
        parts = self._parts(data, cuts)
        ends = np.append(parts[1:], len(data))
        if aside:
            usual = np.ones(len(cuts) - 1, bool)
            usual[aside] = False
            keep = usual[np.searchsorted(cuts, parts, "right") - 1]
            parts, ends = parts[keep], ends[keep]
        if len(self.first) + len(parts) // 4 > REMEMBERED:
            self._forget()
        size = ends - parts
        short = size <= 15
        numbers = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8")
        masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

        def eight(at: np.ndarray) -> np.ndarray:
            """The eight bytes from every place on."""
            i, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
            return numbers[i] >> shift | numbers[i + 1] << np.uint64(1) << np.uint64(63) - shift

        at, n = parts[short], size[short]
        low = eight(at) & masks[np.minimum(n, 8)]
        high = n.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(n > 8)
        high[more] |= eight(at[more] + 8) & masks[n[more] - 8]
        places = np.full(len(parts), -1, np.int64)
        if len(at):
            places[short] = self._short(raw, at, ends[short], low, high)
        rest = np.flatnonzero(places < 0)
        if len(rest):
            places[rest] = self._long([raw[s:e] for s, e in zip(parts[rest].tolist(), ends[rest].tolist(), strict=True)])
        size = self.size[places]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.first[places] - upto[:-1], size) + np.arange(upto[-1])] if len(places) else np.zeros(0, np.uint32)
        out = np.split(flat, upto[np.searchsorted(parts, cuts[1:-1])]) if len(cuts) > 1 else []
        for row in aside:
            out[row] = self._ids(raw[cuts[row]:cuts[row + 1]].decode())
        return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE_BITS, at least 1 where a count is at least 1."""
    total, target = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.uint64)
    out = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * target // total), 0).astype(np.int64)
    spare = target - int(out.sum())
    order = np.argsort(-counts, kind="stable")
    if spare >= 0:
        out[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        take = min(-spare, int(out[i]) - 1)
        out[i] -= take
        spare += take
    return out.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> dict:
    """Payload words, and states with stream places at the begin and every CHECKPOINT steps."""
    n = len(ids)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW)
    scale = np.uint64(SCALE_BITS)
    limit = (LOW >> scale) << WORD
    words, marks = [], []
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes:(step + 1) * lanes]
        y, f = x[:len(part)], freq[part]
        full = y >= limit * f
        words.append((y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        y = np.where(full, y >> WORD, y)
        q = y // f
        x[:len(part)] = (q << scale) + (y - q * f) + start[part]
        if step % CHECKPOINT == 0:
            marks.append((len(words), x.copy()))
    words.reverse()
    place = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    marks.reverse()
    return {"n": n, "lanes": lanes, "payload": np.concatenate(words).tobytes() if words else b"",
            "places": [int(place[steps - m]) for m, _ in marks], "states": [s.tobytes() for _, s in marks], "crc": zlib.crc32(ids.astype("<u4").tobytes())}


def decode_part(block: dict, mark: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Ids from one checkpoint to the next."""
    n, lanes = block["n"], block["lanes"]
    words = np.frombuffer(block["payload"], np.uint32)
    x, place = np.frombuffer(block["states"][mark], np.uint64).copy(), block["places"][mark]
    first, last = mark * CHECKPOINT, min(-(-n // lanes), (mark + 1) * CHECKPOINT)
    out, scale, low = [], np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    for step in range(first, last):
        y = x[:min(lanes, n - step * lanes)]
        slot = y & low
        ids = symbol[slot]
        y = freq[ids] * (y >> scale) + slot - start[ids]
        need = y < LOW
        k = int(need.sum())
        y[need] = y[need] << WORD | words[place:place + k].astype(np.uint64)
        place += k
        x[:len(y)] = y
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the data set below `folder` (a path of Spark's file system)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def tokenise():
        tokens, upto = Tokens(spec.value), 0
        part = TaskContext.get().partitionId()

        def step(batch):
            nonlocal upto
            names = column(batch, "id")
            for a, b, data, cuts in ts.pieces(column(batch, "t")):
                ids = [x.tobytes() + end for x in tokens.encode(data, cuts)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                first = upto + np.cumsum(n) - n
                upto += int(n.sum())
                yield {"part": np.full(len(n), part, np.int32), "first": first, "id": names.slice(a, b - a), "n": n, "ids": ids}
        return step

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(pieces, "id").sortWithinPartitions("id")
    arrow(ordered, tokenise, "part int, first long, id long, n long, ids binary").write.parquet(f"{folder}/ids")
    ids = spark.read.schema("part int, first long, id long, n long, ids binary").parquet(f"{folder}/ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, _ in ts.pieces(batch.column(0)):
                found = np.bincount(data.view(np.uint32))
                if len(found) > len(total):
                    found, total = total, found
                total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(at, pa.int64()), "c": pa.array(total[at], pa.int64())})

    counts = ids.select("ids").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    table = {r.token: r.c for r in counts.collect()}  # one entry per vocabulary item
    flat = np.zeros(max(table, default=0) + 1, np.int64)
    flat[list(table)] = list(table.values())
    freq = scaled(flat)
    spark.createDataFrame([(SCALE_BITS, freq.astype("<u8").tobytes())], "scale_bits int, frequencies binary").write.parquet(f"{folder}/frequencies")
    ids.groupBy("part").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/parts")
    shared = spark.sparkContext.broadcast((freq, _starts(freq)))

    def pack():
        freq, start = shared.value

        def block(part, first, names, n, flat):
            coded = encode_block(flat, freq, start)
            return {k: [v] for k, v in coded.items()} | {"part": [part], "first": [first], "ids": [names], "sizes": [n]}

        def step(batch):
            part, first, n = (column(batch, c).to_numpy() for c in ("part", "first", "n"))
            names, held = column(batch, "id").to_pylist(), column(batch, "ids")
            a = 0
            for i in range(len(n)):
                size = int(n[a:i + 1].sum()) if i + 1 < len(n) else BLOCK_TOKENS
                if size >= BLOCK_TOKENS or part[i + 1] != part[i] or first[i + 1] != first[i] + n[i]:
                    flat = np.frombuffer(b"".join(held.slice(a, i + 1 - a).to_pylist()), np.uint32)
                    yield block(int(part[a]), int(first[a]), names[a:i + 1], n[a:i + 1].tolist(), flat)
                    a = i + 1
        return step

    arrow(ids, pack, "part int, first long, ids array<long>, sizes array<long>, n long, lanes int, payload binary, places array<long>, states array<binary>, crc long"
          ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, start (tokens before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    freq = np.frombuffer(spark.read.parquet(f"{folder}/frequencies").first().frequencies, "<u8").astype(np.uint64)
    before, offsets = 0, {}
    for row in spark.read.parquet(f"{folder}/parts").orderBy("part").collect():  # one row per range of ids
        offsets[row.part] = before
        before += row.n
    shared = spark.sparkContext.broadcast((freq, _starts(freq), np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)), offsets))

    def unpack():
        freq, start, symbol, offsets = shared.value

        def step(batch):
            for i in range(batch.num_rows):
                block = {c: column(batch, c)[i].as_py() for c in batch.schema.names}
                parts = [decode_part(block, m, freq, start, symbol) for m in range(len(block["states"]))]
                ids = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
                if zlib.crc32(ids.tobytes()) != block["crc"]:
                    raise ValueError(f"checksum of block {block['part']}, {block['first']}")
                n = np.array(block["sizes"], np.int64)
                cut = np.concatenate([[0], np.cumsum(n)])
                yield {"id": block["ids"], "start": offsets[block["part"]] + block["first"] + cut[:-1], "n_tokens": n,
                       "ids": [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]}
        return step

    blocks = spark.read.schema("part int, first long, ids array<long>, sizes array<long>, n long, lanes int, payload binary, places array<long>, states array<binary>, crc long"
                               ).parquet(f"{folder}/blocks")
    return arrow(blocks, unpack, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_column)


def through_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
