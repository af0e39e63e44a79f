"""Byte-pair encoding and decoding as a bounded-lookahead stream (operator 2).

A merge list has a sufficient lookahead: whether a merge happens depends on at most that many symbols to the right of it.
`lookahead` computes it from the list (in rank order: a token can only be contested by higher-ranking merges that begin with
its right part). A word is read in windows; tokens that end at least the lookahead before the end of a window are stable and
are emitted, the rest starts the next window. Memory is constant however long a word is. All windows of a batch are merged
together: rows of equal length are one matrix, and every step merges each row's best pair.

Decoding feeds token bytes to an incremental UTF-8 state machine and hands out text as soon as it is whole.

The file is that of the tokenizers library (a BPE model with byte-level symbols, or with an end-of-word suffix); its path is
a parameter. It is read by the driver and broadcast: its size does not depend on the corpus. Null and empty texts have no
tokens and decode to the empty text. Repeated rows are each encoded. Extra columns are left alone.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.frames import Shared, arrow, column

#: what the library's \s matches; Python's own split also takes U+001C to U+001F
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{WHITE}]+")
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
WINDOW = 64
REMEMBERED = 200_000
PIECE_CHARS = 500_000
ROWS = 500
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Symbols to the right of a token that can decide it: merges are (left, right, merged) in rank order."""
    contest: dict[int, int] = {}
    reach: dict[int, int] = {}  # furthest look of the merges so far that begin with a token
    most = 0
    for left, right, merged in merges:
        beyond = max(contest.get(right, 0), reach.get(right, 0))
        contest[merged] = max(contest.get(merged, 0), beyond)
        reach[left] = max(reach.get(left, 0), size[right] + beyond)
        most = max(most, size[right] + beyond)
    return most


class Codec:
    """What the tokenizer file says, ready for the workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        back = {v: k for k, v in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = {i: len(s) - (len(self.suffix) if self.suffix and s.endswith(self.suffix) and s != self.suffix else 0) for i, s in back.items()}
        self.size = np.array([size.get(i, 1) for i in range(max(back) + 1)], np.int32)
        self.lookahead = lookahead(rules, size)
        keys = np.array([a << 32 | b for a, b, _ in rules], np.int64)
        ranks = np.arange(len(rules), dtype=np.int32)
        order = np.lexsort((ranks, keys))
        keys, ranks = keys[order], ranks[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks, self.merged = keys[new], ranks[new], np.array([m for _, _, m in rules], np.int32)
        #: without a decoder the library joins vocabulary strings by spaces; with the byte-level one it joins their bytes
        self.spaced = spec.get("decoder") is None
        value = {s: b for b, s in enumerate(symbols)}
        plain = {i for i in self.special.values()}
        self.pieces = [back.get(i, "").encode() if self.spaced or i in plain else bytes(value[c] for c in back.get(i, "")) for i in range(max(back) + 1)]


class Encoder:
    """Word-wise encoding: lower case and Unicode NFC, white space dropped, words ended by the suffix."""

    def __init__(self, codec: Codec):
        import regex
        self.codec, self.known = codec, {}
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.specials = re.compile("|".join(map(re.escape, codec.special))) if codec.special else None

    def _ranks(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.int64) << 32 | rows[:, 1:]
        at = np.minimum(np.searchsorted(self.codec.keys, pairs), len(self.codec.keys) - 1)
        return np.where(self.codec.keys[at] == pairs, self.codec.ranks[at], _NONE)

    def merge(self, rows: dict[int, tuple[np.ndarray, np.ndarray]]):
        """Fully merge rows of symbols, given by length as (row names, matrix): always the best pair, the leftmost of equals.

        Rows that have no pair left come out as (row names, matrix of tokens).
        """
        names, live = np.zeros(0, np.int64), None
        for n in range(max(rows, default=0), 0, -1):
            if n in rows:
                own, fresh = rows[n]
                live = np.concatenate([live, fresh]) if len(names) else fresh
                names = np.concatenate([names, own])
            if n == 1 or not len(names):
                if len(names):
                    yield names, live
                continue
            ranks = self._ranks(live)
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            go = best != _NONE
            if not go.all():
                yield names[~go], live[~go]
                names, live, at, best = names[go], live[go], at[go], best[go]
            columns = np.arange(n - 1)
            live = np.take_along_axis(live, columns + (columns > at[:, None]), axis=1)
            live[np.arange(len(live)), at] = self.codec.merged[best]

    def _windows(self, parts: list[bytes], ends: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols by length; `ends` marks parts that end their word."""
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(sizes, kind="stable")
        lengths, first = np.unique(sizes[order], return_index=True)
        out = {}
        for n, names in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
            raw = np.frombuffer(b"".join([parts[i] for i in names.tolist()]), np.uint8).reshape(-1, n)
            rows = self.codec.first[raw]
            rows[:, -1] = np.where(ends[names], self.codec.last[raw[:, -1]], rows[:, -1])
            out[n] = names, rows
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word (not empty), each read as a stream of windows."""
        window = max(WINDOW, 4 * self.codec.lookahead)
        out: list[bytes] = [b""] * len(words)
        open_ = [(i, 0) for i in range(len(words))]
        while open_:
            parts = [words[i][start:start + window] if start or len(words[i]) > window else words[i] for i, start in open_]
            ends = np.array([start + len(p) == len(words[i]) for (i, start), p in zip(open_, parts, strict=True)])
            still = []
            for names, tokens in self.merge(self._windows(parts, ends)):
                raw, width = tokens.tobytes(), 4 * tokens.shape[1]
                for k, row in enumerate(names.tolist()):
                    i, start = open_[row]
                    if ends[row]:
                        out[i] += raw[k * width:(k + 1) * width]
                    else:
                        reach = np.cumsum(self.codec.size[tokens[k]])
                        stable = int(np.searchsorted(reach, window - self.codec.lookahead, "right"))
                        out[i] += raw[k * width:k * width + 4 * stable]
                        still.append((i, start + int(reach[stable - 1])))
            open_ = still
        return out

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known.clear()
        words, counts = [], []
        for chunk in chunks:
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
            text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
            found = [text] if text.isascii() and text.isalpha() else self.word.findall(text)
            words += [w.encode() for w in found]
            counts.append(len(found))
        runs, at = self.words(words), 0
        for chunk, n in zip(chunks, counts, strict=True):
            self.known[chunk] = runs[at] if n == 1 else b"".join(runs[at:at + n])
            at += n

    def _chunks(self, text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACE):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        split = []
        for text in texts:
            if self.specials and "<" in text and self.specials.search(text):
                parts, at = [], 0
                for m in self.specials.finditer(text):
                    parts += [*self._chunks(text[at:m.start()]), self.codec.special[m.group()]]
                    at = m.end()
                split.append([*parts, *self._chunks(text[at:])])
            else:
                split.append(self._chunks(text))
        new = {c for chunks in split for c in chunks if c not in self.known}
        ids = {c for c in new if isinstance(c, int)}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {c for chunks in split for c in chunks}
            ids = {c for c in new if isinstance(c, int)}
        for i in ids:
            self.known[i] = int(i).to_bytes(4, "little")
        self._learn(list(new - ids))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


class Decoder:
    """Incremental bytes-to-text machine over token ids."""

    STEP = 65536

    def __init__(self, codec: Codec):
        self.codec = codec

    def stream(self, ids: np.ndarray):
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get, between = self.codec.pieces.__getitem__, b" " if self.codec.spaced else b""
        for start in range(0, len(ids), self.STEP):
            part = between.join(map(get, ids[start:start + self.STEP].tolist()))
            yield machine.decode((between if start else b"") + part)
        yield machine.decode(b"", True)


def _rows(batch: pa.RecordBatch):
    """Ids and texts of runs of rows of about `PIECE_CHARS`; a few rows at a time become Python strings."""
    names, column_ = column(batch, "id"), column(batch, "t")
    for first in range(0, len(column_), ROWS):
        texts = [t or "" for t in column_.slice(first, ROWS).to_pylist()]
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= PIECE_CHARS or i == len(texts) - 1:
                yield names.slice(first + start, i + 1 - start), texts[start:i + 1]
                start, size = i + 1, 0


def load(spark, path: str):
    return Shared(spark, Codec(path))


def encode(docs: DataFrame, codec, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit)."""
    def make():
        encoder = Encoder(codec.value)

        def step(batch):
            for names, texts in _rows(batch):
                done = encoder.encode(texts)
                yield {"id": names, "n_tokens": [len(x) // 4 for x in done], "ids": done}
        return step

    return arrow(docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("t")), make,
                 f"id {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, codec, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: id, decoded (the library's `decode` without skipping special tokens)."""
    def make():
        decoder = Decoder(codec.value)

        def step(batch):
            names, rows = column(batch, "id"), column(batch, "ids").to_pylist()
            for i, row in enumerate(rows):
                yield {"id": names.slice(i, 1), "decoded": ["".join(decoder.stream(np.frombuffer(row or b"", np.uint32)))]}
        return step

    return arrow(encoded.select(F.col(id_column).alias("id"), F.col(ids).alias("ids")), make,
                 f"id {encoded.schema[id_column].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, codec, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one scan: id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256."""
    def make():
        encoder, decoder = Encoder(codec.value), Decoder(codec.value)

        def digest(ids: bytes) -> str:
            sums = hashlib.sha256()
            for part in decoder.stream(np.frombuffer(ids, np.uint32)):
                sums.update(part.encode())
            return sums.hexdigest()

        def step(batch):
            for names, texts in _rows(batch):
                done = encoder.encode(texts)
                yield {"id": names, "n_tokens": [len(x) // 4 for x in done], "ids": done, "ids_sha256": [hashlib.sha256(x).hexdigest() for x in done],
                       "decoded_sha256": [digest(x) for x in done]}
        return step

    return arrow(docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("t")), make,
                 f"id {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
