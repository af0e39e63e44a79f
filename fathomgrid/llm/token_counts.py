"""Token counts of a piece model without encoding most words (operator 13).

A sentencepiece BPE model turns spaces into marks, puts one before the text and merges neighbouring pieces. Where no piece
holds a mark behind another character, no merge crosses from a word to the next mark, so the text falls apart exactly into
pre-tokens: marks, then what follows them up to the next mark. `prove` checks this on the model (its kind, its
normalisation, every piece), and then which pieces encode alone as themselves; nothing is learnt from the documents. A
pre-token among those counts as one token by a set lookup; only the rest is merged by the library, and short ones are
remembered within a task (at most `REMEMBERED`). A model that can't be proven to fall apart is left to the library text by text.

Null and empty texts have no tokens and no bytes. Strings that look like special tokens or byte pieces are plain text to
the library, and so here. Repeated rows keep a row each; null ids stay null; extra columns play no part; an empty table
gives no rows. Long texts are read in chunks that end before a mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.frames import Shared, arrow, column, text_runs

MARK = "▁"
CHUNK = 1 << 20
REMEMBERED, SHORT = 200_000, 48


def prove(model: bytes) -> frozenset[str] | None:
    """The pre-tokens (without their first mark, other marks as spaces) that are one token; None: texts don't fall apart."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    norm, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if not plain or spec.trainer_spec.model_type != spec.trainer_spec.BPE or spec.trainer_spec.treat_whitespace_as_suffix:
        return None
    if any(MARK in p.piece.lstrip(MARK) or p.type == kinds.USER_DEFINED for p in spec.pieces):
        return None
    pieces = SentencePieceProcessor(model_proto=model)
    alone = set()
    for i, p in enumerate(spec.pieces):
        if p.type == kinds.NORMAL and p.piece.startswith(MARK):
            rest = p.piece[1:].replace(MARK, " ")
            if not rest or pieces.encode(rest) == [i]:  # a single character has nothing to merge with
                alone.add(rest)
    return frozenset(alone)


class _Costs(dict):
    """Tokens of the pre-tokens that need merging."""

    def __init__(self, pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, part: str) -> int:
        if part:
            n = len(self.pieces.encode(part))
        else:  # a lone mark that is no piece: what it adds behind a letter
            n = len(self.pieces.encode("a ")) - len(self.pieces.encode("a"))
        if len(part) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n


class Counter:
    """Counts of one task."""

    _doubled, _parts, _border = re.compile("  "), re.compile(" +[^ ]*"), re.compile("(?<=[^ ]) ")

    def __init__(self, model: bytes, alone: frozenset[str] | None):
        from sentencepiece import SentencePieceProcessor
        self.pieces, self.alone = SentencePieceProcessor(model_proto=model), alone
        self.costs = _Costs(self.pieces)

    def _chunks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK:
            border = self._border.search(text, start + CHUNK)
            if border is None:
                break
            yield text[start:border.start()]
            start = border.start()
        yield text[start:]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.alone is None:
            return len(self.pieces.encode(text))
        total, alone = 0, self.alone
        for chunk in self._chunks(" " + text.replace(MARK, " ")):
            if self._doubled.search(chunk):
                parts = [p[1:] for p in self._parts.findall(chunk)]
            else:
                parts = chunk[1:].split(" ")
            rest = [p for p in parts if p not in alone]
            total += len(parts) - len(rest) + sum(map(self.costs.__getitem__, rest))
        return total


def load(spark, path: str) -> Shared:
    """The model and what is proven about it, for `count`; bounded by the vocabulary."""
    with open(path, "rb") as f:
        model = f.read()
    return Shared(spark, (model, prove(model)))


def count(docs: DataFrame, model: Shared, limit: int = 4096, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit."""
    def make():
        counter = Counter(*model.value)

        def step(batch):
            start = 0
            sizes = column(batch, "n_bytes")
            for names, texts in text_runs(column(batch, "id"), column(batch, "t")):
                yield {"id": names, "n_bytes": sizes.slice(start, len(texts)), "n_tokens": [counter.count(t) for t in texts]}
                start += len(texts)
        return step

    t = F.col(text).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), t.alias("t"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"))
    counted = arrow(rows, make, f"id {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
