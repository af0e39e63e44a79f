"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Language ID -> n-gram Jaccard join -> substring dedup -> benchmark decontamination -> BPE. Every stage takes
(spark, docs, sf_dir); `run` writes each result as Parquet to shared storage, removes what the stage stored on its way, and
reads the result as the next one's input. Copies and contaminated documents are dropped by id: repeated rows of one id stay or
go together, and rows with a null id stay in those two stages. All
stages but the last return the columns of `documents` (extra ones are dropped).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import bpe, decontaminate, langid, ngram_join, sketch, substring
from fathomgrid.llm.frames import staged, stored, table
from fathomgrid.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL cannot express the language models or the alignment; the tests compare with a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like their most likely language; without letters, or far from every language, they go."""
    return langid.identify(docs, keep=COLUMNS[1:]).filter("fits").select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    copies = ngram_join.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return sketch.without(docs.select(*COLUMNS), stored(copies, "copies"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word windows that stand earlier; untouched texts keep their white space."""
    kept = substring.remove_repeats(docs, keep=COLUMNS[2:4], as_is=True).withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with the digest of what they decode to."""
    return bpe.round_trip(docs, bpe.load(spark, tokenizer("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("bpe", bpe_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, name, partial(stage, spark, docs, sf_dir))
    return docs
