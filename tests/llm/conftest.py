import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents as rows (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Texts with every awkward case, with extra columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977}x{i // 13}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", " \t\n ", "one", "two words", "Ärger mit é", long, long, long + " end", f"before it {passage} after", f"other {passage}",
             passage, passage.upper(), "x" * 40_000, "ab " * 3_000, "the same text again and again " * 30, "the same text again and again " * 30,
             "<|endoftext|> 12²3 it's  we'll", "tail\r\n\x1c\x1f　end", "ΣΑΣ İ ß"]
    rows = [(i * 3, t, "en" if i % 2 else "fr", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((rows[-1][0], *rows[-1][1:]))  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(7) for c in ("id", "t", "n", "s", "h", "token", "start", "part", "first", "kept", "score", "fits")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
