"""The pipeline against its stages done by brute force."""

import brute
import corpus_pipeline
from fathomgrid.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.QUERIES) <= names


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    one = stage("language_id")(spark, docs, SMALL)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}

    texts = [(i, r.text) for i, r in rows.items()]
    two = stage("ngram_jaccard")(spark, docs, SMALL)
    assert sorted(map(tuple, two.collect())) == sorted(tuple(rows[i]) for i, (_, c) in brute.near_duplicates(texts).items() if i == c)

    three = {r.doc_id: r for r in stage("substring_dedup")(spark, docs, SMALL).collect()}
    for i, (_, removed, digest) in brute.substring(texts).items():
        import hashlib
        text = three[i].text
        assert text == rows[i].text if not removed else hashlib.sha256(text.encode()).hexdigest() == digest
        assert three[i].n_chars == len(text) and (three[i].lang, three[i].source) == (rows[i].lang, rows[i].source)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.contaminated(texts, items)}
    four = stage("decontamination")(spark, docs, SMALL)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == set(rows) - leaked


def test_stages_on_odd_documents(spark, odd, nothing):
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, odd, SMALL)
        assert out.count() <= odd.count() and "doc_id" in out.columns
        assert fn(spark, nothing, SMALL).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[:2] == ["doc_id", "n_tokens"] and 0 < got.count() < spark.read.parquet(f"{SMALL}/documents.parquet").count()
