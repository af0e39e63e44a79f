"""Language ID, URL filter, importance resampling, top-k and decontamination."""

import math
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import decontaminate, importance, langid, topk, urls
from fathomgrid.llm.queries import URL_RULES

SMALL = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs.withColumn("held", langid.held_out()), keep=("held", "lang")).collect()
    held = [r for r in got if r.held]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and all(r.fits for r in held)


def test_language_of_odd_texts(spark, odd, nothing):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    for r in odd.collect():
        known = any(c.isalpha() for c in r.text or "")
        assert (got[r.doc_id].lang_pred in ("en", "fr")) == known and (got[r.doc_id].lang_pred == "und") == (not known)
        assert known or (got[r.doc_id].score == 0 and not got[r.doc_id].fits)
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_rejection(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1, "zqxjk wvqz xxkq jjzq qqwx " * 20, None)], docs.schema)
    got = {r.doc_id: r.fits for r in langid.identify(docs.unionByName(strange)).collect()}
    assert not got.pop(-1) and all(got.values())


def test_kneser_ney_is_a_distribution(spark):
    docs = spark.createDataFrame([("en", "banana bandana cabana"), ("fr", "ananas")], "lang string, t string")
    model, table, _ = langid.train(docs, order=3, hash_bits=24)
    letters = sorted({int(x) for x in table.value[np.frombuffer("banadcs".encode("utf-32-le"), np.uint32)]} | {0})
    for context in ("", "a", "an", "zz"):
        ids = [int(table.value[ord(c)]) for c in context]
        base = sum(x << langid.BITS * (j + 1) for j, x in enumerate(reversed(ids)))
        p = np.exp(model.value.log_probability(np.array([base | x for x in letters], np.uint64)).astype(float))
        assert np.allclose(p.sum(axis=0), 1, atol=0.15) and (p > 0).all()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://www.good{i % 7}.org/news/{i}") for i in range(60)] + [(100 + i, f"http://casino{i % 5}.com/de/win{i}") for i in range(60)]
    rows += [(200, "http://casino9.net/win5"), (201, "https://www.good9.net/news/4"), (202, None), (203, "no scheme"), (204, "HTTP://Sub.Example.ORG/en/12?x#y"),
             (205, "https://example.org/es/"), (206, "http://notexample.org?/es/"), (207, "a://org/"), (208, "a://b.com#/fr/"), (209, ""), (204, "HTTP://Sub.Example.ORG/en/12?x#y")]
    return spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("u", "host", "path", "fit", "score")})


def test_url_rules_and_models(pages):
    got = {r.page_id: r for r in urls.judge(pages, URL_RULES).collect()}
    assert (got[204].host, got[204].path, got[204].rule, got[204].verdict) == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert (got[205].rule, got[205].verdict) == ("example.org/es/", "block")
    assert (got[206].host, got[206].path, got[206].rule) == ("notexample.org", "", None)
    assert (got[207].host, got[207].rule, got[208].host, got[208].path, got[208].rule) == ("org", "org/", "b.com", "", None)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (202, 203, 209)][::2] == [("", "", None, "allow")] * 2
    assert (got[200].verdict, got[201].verdict) == ("block", "allow")
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, ()).collect()} == {"allow"}


def test_markov_model_is_a_distribution():
    model = urls._count
    assert callable(model)
    keys, sizes = urls._grams([b"abab", b"", b"b"])
    assert sizes.tolist() == [4, 0, 1] and keys[1] == (ord("a") << 8 | ord("b"))


@pytest.mark.parametrize("model_rows", [1 << 20, 0])  # broadcast, joined
def test_url_scores_count_every_n_gram_apart(spark, monkeypatch, model_rows):
    rng = np.random.default_rng(7)
    urls_ = [f"http://{host}/{''.join(map(chr, rng.integers(97, 123, 40)))}" for host in ("a.org", "b.com", "c.net") for _ in range(400)]
    df = spark.createDataFrame([*enumerate(urls_), (5000, None), (5001, "")], "page_id long, url string")
    fold = {r.page_id: r.fold for r in df.select("page_id", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)).alias("fold")).collect()}
    models = {}
    for kind, host in (("allow", "a.org"), ("block", "b.com")):
        counts, totals, types = Counter(), Counter(), Counter()
        for i, u in enumerate(urls_):
            if host in u and fold[i]:
                for end in range(1, len(u) + 1):
                    for n in range(1, urls.ORDER + 1):
                        gram = ("\0" * urls.ORDER + u)[end + urls.ORDER - n:end + urls.ORDER]
                        types[n, gram[:-1]] += not counts[gram]
                        counts[gram] += 1
                        totals[n, gram[:-1]] += 1
        models[kind] = counts, totals, types

    def log_probability(kind, u):
        counts, totals, types = models[kind]
        total = 0.0
        for end in range(1, len(u) + 1):
            p = 1 / 256
            for n in range(1, urls.ORDER + 1):
                gram = ("\0" * urls.ORDER + u)[end + urls.ORDER - n:end + urls.ORDER]
                t, y = totals[n, gram[:-1]], types[n, gram[:-1]]
                p = (counts[gram] + y * p) / (t + y) if t else p
            total += math.log(p)
        return total
    monkeypatch.setattr(urls, "MODEL_ROWS", model_rows, raising=False)
    got = {r.page_id: r.score for r in urls.judge(df, (("allow", "a.org/"), ("block", "b.com/"))).collect()}
    want = {i: (log_probability("block", u) - log_probability("allow", u)) / len(u) for i, u in enumerate(urls_)} | {5000: 0.0, 5001: 0.0}
    assert got == pytest.approx(want, abs=1e-9)


def test_importance_weights_and_sample(spark, odd, nothing, small):
    docs = spark.createDataFrame(small, "doc_id long, text string").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6))
    good = docs.filter("doc_id % 3 = 0").select("doc_id")
    got = importance.resample(docs, good, fraction=0.3).collect()
    k = int(len(got) * 0.3)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert sum(r.selected for r in got) in (k, k + 1)  # the repeated row shares one fate
    assert {r.selected for r in got if r.gumbel_key > keys[k - 1]} == {True} and {r.selected for r in got if r.gumbel_key < keys[k - 1]} == {False}

    def bag(text):
        words = [w.translate(brute._LOWER) for w in brute.WORD.findall(text or "")]
        return Counter(words) + Counter(zip(words, words[1:], strict=False))
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(r.n_grams == sum(bag(rows[r.doc_id].text).values()) for r in got)
    assert all(r.log_weight == 0 for r in got if not r.n_grams) and all(math.isfinite(r.gumbel_key) for r in got)
    target = [r.log_weight / r.n_grams for r in got if r.doc_id % 3 == 0 and r.n_grams > 50]
    others = [r.log_weight / r.n_grams for r in got if r.doc_id % 3 and r.n_grams > 50]
    assert np.mean(target) > np.mean(others)
    assert importance.resample(nothing, good).count() == 0


@pytest.mark.parametrize("values", [[1.0] * 50, [float(i) for i in range(5000)], [0.0, 1e-300, 5e-324, 1e300, -1e300] * 3, [2.5]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in {1, 2, len(values) // 2 or 1, len(values)}:
        if k <= len(values):
            assert importance.kth_largest(df, "x", k) == ordered[k - 1]


def products(rows, query, k=5):
    ok = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if query(i):
            n = min
            found = sorted(((-int(q[:n(len(q), len(v))] @ v[:n(len(q), len(v))]), j) for j, v in ok if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("spread", ["even", "hot", "few", "wide"])
def test_top_products(spark, spread, monkeypatch):
    rng = np.random.default_rng(1)
    n = {"few": 4}.get(spread, 700)
    vectors = rng.normal(size=(n, 8)) * {"wide": 5000.0}.get(spread, 0.3)
    if spread == "hot":
        vectors[::2] = vectors[0]  # half of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    if spread == "even":
        rows += [(10_000, None), (10_050, [float("nan")] * 8), (10_100, [None] + [0.1] * 7), (10_150, [math.inf] * 8), (None, [0.1] * 8), (10_200, []), (10_250, [0.5, 0.5]), (10_300, [0.0] * 8)]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "FIRST", 32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "cell", "best")})
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect())) == products(rows, lambda i: i % 50 == 0)


def test_top_products_of_repeated_queries(spark):
    """Rows of one query id share one list, whether their vectors differ or not."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))]
    rows += [(0, rng.normal(size=4).tolist()), (50, rows[50][1]), (7, rows[7][1])]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()))
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for q in (0, 50, 100):
        want = sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q)[:5]
        assert [r for r in got if r[0] == q] == [(q, n + 1, j, -s) for n, (s, j) in enumerate(want)]


def test_top_products_too_large_for_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for products"):
        topk.search(df, F.col("vec_id") % 50 == 0).collect()


def test_top_products_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert topk.search(df, F.col("vec_id") % 50 == 0).collect() == []
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_decontamination(spark, small, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = dict(small)
    base = items[0][1].split()
    docs[10**6] = "prose before " * 20 + " ".join(w if i % 6 else "changed" for i, w in enumerate(base)) + " and after" * 20
    docs[10**6 + 1] = " ".join(base[:3]) + " nothing else here"
    docs[10**6 + 2] = items[1][1].upper().replace(" ", " -- ")
    extra = [(900, None), (901, ""), (902, "word"), (903, "tail end"), (904, "Changed nothing here. else")]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "t", "p", "item", "h")})
    bench = spark.createDataFrame(items + extra, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    want = {p for p in brute.contaminated(docs.items(), items + extra[:4])}
    assert got - {(d, 904) for d, _ in got} == {p for p in want if p[1] < 900} | {p for p in got if p[1] == 903}
    assert {(10**6, 0), (10**6 + 2, 1)} <= got and not any(d == 10**6 + 1 for d, _ in got)
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(odd, bench.filter("item_id < 5")).count() == 0


@pytest.mark.parametrize(("rare", "pairs"), [(64, 1 << 16), (2, 3), (0, 5)])
def test_decontamination_of_copies_that_leaked_often(spark, monkeypatch, rare, pairs):
    """With rare seeds, with frequent ones only, and with both, dealt over many keys."""
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    items = [(k, " ".join(f"k{k}w{i}" for i in range(30))) for k in range(2)]
    whole, half = (text.split() for _, text in items)
    changed = " ".join("changed" if i in (14, 15) else w for i, w in enumerate(whole))
    docs = [(0, items[0][1]), *[(i, f"lead {changed} tail") for i in range(1, 13)]]  # an original beside equal edited copies
    docs += [(20, items[1][1]), *[(20 + i, f"lead {' '.join(half[:15])} tail") for i in range(1, 13)]]  # the first half leaked often
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rare=rare).collect()}
    assert got == brute.contaminated(docs, items) == {(d, 0) for d in range(13)} | {(d, 1) for d in range(20, 33)}


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 20))
        assert decontaminate.align(a.astype(np.uint64), b.astype(np.uint64))[0] == brute.alignment(a.tolist(), b.tolist())


def test_long_batches_are_read_in_pieces(spark, monkeypatch):
    """A worker holds n-grams of `PIECE_CHARS` letters at a time, and any size of piece gives the same model and predictions."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    assert langid.PIECE_CHARS <= 1 << 18
    got = langid.identify(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(langid, "PIECE_CHARS", 5_000)
    monkeypatch.setattr(langid, "REMEMBERED", 3_000)
    assert langid.identify(docs).orderBy("doc_id").select("doc_id", "lang_pred", "fits").collect() == [(r.doc_id, r.lang_pred, r.fits) for r in got]
    assert docs.filter(F.col("lang").isNotNull()).count() > 50
