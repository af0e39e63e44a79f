"""Near duplicates, word windows and byte strings against brute force."""

import hashlib
import random
import re

import brute
import numpy as np
import pytest

from fathomgrid.llm import components, ngram_join, sketch, substring, suffix


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"edit{rng.random():.6f}" for w in base)


@pytest.fixture(scope="module")
def families(spark):
    """Near copies of a few texts at many distances, exact copies, and a passage in many documents."""
    rng = random.Random(5)
    docs = []
    for f in range(4):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        docs += [edited(rng, base, rng.choice([0, 0, 0.01, 0.02, 0.04, 0.1])) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(70))
    docs += [f"lead{i} {passage} tail{i}" if i % 2 else f"{passage} {i}" for i in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def near(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, **options).collect()}


def test_near_duplicates(spark, families):
    df = spark.createDataFrame(families, "doc_id long, text string")
    want = brute.near_duplicates(families)
    assert near(df) == want
    assert near(df, percent=50) == brute.near_duplicates(families, percent=50)
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("percent", [80, 50])
def test_links(spark, families, percent):
    df = spark.createDataFrame(families, "doc_id long, text string")
    classes = {r.class_id: brute.shingles(families[r.doc_id][1]) for r in ngram_join.near_duplicates(df, percent=percent).collect()}
    want = [(a, b) for a, x in classes.items() for b, y in classes.items() if a < b and 100 * len(x & y) >= percent * len(x | y)]
    got = [tuple(r) for r in ngram_join.links(df, percent=percent).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("log2_counters", [1, 4])
def test_near_duplicates_when_the_frequency_sketch_is_full(spark, families, log2_counters):
    df = spark.createDataFrame(families, "doc_id long, text string")
    assert near(df, log2_counters=log2_counters) == brute.near_duplicates(families)


def test_frequency_levels(spark):
    """Levels are powers of two of the counts, from half the mean load of a cell on; cells far apart are counted too."""
    import numpy as np
    import pyarrow as pa

    from fathomgrid.llm import sketch
    rng = np.random.default_rng(1)
    values = rng.permutation(np.repeat(np.arange(40), 1 << np.arange(40) % 10))
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(3)
    for log2_width in (2, 22):
        sizes = sketch.magnitudes(df, lambda: lambda batch: [batch.column(0).to_numpy().view(np.uint64)], log2_width).value
        names = np.arange(40).astype(np.uint64)
        place = sketch.slot(names, 0, log2_width)
        counts = np.bincount(place, np.float64(1 << np.arange(40) % 10))[place]
        least = max(0, (len(values) >> log2_width).bit_length() - 2)
        assert sizes.of(names).tolist() == np.clip(np.log2(counts + 1).astype(int) - least, 0, 15).tolist()
    empty = sketch.magnitudes(df.limit(0), lambda: lambda batch: [pa.array([]).to_numpy()], 4).value
    assert not empty.cells.any()


def test_near_duplicates_of_odd_texts(odd, nothing):
    assert near(odd) == brute.near_duplicates(rows_of(odd))
    assert near(nothing) == {}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def windows(df, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("log2_width", [None, 3])  # a sketch of eight counters thinks everything repeats
def test_word_windows(spark, families, log2_width):
    df = spark.createDataFrame(families, "doc_id long, text string")
    assert windows(df, log2_width=log2_width) == brute.substring(families)


def test_word_windows_of_odd_texts(odd, nothing):
    got, want = windows(odd, k=5), brute.substring(dict(rows_of(odd)).items(), k=5)
    assert got == want
    assert windows(nothing) == {}
    assert "kept_0" not in odd.columns and substring.remove_repeats(odd, keep=("n_chars",)).columns[-1] == "kept_sha256"


def strings(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("crowded", [2000, 1])
def test_byte_strings(spark, families, crowded):
    docs = families[:60]
    assert strings(spark.createDataFrame(docs, "doc_id long, text string"), crowded=crowded) == brute.suffixes(docs)


@pytest.mark.parametrize("crowded", [2000, 1])
def test_byte_strings_whose_segments_share_part_of_a_hash(spark, crowded):
    """In each pair the last segments have one anchor and equal upper 36 bits of content hash, but different bytes."""
    pairs = [(243348, 247047), (36713, 309888), (74929, 628489), (552064, 557831)]
    docs = [(i, f"a passage of boilerplate that stands in very many documents: {i:07d}") for pair in pairs for i in pair]
    assert strings(spark.createDataFrame(docs, "doc_id long, text string"), crowded=crowded) == brute.suffixes(docs)


def test_byte_strings_of_odd_texts(odd, nothing):
    assert strings(odd) == brute.suffixes(rows_of(odd))
    assert strings(nothing) == {}


def test_refined_buckets_are_equal_strings():
    import numpy as np
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    for k in (3, 8, 21, 50):
        bucket = suffix.refine(text, k)
        by_text = {}
        for i in range(len(text) - k + 1):
            assert by_text.setdefault(text[i:i + k].tobytes(), bucket[i]) == bucket[i]
        assert len(set(by_text.values())) == len(by_text)


def test_suffix_rows_of_one_id(spark):
    """Rows that share an id but not their text, mixed anchors among them, and rows without an id."""
    passage = " ".join(f"shared{i}" for i in range(40))
    docs = [(1, f"start {passage[:120]} middle {passage[100:]}"), (5, f"five {passage}"), (5, "five"), (5, passage[60:220] + " other end"),
            (5, f"{passage} and {passage}"), (7, passage[30:200]), (None, passage), (9, f"x{passage[:90]}y{passage[:90]}z"), (9, passage[80:])]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = []
    for name, text in docs:
        raw, gone = text.encode(), set()
        for i in range(len(raw) - 49):
            if name is not None and any(raw[i:i + 50] in t.encode() for other, t in docs if other is not None and other < name):
                gone.update(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        want.append((name or 0, len(raw), len(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want) and sum(w[2] for w in want) > 200


def test_sketch_cells_are_small():
    """A cell that a task hit takes about a byte of the shuffle."""
    cells = np.sort(np.random.default_rng(1).choice(1 << 16, 1500, replace=False))
    steps = sketch._steps(cells, np.uint8)
    assert len(steps) < 1.3 * len(cells) and np.array_equal(sketch._places(steps, np.uint8), cells)
    for edge in ([], [0], [255], [254, 255, 510, 65535]):
        assert sketch._places(sketch._steps(np.array(edge, np.int64), np.uint8), np.uint8).tolist() == edge


def test_suffix_segments_are_made_once(spark):
    """Documents meet the table of first segments; segments aren't made a second time to be joined with it."""
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(concat('some text ', id % 50, ' '), 20) as text")
    plan = suffix.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4  # mixed segments, strings of crowded anchors (twice), documents


def test_sketch_rows_follow_values(spark, monkeypatch):
    """Small batches don't make a row for each of their few cells: a task sends a block once for many values."""
    made = []
    arrow = sketch.arrow
    monkeypatch.setattr(sketch, "arrow", lambda *a, **k: made.append(arrow(*a, **k)) or made[-1])
    values = spark.range(0, 60_000, numPartitions=2).select("id")
    bits = sketch.member_bits(values, 24)
    assert made[0].count() <= 2 * 2 * (1 << 24 - sketch.LOG2_BLOCK)
    assert sketch.may_repeat(bits.value, np.arange(60_000, dtype=np.uint64), 24).all()
    assert sketch.may_repeat(bits.value, np.arange(60_000, 120_000, dtype=np.uint64), 24).mean() < 0.01


@pytest.mark.parametrize("gap", [0, 5, 64, 200, 1000, 60_000])
def test_sketch_cells_take_the_smaller_steps(gap):
    rng = np.random.default_rng(gap)
    places = np.sort(rng.integers(0, 5_000 * gap + 1, 5_000))
    steps = sketch._packed(places)
    assert np.array_equal(sketch._unpacked(steps), places)
    assert len(steps) < (1.2 if gap <= 64 else 3.1 if gap > 10_000 else 2.1) * len(places)


def test_repeats_in_one_task_and_across_tasks(spark):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = rng.integers(0, 3_000, 4_000)
    rows = [(int(x),) for x in values]
    df = spark.createDataFrame(rows, "v long").repartition(5)
    bits = sketch.repeated_bits(df, lambda: lambda batch: [batch.column(0).to_numpy().view(np.uint64)], 24).value
    names, counts = np.unique(values, return_counts=True)
    assert np.array_equal(sketch.may_repeat(bits, names.astype(np.uint64), 24), counts > 1)
    empty = sketch.repeated_bits(df.limit(0), lambda: lambda batch: [pa.array([]).to_numpy()], 4).value
    assert not any(x.any() for x in empty)


def test_what_the_join_shuffles_by_ngram_is_narrow(spark, families):
    """Parity bits stand in the classes only: rows that go by n-gram grow with nothing but their number."""
    df = spark.createDataFrame(families, "doc_id long, text string")
    _, _, classes, prefixes = ngram_join._candidates(df, 5, 80, "doc_id", "text", None)
    assert prefixes.columns == ["token", "s", "n", "pos"] and set(ngram_join.PARITY) < set(classes.columns)


def test_batches_and_scans_are_bounded_in_bytes(spark):
    import tracemalloc

    import pyarrow as pa

    from fathomgrid.llm.frames import BATCH_BYTES, arrow

    def sizes():
        def step(batch):
            yield {"n": [batch.num_rows], "bytes": [batch.nbytes]}
        return step

    texts = spark.range(3_000, numPartitions=1).selectExpr("repeat('ten bytes ', 1000) AS t")
    got = arrow(texts, sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 3_000 and max(r.bytes for r in got) < 1.2 * BATCH_BYTES

    rng = np.random.default_rng(1)
    batch = pa.array([rng.bytes(3_000) for _ in range(1_500)], pa.binary())
    scan = suffix.Scan(50)
    tracemalloc.start()
    for _, _, data, cuts in suffix.ts.pieces(batch, suffix.ts.SCAN_BYTES):
        scan.read(data, cuts)
        scan.segments()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 140 MB and more in pieces of 1 MB


def pairs_joined(spark, make):
    """Rows that joins of pairs (on a or b) make while `make` runs, and what it gives."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    seen = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    made, rows = make(), 0
    bus.waitUntilEmpty()
    runs = store.executionsList()
    for run in {runs.apply(i).executionId() for i in range(runs.size())} - seen:
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size()) if re.search(r"Join \[[ab]#", node.desc())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    rows += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return rows, made


def test_pairs_of_a_group_without_links_are_not_made(spark, monkeypatch):
    """Copies with three edits each are too far apart to link, but share n-grams early in their prefixes."""
    monkeypatch.setattr(ngram_join, "DRAWN", 4)
    monkeypatch.setattr(ngram_join, "PICKS", 2)
    rng, docs = random.Random(7), []
    for i in range(120):
        words = [f"w{j}" for j in range(150)]
        for third in (10, 55, 100):
            words[third + rng.randrange(40)] = f"edit{i}x{third}"
        docs.append((i, " ".join(words)))
    rows, got = pairs_joined(spark, lambda: near(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute.near_duplicates(docs) and len({c for _, c in got.values()}) > 10
    assert 120 < rows < 20 * len(docs), rows
