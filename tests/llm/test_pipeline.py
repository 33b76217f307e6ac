"""The pipeline's stages, each on its own input, against brute force; nulls, repeats and empty tables."""

import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixlake.llm import quality
from helixlake.llm.common import held_out
from tests.llm.test_ops import FOLD, WORD, brute_components, brute_lines, brute_targets, tiktoken_encoder  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into and comes out of each stage; some rows have nulls or come twice."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id but some words", "en", None, 3), (900001, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 5"))
    out = []
    for _, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, DATA).cache()
        out.append((docs.collect(), new.collect()))
        docs = new
    return out


def test_quality_keeps_what_scores(spark, steps):
    before, after = steps[0]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), lambda i: ~held_out(i, 5, 0))
    want = Counter(tuple(r)[:5] for r in quality.score_quality(docs, model).collect() if r.score >= 0.3)
    assert Counter(map(tuple, after)) == want and 0 < len(after) < len(before)


def test_lines(steps):
    before, after = steps[1]
    drop = brute_lines(before, 10, 1)
    want = Counter()
    for r in before:
        kept = "\n".join(x for x, d in zip((r.text or "").split("\n"), drop[r.doc_id, r.text]) if not d)
        text = r.text if not any(drop[r.doc_id, r.text]) else kept
        want[r.doc_id, text, r.lang, r.source, None if text is None else len(text)] += 1
    assert Counter(map(tuple, after)) == want


def test_one_of_each_group(steps):
    before, after = steps[2]
    rows = sorted({tuple(r) for r in before}, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    docs = {(r[0], r[1]): r for r in reversed(rows)}
    keys = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    sets = []
    for _, text in keys:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = brute_components(range(len(sets)), links)
    want = Counter(keys[k] for k in label if label[k] == k)
    assert Counter((r.doc_id, r.text) for r in after) == want
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_one_of_each_group_with_ids_that_repeat(spark):
    """An id that two texts bear, one of them a copy of another document; copies without an id."""
    long = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(3, long("a")), (5, long("a")), (5, long("b")), (None, long("b")), (None, long("c")), (None, long("c")), (7, ""), (8, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs.withColumn("_key", F.lit("mine")), DATA).collect())
    assert got == Counter([(3, long("a")), (5, long("b")), (None, long("c")), (7, ""), (8, None)])


def test_mix(steps):
    before, after = steps[3]
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r.text)
    targets, got = brute_targets(sizes), Counter()
    for r in after:
        got[r.source] += size(r.text)
    largest = max(size(r.text) for r in before)
    assert all(abs(got[s] - targets[s]) <= largest for s in sizes)
    times = Counter(map(tuple, after))
    assert max(times.values()) <= 3 * max(Counter(map(tuple, before)).values()) and set(times) <= set(map(tuple, before))


def test_tokens(steps, tiktoken_encoder):  # noqa: F811
    before, after = steps[4]
    want = Counter()
    for r in before:
        ids = tiktoken_encoder.encode_ordinary(r.text or "")
        want[r.doc_id, r.lang, r.source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, after)) == want


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_run_is_the_stages_in_order(spark):
    """Against the stages applied by hand to the whole table, each of which the tests above hold against brute force."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.cache(), DATA)
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert rows and Counter(map(tuple, rows)) == Counter(map(tuple, docs.collect()))
