"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import itertools
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.llm import bpe, embedding_dedup, hnsw, jaccard_join, language_model, line_dedup, mixing, quality, sharding, toxicity
from helixlake.llm.textvec import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, key string"


def random_texts(n=120, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "eps", "Zeta!", "eta", "thé", "iota", "日本語", "x"]
    texts = ["\n".join(" ".join(rng.choice(vocabulary, rng.integers(1, 12))) for _ in range(rng.integers(1, 6))) for _ in range(n)]
    common = "A common licence line"
    texts = [t + "\n" + common if k % 3 == 0 else t + "\n  a COMMON licence line\t" if k % 7 == 0 else t for k, t in enumerate(texts)]
    texts += [texts[0], texts[0], texts[1] + " x", "", None, "\n", " \t ", "word " * 9000, "a" * 3000 + "  " + "b" * 3000, "\n\n\nx\r\n y", texts[5]]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", [None, "s1", "s2", "s3", "é"][k % 5] if k % 2 else "s1", None, 7, "mine", "k") for k, t in enumerate(random_texts())]
    rows += [rows[3], (None, "no id here", "en", "s2", 1, 1, "", ""), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_a_regular_expression(docs):
    table = docs.select("text").toArrow()
    got = words(table.column("text").combine_chunks())
    texts = table.column("text").to_pylist()
    seen = {}
    for k, t in enumerate(texts):
        want = WORD.findall((t or "").translate(FOLD))
        lo, hi = got.first[k], got.first[k + 1]
        assert [bytes(got.data[a:b]).decode() for a, b in zip(got.start[lo:hi], got.end[lo:hi])] == want
        for w, h in zip(want, got.hash[lo:hi].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sharding(docs, empty):
    rows = docs.collect()
    out = sharding.shard_by_size(docs, shards=4, rows_per_run=10).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in rows)
    by_shard, by_group = defaultdict(list), defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        by_group[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(4))
    assert all(len(s) == 1 for s in by_group.values())
    assert {r.text_crc32 for r in out} == {zlib.crc32((r.text or "").encode()) for r in rows}
    assert sharding.shard_by_size(empty).count() == 0


def test_shards_are_near_equal(spark):
    """The loads of plain scheduling of all groups, one by one; a group of copies stays together."""
    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(1, 400, 3000), [20_000, 9_000]])
    rows, k = [], 0
    for g, n in enumerate(sizes.tolist()):
        for _ in range(int(rng.integers(1, 4)) if n < 400 else 1):
            rows.append((k, f"{g} ".ljust(n, "x")))
            k += 1
    rows += [(k + j, "copy of one text") for j in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_by_size(df, shards=16, rows_per_run=500).collect()
    load, groups = Counter(), defaultdict(set)
    for r in out:
        load[r.shard] += r.size
        groups[r.text_crc32, r.size].add(r.shard)
    by_group = Counter()
    for _, t in rows:
        by_group[t] += len(t.encode()) + 1
    assert all(len(s) == 1 for s in groups.values())
    assert [load[s] for s in range(16)] == plain_lpt(list(by_group.values()), 16)[1]


def plain_lpt(sizes, shards):
    """Group by group: (size, groups of that size in each shard), and the loads."""
    loads, got = [0] * shards, {}
    for size in sorted(sizes, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        got.setdefault(size, [0] * shards)[s] += 1
    return list(got.items()), loads


def test_longest_processing_time():
    assert plain_lpt([7, 7, 6, 6, 5, 4, 4, 3, 1], 3)[1] == [15, 15, 13]
    rng = np.random.default_rng(9)
    for shards in (1, 3, 16):
        for most in (4, 60, 5000):
            sizes = rng.integers(1, most, 3000).tolist() + rng.integers(1, 200_000, int(rng.integers(0, 20))).tolist()
            assert sharding.lpt(list(Counter(sizes).items()), shards) == plain_lpt(sizes, shards)[0]


def brute_lines(rows, min_docs, min_chars):
    docs = {(r.doc_id, r.text) for r in rows}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    seen = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            seen[key(line)].add(d)
    shared = {k for k, d in seen.items() if len(d) >= min_docs and len(k) >= min_chars}
    return {d: [key(x) in shared for x in (d[1] or "").split("\n")] for d in docs}


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (3, 12), (1, 0)])
def test_line_dedup(docs, empty, min_docs, min_chars):
    want = brute_lines(docs.collect(), min_docs, min_chars)
    out, keep, dropped = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs, min_chars))
    rows = out.select("doc_id", "text", F.col(dropped).alias("_n_dropped"), line_dedup.kept_text("text", keep).alias("kept"), line_dedup.kept_sha256("text", keep).alias("sha")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        drop = want[r.doc_id, r.text]
        kept = "\n".join(x for x, d in zip((r.text or "").split("\n"), drop) if not d)
        assert (r._n_dropped, r.kept, r.sha) == (sum(drop), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert line_dedup.remove_shared_lines(docs, min_docs).columns == docs.columns
    assert line_dedup.remove_shared_lines(empty).count() == 0


@pytest.mark.parametrize("records", [1, 2, 7])
def test_line_dedup_in_small_batches(spark, records):
    """Runs of a key that reach over many batches, in one document and in many."""
    rows = [(k, "\n".join(["same"] * (k % 4 + 1) + [f"own {k}"] + ["pair"] * (30 if k in (3, 4) else 0) + (["few"] if k < 5 else []))) for k in range(40)]
    rows += [(99, "once\n" * 60), (None, "same\nonce"), rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        for least in (2, 3, 5, 6, 10):
            want = brute_lines(table.collect(), least, 1)
            got = line_dedup.remove_shared_lines(table, least).collect()
            assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), "\n".join(x for x, d in zip(t.split("\n"), want[i, t]) if not d)) for i, t in rows)
        first = line_dedup.remove_shared_lines(table.distinct(), 2, keep_first=True).collect()
        assert sum(r.text.split("\n").count("same") for r in first) == 1 and sum(r.text.split("\n").count("pair") for r in first) == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_document_of_one_line_takes_linear_time():
    """Batches of one endless run: rows go out as they come in, and no more than a batch is held."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.full(10_000, x, np.int64)) for x in (1, 2, 3)] + [pa.array(np.arange(10_000, dtype=np.int32))] + [pa.array(np.full(10_000, x, np.int64)) for x in (5, 6)], names=["id", "th", "x", "pos", "h1", "h2"])

    def feed(n):
        for k in range(n):
            fed[0] += 10_000
            yield batch

    seconds = []
    for n in (40, 400):
        fed, out, began = [0], 0, time.perf_counter()
        for made in line_dedup._stream(10, False, pa.int64())(feed(n)):
            out += made.num_rows
            assert fed[0] - out <= 10_000
        seconds.append(time.perf_counter() - began)
        assert out == 10_000 * n + 1
    assert seconds[1] < 30 * seconds[0] + 1


def test_columns_with_the_names_of_helpers(spark):
    rows = [(k, f"shared\nown {k} " + "x" * 40 if k else "shared\n" + "word " * 9000, k, "a", 7, 1.5, "t", "m") for k in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _keep long, _id string, _th int, _d double, _n_dropped string, _key string").withColumn("_e", F.lit("e")).withColumn("KEEP", F.lit(1)).withColumn("e", F.lit(2)).withColumn("key", F.lit(3)).withColumn("n_dropped", F.lit(4))
    out = line_dedup.remove_shared_lines(table, 10)
    assert out.columns == table.columns and {r.text for r in out.collect()} == {r[1].split("\n")[1] for r in rows}
    assert [tuple(r)[2:] for r in out.orderBy("doc_id").collect()] == [tuple(r)[2:] for r in table.orderBy("doc_id").collect()]
    for made in (bpe.encode(table), bpe.encode_digests(table)):
        assert [tuple(r)[2 : len(table.columns)] for r in made.orderBy("doc_id").collect()] == [tuple(r)[2:] for r in table.orderBy("doc_id").collect()]


def test_line_dedup_keeps_first(docs):
    rows = docs.collect()
    out = line_dedup.remove_shared_lines(docs, 2, 1, keep_first=True).select("text").collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    before = {key(x) for r in rows for x in (r.text or "").split("\n")} - {""}
    assert before == {key(x) for r in out for x in (r.text or "").split("\n")} - {""}
    licence = sum(key(x) == "a common licence line" for r in out for x in (r.text or "").split("\n"))
    assert 1 <= licence <= 2  # document 3 comes twice


def test_line_dedup_matches_sql(docs, tmp_path):
    docs.where("doc_id is not null").select("doc_id", "text").distinct().write.parquet(str(tmp_path / "documents.parquet"))
    spark = docs.sparkSession
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(line_dedup.OP3_SQL).fetchall())
    assert sorted(map(tuple, line_dedup.op3_line_dedup(spark, str(tmp_path)).collect())) == want


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    total, capped = sum(sizes.values()), {}
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: repeats * sizes[s] for s in over}


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs, block_tokens=4, rows_per_shard=20)
    rows = out.collect()
    size_of = Counter()
    for r in docs.collect():
        size_of[r.source] += len(WORD.findall(r.text or ""))
    targets, taken = brute_targets(size_of), Counter()
    for r in rows:
        assert r.source_size == size_of[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 3 * 4 for s in targets)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_sources(docs.repartition(7), block_tokens=4, rows_per_shard=20).collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_spreads_rows_without_id_and_equal_rows(spark):
    """Many rows of one id, or of one id and text, fill as many shards as distinct ones do."""
    rows = [(None, f"word {k}", "a") for k in range(9_000)] + [(7, "the same words", "b")] * 9_000 + [(k, "x y", "c") for k in range(9_000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_shard=1000)
    cells = {(r.source, r.shard): r["count"] for r in out.groupBy("source", "shard").count().collect()}
    assert sum(cells.values()) == 27_000 and all(sum(s == source for s, _ in cells) == 9 for source in "abc") and max(cells.values()) < 1200
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5), rows_per_shard=1000)
    count = lambda df: sorted((str(r.doc_id), r.source, r.size, r.taken, r["count"]) for r in df.groupBy("doc_id", "source", "size", "taken").count().collect())
    assert count(out) == count(again)


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12345])
def test_apportionment_by_highest_quotients(spark, seats):
    values = [0, 1, 3, 50, 51, 999, 12, 12]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "g int, k int, v long").withColumn("s", F.lit(seats)).withColumn("m", F.lit(10**9))
    got = {r.k: r.quota for r in mixing.apportion(df, ["g"], ["k"], "v", "s", "m").collect()}
    want = Counter()
    quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(values) if v for k in range(seats + 1)))[:seats]
    want.update(i for _, i in quotients)
    assert got == {k: want[k] for k in range(len(values))}


@pytest.fixture(scope="module")
def tiktoken_encoder():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (400, 100), (32768, 2048)])
def test_bpe(docs, empty, tiktoken_encoder, chunk, overlap):
    out = bpe.decode(bpe.encode(docs, chunk_chars=chunk, overlap=overlap)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert list(r.tokens) == tiktoken_encoder.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.encode_digests(docs, chunk_chars=chunk, overlap=overlap).collect():
        ids = tiktoken_encoder.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(empty).count() == 0


def brute_components(nodes, links):
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("width,num,den,block", [(3, 90, 100, 512), (3, 50, 100, 8), (5, 80, 100, 16), (1, 90, 100, 512)])
def test_jaccard_join(spark, empty, width, num, den, block):
    rng = np.random.default_rng(width)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (5, 9, 20, 21, 60, 200)]
    texts = [None, "", " \n", "one", "ONE", "one two", base[0]]
    for b in base:
        for _ in range(18):
            w = b.split()
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = f"n{rng.integers(1000)}"
            texts.append(" ".join(w) + (" tail" if rng.random() < 0.2 else ""))
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, texts[9]), (None, base[1])]
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = [k for k in sets if k is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = brute_components(ids, links)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    got = jaccard_join.similar_documents(df, width, num, den, block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == want.get(r.doc_id)
    assert jaccard_join.similar_documents(empty).count() == 0


def jaccard_case(spark, texts, width, num, den, block=512):
    sets = [set(zip(*(t.split()[k:] for k in range(width)))) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = brute_components(range(len(sets)), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(df, width, num, den, block).collect()}
    assert got == want
    return Counter(want.values()).most_common(3)


@pytest.mark.parametrize("num", [50, 60, 70, 80, 90])
def test_jaccard_join_of_nested_sets(spark, num):
    """Sets whose sizes differ by as much as the threshold allows, and a bit more."""
    rng = np.random.default_rng(num)
    texts = []
    for k in range(30):
        n = int(rng.integers(20, 200))
        base = [f"w{k}x{i}" for i in range(n)]
        texts += [" ".join(base), " ".join(base[: int(np.ceil(n * num / 100)) - k % 3 % 2])]
    jaccard_case(spark, texts, 1, num, 100)


@pytest.mark.parametrize("edits,num,den", [(2, 90, 100), (6, 90, 100), (9, 90, 100), (9, 80, 100), (14, 80, 100), (40, 80, 100)])
def test_jaccard_join_of_large_groups(spark, edits, num, den):
    """Groups of more than a block: near copies that are close, farther than the threshold from most others, or only share a passage."""
    rng = np.random.default_rng(edits)
    texts = []
    for g in range(2):
        base = [f"g{g}x{i}" for i in range(80)]
        for k in range(110):
            w = list(base)
            for at in rng.integers(0, 70, edits):
                w[at] = f"e{g}x{k}x{at}"
            texts.append(" ".join(w))
    texts += [texts[3] + " tail", " ".join(texts[0].split()[:40] + texts[150].split()[40:])]
    jaccard_case(spark, texts, 1, num, den, 24)


def test_pivots_take_a_group_of_near_copies_at_once(spark):
    """Nothing is left to compare where all are within half the threshold's distance of what they have in common."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 200)
    rows = []
    for k in range(300):
        s = base.copy()
        s[rng.integers(0, 200, 4)] = rng.integers(0, 2**62, 4)
        rows.append((1, k, k, 200, np.unique(s).tolist()))
    df = spark.createDataFrame(rows, "region long, id long, key long, n long, set array<long>")
    edges, leaves = jaccard_join.divide(df.select("region", "id", "key"), df.select("id", "key", "n", "set"), 90, 100, 64)
    linked = {r.u for e in edges for r in e.collect()}
    assert linked == set(range(300)) and sum(x.count() for x in leaves) == 0


def test_metric_join_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**62, 80).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.97], rng.integers(0, 2**62, rng.integers(0, 4)).astype(np.uint64)])) for b in base for _ in range(60)]
    i, j = jaccard_join.metric_join(sets, 90, 100, leaf=16)
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    near = x[:20].repeat(6, axis=0) + rng.normal(size=(120, 16)) * 0.05
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(np.vstack([x, near, x[:5], x[:5] * 2]))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [1.0, 2.1]), (None, rows[0][1]), rows[7]]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cell int")


def valid_rows(vectors):
    return [(r.vec_id, np.array(r.embedding)) for r in vectors.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]


def test_embedding_dedup(spark, vectors):
    rows = valid_rows(vectors)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.9]
    n = Counter(k for p in links for k in p)
    label = brute_components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    want = Counter((v, n[k], label[v], v == label[v]) for k, (v, _) in enumerate(rows))
    got = embedding_dedup.near_duplicates(vectors, block_rows=40, cell_rows=100).collect()
    assert len(got) == vectors.count()
    bad = {r.vec_id for r in vectors.collect()} - {v for v, _ in rows}
    assert Counter(tuple(r) for r in got if r.vec_id not in bad) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in bad)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_embedding_links_across_many_cells(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    away = rng.normal(size=(1500, 64))
    away -= (away * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    away /= np.sqrt((away * away).sum(axis=1, keepdims=True))
    cos = rng.uniform(0.6, 0.62, 1500)[:, None]
    x = np.vstack([x, cos * x[:1500] + np.sqrt(1 - cos * cos) * away]).astype(np.float32).astype(np.float64)
    dots = x @ x.T / np.sqrt((x * x).sum(axis=1)) / np.sqrt((x * x).sum(axis=1))[:, None]
    n = (dots >= 0.6).sum(axis=1) - 1
    assert n.sum() > 2900
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df, threshold=0.6, cell_rows=75, block_rows=500).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(n.tolist()))


def test_dense_and_sparse_blocks_decide_alike():
    """Pairs at the threshold, by their neighbours in the block a few or most of all."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(120, 24)), rng.normal(size=(120, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    one = np.ones(1)
    alone = [len(embedding_dedup.block_links(x[None], y[None], one, one, False, 0.9)[0]) == 2 for x, y in zip(a, b)]
    assert any(alone) and not all(alone)
    for k, (x, y) in enumerate(zip(a, b)):
        many = np.repeat(x[None], 100, axis=0), np.repeat(y[None], 100, axis=0)
        at, count, _ = embedding_dedup.block_links(*many, np.ones(100), np.ones(100), False, 0.9)
        assert len(at) == (200 if alone[k] else 0) and (count == 100).all()


def test_rings_exclude_no_pair_that_links():
    rng = np.random.default_rng(13)
    c, d = embedding_dedup.unit(rng.normal(size=(2, 400, 3)).reshape(-1, 3)).reshape(2, 400, 3)
    x = embedding_dedup.unit(rng.normal(size=(400, 3)))
    y = embedding_dedup.unit(x + rng.normal(size=(400, 3)) * 0.2)
    angle = lambda a, b: np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
    got = [embedding_dedup.may_link(g, lo, lo, np.array([o]), np.array([o]), 0.9)[0] for g, lo, o in zip(angle(c, d)[:, None], angle(x, c), angle(y, d))]
    linked = (x * y).sum(axis=1) >= 0.9
    assert linked.sum() > 50 and np.array(got)[linked].all()
    assert not embedding_dedup.may_link(np.array([2.0]), 0.0, 0.3, np.array([0.0]), np.array([0.3]), 0.9)[0]


def test_hnsw(spark, vectors):
    rows = sorted({v: tuple(x) for v, x in valid_rows(vectors)}.items())
    queries = vectors.where("vec_id % 20 = 0")
    out = hnsw.search(hnsw.build_index(vectors, shard_rows=150), vectors, queries, k=20, query_rows=10).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    asked = [(v, np.array(x)) for v, x in rows if v % 20 == 0]
    assert set(got) == {v for v, _ in asked}
    for v, x in asked:
        scores = sorted(((-float(x @ np.array(y)), u) for u, y in rows if u != v and len(y) == len(x)))[:20]
        assert [r for r, _, _ in got[v]] == list(range(1, len(scores) + 1))
        assert all(math.isclose(s, float(x @ np.array(dict(rows)[u])), rel_tol=1e-9) for _, u, s in got[v])
        assert [(-s, u) for _, u, s in got[v]] == sorted((-s, u) for _, u, s in got[v])
        hits += len({u for _, u in scores} & {u for _, u, _ in got[v]})
        total += len(scores)
    assert hits / total >= 0.98
    assert hnsw.search(hnsw.build_index(vectors.limit(0)), vectors.limit(0), queries.limit(0)).count() == 0


def test_hnsw_recall_over_many_shards(spark):
    """Ten shards, more than one block of queries, vectors spread evenly; every shard's graph is larger than a batch."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(5000, 32)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = hnsw.build_index(df, shard_rows=500)
    assert index.count() >= 10
    out = hnsw.search(index, df, df.where("vec_id % 20 = 0"), k=20, query_rows=100).collect()
    got = defaultdict(set)
    for r in out:
        got[r.query_id].add(r.vec_id)
    dots = x[::20].astype(float) @ x.T.astype(float)
    dots[np.arange(250), np.arange(0, 5000, 20)] = -np.inf
    want = np.argsort(-dots, axis=1)[:, :20]
    assert np.mean([len(got[20 * k] & set(w.tolist())) / 20 for k, w in enumerate(want)]) > 0.97


def test_insertion_links_every_node(spark):
    """From the entry every node is reached on the lowest level, and found as its own nearest."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(3000, 24))
    entry, members, flat = hnsw.build_graph(x)
    assert [len(m) for m in members] == sorted((len(m) for m in members), reverse=True) and flat[0].max() < 3000
    reached, edge = {entry}, [entry]
    while edge:
        edge = [j for j in {int(j) for i in edge for j in flat[0][i] if j >= 0} if j not in reached]
        reached |= set(edge)
    assert len(reached) > 2990
    for lv, (m, f) in enumerate(zip(members, flat)):
        assert set(f[f >= 0].tolist()) <= set(m.tolist())
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    entry, members, flat = hnsw.build_graph(unit)
    assert (hnsw.search_graph(unit, entry, members, flat, unit, 1)[:, 0] == np.arange(3000)).mean() > 0.99


def test_diverse_choice_by_hand():
    """A node's choice is that of the plain loop over its candidates, for rows of unequal length."""
    rng = np.random.default_rng(23)
    x, node = rng.normal(size=(60, 4)).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32)
    near = np.array([rng.permutation(60)[:30] for _ in node])
    near, dots = hnsw.best_of(near, np.where(np.arange(30) < 4 * np.arange(9)[:, None], np.einsum("ijk,ik->ij", x[near], node), -np.inf), 25)
    got = hnsw.diverse(x, near, dots, 6)
    for row, scores, out in zip(near.tolist(), dots, got.tolist()):
        chosen, spare = [], []
        for j, score in zip(row, scores):
            if j >= 0 and len(chosen) < 6:
                (spare if any(x[j] @ x[i] > score for i in chosen) else chosen).append(j)
        want = (chosen + spare)[:6]
        assert out == want + [-1] * (6 - len(want))


def test_hnsw_repeated_query(spark, vectors):
    once = vectors.where("vec_id = 40")
    index = hnsw.build_index(vectors, shard_rows=150)
    one, two = (sorted(map(tuple, hnsw.search(index, vectors, q, k=20, query_rows=10).collect())) for q in (once, once.unionByName(once)))
    assert len(one) == 20 and one == two


def labelled_corpus(spark, label):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for k in range(400):
        w = list(rng.choice(vocabulary, 60))
        bad = k % 5 == 0
        if bad and label == "toxic":
            w[30:33] = ["vile", "scumbag", "vile"]
        if bad and label == "quality":
            w = [x + "!!" for x in w] if k % 2 else [w[0]] * 60
        rows.append((k, " ".join(w), None))
        labels.append((k, int(bad) if label == "toxic" else int(not bad)))
    rows += [(9001, None, 1.0), (9002, "", 2.0), (9003, "word " * 30000, None), (None, "vile", None), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], f"doc_id long, {label} int")


@pytest.mark.parametrize("label,module,score", [("toxic", toxicity, "score_toxicity"), ("quality", quality, "score_quality")])
def test_classifiers(spark, label, module, score):
    docs, labels = labelled_corpus(spark, label)
    held = lambda i: F.crc32(i.cast("string").cast("binary")) % 5 == 0
    model = module.fit(docs, labels, lambda i: ~held(i))
    out = getattr(module, score)(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    y = {r.doc_id: r[label] for r in labels.collect()}
    test = [r for r in out if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and y[r.doc_id] is not None]
    assert np.mean([(r.score >= 0.5) == bool(y[r.doc_id]) for r in test]) > 0.97
    constant = getattr(module, score)(docs, module.fit(docs, labels.limit(0), lambda i: ~held(i))).select("score").distinct().count()
    assert constant == 1 and getattr(module, score)(docs.limit(0), model).count() == 0


def test_log_odds_and_their_scale_by_hand(spark):
    """Counts of texts, log-odds with their prior, rate and constant of the segments' law, and a text's evidence."""
    docs, labels = labelled_corpus(spark, "toxic")
    model = toxicity.fit(docs, labels, lambda i: F.lit(True))
    y = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None:
            y[r.doc_id] = max(y.get(r.doc_id, 0), r.toxic)
    train = [(r.text or "", y[r.doc_id]) for r in docs.collect() if r.doc_id in y]
    n = [sum(v == c for _, v in train) for c in (0, 1)]
    holds = {w: [sum(w in set(t.split()) for t, v in train if v == c) for c in (0, 1)] for w in ("vile", "scumbag")}
    import pyarrow as pa

    w = words(pa.array(["vile scumbag"]), "not_alnum")
    for k, (n0, n1) in enumerate(holds.values()):
        prior = toxicity.PRIOR_TEXTS * (n0 + n1) / sum(n) + 0.5
        want = math.log((n1 + prior) / (n[1] + toxicity.PRIOR_TEXTS + 1 - n1)) - math.log((n0 + prior) / (n[0] + toxicity.PRIOR_TEXTS + 1 - n0))
        assert math.isclose(toxicity.word_scores(w, model.key, model.odds)[k], want - toxicity.DRIFT, rel_tol=1e-9)
    clean = pa.array([t for t, v in train if not v])
    words_ = words(clean, "not_alnum")
    scores = np.round(toxicity.word_scores(words_, model.key, model.odds), 1)
    values, n_words = np.unique(scores, return_counts=True)
    assert math.isclose(model.rate, toxicity.rate_of(values, n_words))
    some, often = np.array([-1.5, -0.5, 1.0, 4.0]), np.array([900.0, 60.0, 30.0, 5.0])
    assert math.isclose((np.exp(toxicity.rate_of(some, often) * some) * often).sum() / often.sum(), 1, rel_tol=1e-9)
    least = max(0.1, model.odds[model.odds > toxicity.DRIFT].min() - toxicity.DRIFT)
    above = sum(max(toxicity.word_scores(words(pa.array([t]), "not_alnum"), model.key, model.odds), default=-1) >= least for t, v in train if not v)
    assert math.isclose(model.count, max(1, above) / (len(scores) * math.exp(-model.rate * least)))
    assert model.count >= 0 and toxicity.evidence(100, [], model.rate, model.count) <= 0
    s = 30.0
    assert math.isclose(toxicity.evidence(100, [s], model.rate, model.count), model.rate * s - math.log(model.count * 100))


def test_ratios_and_descent_by_hand(spark):
    """Log-count ratios against counts of the same features, and the fitted plane against a solver of the primal problem."""
    docs, labels = labelled_corpus(spark, "quality")
    import pyarrow as pa

    part = {r.doc_id for r in labels.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)) == 0).collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None and r.doc_id not in part}
    rows = [(r.text or "", y[r.doc_id]) for r in docs.collect() if r.doc_id in y]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows])], names=["text"])
    ids = list(quality.features(batch))
    seen = np.zeros((2, 1 << quality.BITS))
    for f, (_, v) in zip(ids, rows):
        seen[v, f] += 1
    p, q = seen[1] + quality.SMOOTHING, seen[0] + quality.SMOOTHING
    want = np.where(seen.sum(axis=0) > 0, np.log((p / p.sum()) / (q / q.sum())), 0)
    model = quality.fit(docs, labels, lambda i: F.lit(True))
    assert np.allclose(model.ratio, want)

    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(size=(60, 4)), np.ones((60, 1))])
    t = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) * 0.3 > 0, 1.0, -1.0)
    got = quality.dual_coordinate_descent([np.arange(4)] * 60, [r[:4] for r in x], t, 4, np.ones(60), epochs=2000)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - t * (x @ v)).sum()
    v, best = np.zeros(5), np.inf
    for k in range(1, 20001):  # subgradient steps
        at = 1 - t * (x @ v) > 0
        v = v - (v - (t[at, None] * x[at]).sum(axis=0)) / (10 + k)
        best = min(best, loss(v))
    assert loss(np.append(*got)) <= best * 1.001


def test_a_model_too_large_to_broadcast_scores_alike(spark):
    docs, labels = labelled_corpus(spark, "toxic")[:2]
    docs = docs.unionByName(docs.limit(5))
    small = toxicity.fit(docs, labels, lambda i: F.lit(True))
    large = toxicity.fit(docs, labels, lambda i: F.lit(True), model_tokens=3)
    assert large.table is not None and not len(large.key) and large.table.count() == len(small.key) > 3
    assert (large.rate, large.count) == pytest.approx((small.rate, small.count)) and large.curve == pytest.approx(small.curve)
    rows = lambda m: sorted((str(r.doc_id), round(r.score, 9), [tuple(p)[:2] for p in r.passages]) for r in toxicity.score_toxicity(docs, m).collect())
    assert rows(small) == rows(large)


def test_toxic_passages_and_maximal_segments(spark):
    docs, labels = labelled_corpus(spark, "toxic")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, lambda i: F.lit(True))).join(docs.select("doc_id", "text"), "doc_id").where("doc_id % 5 = 0 and doc_id < 400").collect()
    found = [r for r in out if any("scumbag" in r.text.encode()[p.start : p.end].decode() for p in r.passages)]
    assert len(found) >= 0.95 * len(out)
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(size=rng.integers(1, 12))
        got = toxicity.maximal_segments(s)

        def brute(lo, hi):
            best = max(((s[a : b + 1].sum(), a, b) for a in range(lo, hi) for b in range(a, hi)), default=(0, 0, 0))
            return [*brute(lo, best[1]), (best[1], best[2]), *brute(best[2] + 1, hi)] if best[0] > 0 else []

        assert [(a, b) for a, b, _ in got] == brute(0, len(s))


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def lm_tokens(t):
    return [*WORD.findall((t or "").translate(FOLD)), None]


@pytest.fixture(scope="module")
def lm(docs):
    """Scores of the documents, and the model that gave them."""
    held = language_model.held_out(F.col("doc_id"), 7, 2)
    path = bpe.vocabulary(None)
    counts = language_model.with_ids(language_model.word_counts(docs.where(~held)), path)
    model = language_model.fit(language_model.encoded_pieces(docs, held, counts, path), counts, path)
    return held, model, language_model.score_texts(docs, held).collect()


def lm_counts(docs):
    return Counter(w for r in docs.collect() if not is_held(r.doc_id) for w in lm_tokens(r.text))


def test_language_model_counts(docs, empty, lm):
    count = lm_counts(docs)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in docs.collect():
        t = lm_tokens(r.text)
        want[r.doc_id, is_held(r.doc_id), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((*r[:5], round(r.base_score, 6)) for r in lm[2]) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in lm[2])
    assert language_model.score_texts(empty, lm[0]).count() == 0


def test_language_model_scores_word_by_word(docs, lm, tiktoken_encoder):
    """Every word by itself, with plain loops over the inputs before it, in double precision."""
    _, model, got = lm
    count, p = lm_counts(docs), {c: v.astype(np.float64) for c, v in model.parameters.items()}
    end, block = len(model.class_of) - 2, language_model.BLOCK
    classes_of = lambda w: tuple(int(model.class_of[i]) for i in lm_ids(w, tiktoken_encoder, end))
    size = Counter()
    for w, c in count.items():
        size[classes_of(w)] += c + 1
    want = defaultdict(list)
    for r in docs.collect():
        t = lm_tokens(r.text)
        if len(t) > 300:
            continue
        classes = [c for w in t for c in classes_of(w)]
        inputs, total = [language_model.START, *classes[:-1]], 0.0
        for k, c in enumerate(classes):
            first = max(0, (k // block - 1) * block)
            shift = block - (k // block) * block  # place of an input in its window
            e = np.array([p["embed"][inputs[j]] + p["place"][j + shift] for j in range(first, k + 1)])
            own = e[-1] + p["prior"][inputs[k - 1] if k else language_model.PAD]
            weight = np.exp(e @ p["k"] @ (own @ p["q"]) / np.sqrt(language_model.DIM))
            h = own + weight @ (e @ p["v"]) / weight.sum()
            logit = h @ p["out"] + p["bias"]
            total += (logit[c] - np.log(np.exp(logit).sum())) / np.log(10)
        want[r.doc_id].append(total + sum(math.log10((count[w] + 1) / (size[classes_of(w)] + 1)) for w in t))
    assert len(want) > 100
    for r in got:
        if r.doc_id in want:
            assert any(math.isclose(r.score, x, rel_tol=1e-4, abs_tol=1e-3) for x in want[r.doc_id])


def lm_ids(w, encoder, end):
    return [end] if w is None else encoder.encode_ordinary(" " + w)


@pytest.mark.parametrize("piece", [64, 1 << 16])
def test_every_subword_id_is_read_and_scored_once(docs, lm, tiktoken_encoder, piece):
    """The targets of all windows are the classes of the tokenizer's ids of whole texts, and the words' sequences are theirs."""
    held, model, _ = lm
    path, end = bpe.vocabulary(None), len(lm[1].class_of) - 2
    counts = language_model.with_ids(language_model.word_counts(docs.where(~held)), path)
    pieces = language_model.encoded_pieces(docs, held, counts, path, piece).toArrow().sort_by([("doc_id", "ascending"), ("th", "ascending"), ("no", "ascending")])
    _, y, _ = language_model._read(pieces, model.class_of)
    seq, at = language_model._read_sequences(pieces, model.class_of, model.begins)
    assert (np.bincount(at, minlength=pieces.num_rows) == pieces.column("n").to_numpy()).all()
    want_ids, want_words = Counter(), Counter()
    for r in docs.collect():
        for w in lm_tokens(r.text):
            ids = lm_ids(w, tiktoken_encoder, end)
            classes = model.class_of[ids]
            assert model.begins[ids].tolist() == [True] + [False] * (len(ids) - 1)
            want_ids.update(classes.tolist())
            want_words[int(language_model.sequences([classes], [model.begins[ids]])[0][0])] += 1
    assert Counter(y[y != language_model.PAD].tolist()) == want_ids
    assert Counter(seq.tolist()) == want_words
    assert len(want_words) > 20


def test_sequences_of_classes_have_hashes_of_their_own():
    rng = np.random.default_rng(4)
    rows = [tuple(rng.integers(0, 4, rng.integers(1, 6)).tolist()) for _ in range(3000)]
    begins = [np.arange(len(r)) == 0 for r in rows]
    seq, at = language_model.sequences([np.array(r) for r in rows], begins)
    assert at.tolist() == list(range(len(rows)))
    assert len(set(zip(seq.tolist(), rows))) == len(set(rows)) == len(set(seq.tolist()))
    # What goes on with a word of the piece before belongs to no word here.
    seq2, at2 = language_model.sequences([np.array([1, 2]), np.array([], int), np.array([3, 1, 2])], [np.array([True, False]), np.array([], bool), np.array([False, True, False])])
    assert at2.tolist() == [0, 2] and seq2[0] == seq2[1]


def test_a_sequence_shares_its_probability_among_its_words(docs, lm):
    """(c + 1) / (N + V + 1) over the words of a sequence of classes, and one share for unseen words, make 1; words of one
    kind of class follow no other, so a text's classes tell its words."""
    path, model = bpe.vocabulary(None), lm[1]
    counts = language_model.with_ids(language_model.word_counts(docs.where(~lm[0])), path)
    seen = Counter()
    for r in counts.collect():
        ids = np.array(r.ids)
        seen[int(language_model.sequences([model.class_of[ids]], [model.begins[ids]])[0][0])] += r.c + 1
    assert {r.seq: r.size for r in language_model.sequence_sizes(counts, model).collect()} == {k: n + 1 for k, n in seen.items()}
    assert not set(model.class_of[:-1][model.begins]) & set(model.class_of[:-1][~model.begins])


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_scores_do_not_depend_on_the_split(docs, lm, parts):
    other = language_model.score_texts(docs.repartition(parts), lm[0]).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)
    for a, b in zip(sorted(lm[2], key=key), sorted(other, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a.score, b.score, rel_tol=1e-5) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9)


def test_pieces_of_long_texts_score_as_wholes(docs, lm):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)
    cut = language_model.score_texts(docs, lm[0], model=lm[1], piece=64).collect()
    for a, b in zip(sorted(lm[2], key=key), sorted(cut, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a.score, b.score, rel_tol=1e-5)


def test_rare_words_join_as_frequent_ones_do(docs, lm, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_SHARE", 20)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)
    two = language_model.score_texts(docs, lm[0], model=lm[1]).collect()
    for a, b in zip(sorted(lm[2], key=key), sorted(two, key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_attention_beats_the_baseline_on_held_out_texts(spark):
    """By itself: nothing of the baseline is mixed in."""
    rows = language_model.op10_attention_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score - r.base_score for r in rows) / n > 0.3
    assert np.mean([r.score > r.base_score for r in rows]) > 0.97


def test_attention_gradients_and_distribution():
    rng = np.random.default_rng(2)
    p = language_model.new_parameters(np.full(language_model.OUTPUTS, 1 / language_model.OUTPUTS))
    p = {c: v.astype(np.float64) for c, v in p.items()} | {"out": rng.normal(size=p["out"].shape) * 0.1}
    x, y, _ = language_model.windows([rng.integers(0, 20, 33), rng.integers(0, 20, 80)], np.array([True, True]))

    def loss():
        logit = language_model.forward(p, x)[0]
        logp = logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))
        t = y.ravel()
        return -logp[np.arange(len(t)), np.minimum(t, 61)][t != language_model.PAD].mean()

    g = language_model.gradients(p, x, y)
    for c in p:
        at = tuple(rng.integers(0, n) for n in p[c].shape) if c != "embed" else (int(x[0, -1]), 1)
        old, e = p[c][at], 1e-4
        p[c][at] = old + e
        up = loss()
        p[c][at] = old - e
        down = loss()
        p[c][at] = old
        assert math.isclose((up - down) / (2 * e), g[c][at], rel_tol=2e-2, abs_tol=1e-5), c


def test_lookups_search_each_distinct_hash_once(monkeypatch):
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    hashes = np.concatenate([key[::2], rng.integers(0, 1 << 63, 50).astype(np.uint64)])[rng.integers(0, 300, 20_000)]
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: searched.append(np.size(v)) or search(a, v, *rest, **more))
    at, found = language_model.find(hashes, key)
    assert sum(searched) == len(set(hashes.tolist())) <= 300
    assert found.tolist() == np.isin(hashes, key).tolist() and (key[at[found]] == hashes[found]).all()
    for a, b in ((hashes[:0], key), (hashes, key[:0])):
        at, found = language_model.find(a, b)
        assert len(at) == len(found) == len(a) and not found.any()


def test_keys_are_made_once_for_classes_and_places():
    """Logits with the keys of classes and places equal plain ones, id by id; padding before a text takes no part."""
    rng = np.random.default_rng(6)
    p = {c: v.astype(np.float64) for c, v in language_model.new_parameters(np.full(language_model.OUTPUTS, 1 / language_model.OUTPUTS)).items()}
    p |= {c: rng.normal(size=p[c].shape) for c in ("prior", "out", "bias")}
    x, _, _ = language_model.windows([rng.integers(0, 20, 50), rng.integers(0, 20, 70)], np.array([True, True]))
    made, block = language_model.keys_of(p), language_model.BLOCK
    got = language_model.forward(p, x, made)[0].reshape(len(x), block, -1)
    assert len(made.classes) == language_model.INPUTS and len(made.places) == 2 * block
    for row, col in itertools.product(range(len(x)), range(block)):
        upto = block + col + 1
        seen = np.flatnonzero(x[row, :upto] != language_model.PAD)
        e = p["embed"][x[row, seen]] + p["place"][seen]
        own = p["embed"][x[row, upto - 1]] + p["place"][upto - 1] + p["prior"][x[row, upto - 2]]
        weight = np.exp(np.minimum(e @ p["k"] @ (own @ p["q"]) / np.sqrt(language_model.DIM), 40))
        want = (own + weight @ (e @ p["v"]) / weight.sum()) @ p["out"] + p["bias"]
        assert np.allclose(got[row, col], np.minimum(want, 60), rtol=1e-5, atol=1e-5)


def test_local_steps_are_adam_over_the_gradients():
    rng = np.random.default_rng(7)
    p = language_model.new_parameters(np.full(language_model.OUTPUTS, 1 / language_model.OUTPUTS))
    x, y, _ = language_model.windows([rng.integers(0, 20, n) for n in (900, 700)], np.array([True, True]))
    start = {c: v.copy() for c, v in p.items()}
    got = language_model.local_steps(p, x, y, 1)
    assert all((p[c] == start[c]).all() for c in p) and len(x) > 2 * language_model.BATCH
    step, order = language_model.STEP * language_model.SLOWER, np.random.default_rng(1).permutation(len(x))
    m, s = {c: 0 for c in p}, {c: 0 for c in p}
    for t, lo in enumerate(range(0, len(x), language_model.BATCH), 1):
        at = order[lo : lo + language_model.BATCH]
        for c, g in language_model.gradients(start, x[at], y[at]).items():
            m[c], s[c] = 0.9 * m[c] + 0.1 * g, 0.99 * s[c] + 0.01 * g * g
            start[c] = (start[c] - step * (m[c] / (1 - 0.9**t)) / (np.sqrt(s[c] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    assert all(got[c].dtype == np.float32 and np.allclose(got[c], start[c], rtol=1e-3, atol=1e-4) for c in p)


def test_each_token_is_scored_once():
    classes = np.arange(400) % 50
    texts = [classes[:1], classes[1:17], classes[17:116], classes[116:400]]
    cut = [(p, k == 0) for t in texts for k, p in enumerate(language_model.pieces_of(t, 64))]
    x, y, piece = language_model.windows([p for p, _ in cut], np.array([f for _, f in cut]))
    assert y[y != language_model.PAD].tolist() == classes.tolist()  # in order, once
    whole = language_model.windows(texts, np.ones(4, bool))
    assert (whole[0] == x).all() and (whole[1] == y).all()
    block = language_model.BLOCK
    for row, col in zip(*np.nonzero(y != language_model.PAD)):
        if x[row, block + col] != language_model.START:
            assert x[row, block + col] == (int(y[row, col]) - 1) % 50
