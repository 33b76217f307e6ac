"""Loads into buckets: what is rewritten, what stays, writers that meet, and tables that grow."""

import os

import pytest

from helixlake.operators import store

LOOKUP = "query_rsid string, query_chrom string, query_pos string, ref_pos string, ref string, alt string, status string, seq long"


def lookup(spark, keys, ref="A", status="exact"):
    return spark.createDataFrame([(f"rs{k}", "1", str(k), "", ref, "G", status, n) for n, k in enumerate(keys)], LOOKUP)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and not f.startswith(".")}


def refs(kept):
    return {r.rsid: r.reference for r in kept.read("references").collect()}


def test_a_load_writes_only_its_buckets(spark, tmp_path):
    kept = store.Store(spark, tmp_path / "s", buckets=8)
    assert kept.load_lookup(lookup(spark, range(200))) == {"imported": 200, "skipped": 0}
    before = files(f"{kept.path}/references")
    assert len(before) == 8
    assert kept.load_lookup(lookup(spark, [3, 11, 3, 1003], "T")) == {"imported": 4, "skipped": 0}
    after = files(f"{kept.path}/references")
    # Seven buckets' files are untouched; the eighth has a new file beside the old one, which the commit before still names.
    assert all(after[f] == t for f, t in before.items()) and len(after) == 9
    assert refs(kept) == {k: "A" for k in range(200)} | {3: "T", 11: "T", 1003: "T"}
    kept.load_lookup(lookup(spark, [19], "C"))
    assert len(files(f"{kept.path}/references")) == 9 and refs(kept)[19] == "C" and len(kept.commits("references")) == 2


def test_nothing_exact_writes_nothing(spark, tmp_path):
    kept = store.Store(spark, tmp_path / "s")
    kept.load_lookup(lookup(spark, [1]))
    before, commits = files(kept.path), kept.commits("references")
    assert kept.load_lookup(lookup(spark, [1, 2], status="window")) == {"imported": 0, "skipped": 2}
    assert kept.load_lookup(lookup(spark, [], status="window")) == {"imported": 0, "skipped": 0}
    assert files(kept.path) == before and kept.commits("references") == commits


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    one = store.Store(spark, tmp_path / "s")
    one.load_lookup(lookup(spark, [1, 2]))
    two = store.Store(spark, tmp_path / "s", create=False)

    def slow(old, new):
        one.load_lookup(lookup(spark, [3]))
        return store.upserted(old, new.drop("copies"))

    with pytest.raises(RuntimeError, match="another writer"):
        two.merge("references", lambda n: store.staged_lookup(lookup(spark, [4]), n), slow)
    assert sorted(refs(two)) == [1, 2, 3]
    two.load_lookup(lookup(spark, [4]))
    assert sorted(refs(one)) == [1, 2, 3, 4]


def test_buckets_double_as_a_table_grows(spark, tmp_path):
    kept = store.Store(spark, tmp_path / "s", buckets=2, bucket_rows=10)
    for k in range(3):
        kept.load_lookup(lookup(spark, range(20 * k, 20 * k + 20), "ACG"[k]))
    state = kept.state("references")
    assert state["buckets"] == 8 and sum(n for _, n in state["files"].values()) == 60
    assert refs(kept) == {k: "ACG"[k // 20] for k in range(60)}
    assert store.Store(spark, tmp_path / "s", create=False).state("references")["buckets"] == 8


def test_text_keys_and_replacement(spark, tmp_path):
    kept = store.Store(spark, tmp_path / "s", buckets=4)
    stats = lambda *rows: spark.createDataFrame(rows, "file_path string, variant_count long, skipped_rows long")
    kept.record_files(stats(*[(f"f{k}", k, 0) for k in range(30)]))
    kept.record_files(stats(("f3", 99, 1), ("new", 1, 1)))
    got = {r.file_path: r.variant_count for r in kept.read("manifest").collect()}
    assert got == {f"f{k}": k for k in range(30)} | {"f3": 99, "new": 1}
    kept.replace("manifest", kept.read("manifest").where("file_path = 'new'"))
    assert [r.file_path for r in kept.read("manifest").collect()] == ["new"] and kept.state("manifest")["buckets"] == 4
