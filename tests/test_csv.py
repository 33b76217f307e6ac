"""CSV whose values hold line breaks, in splits of any size, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from helixlake.sources import csv_records, tables

NAMES = ["query_rsid", "query_chrom", "query_pos", "ref_pos", "ref", "alt", "status"]


def table(n=400, seed=1):
    rng = random.Random(seed)
    values = ["a", "", "x y", 'say ""'.replace('""', '"'), "one\ntwo", "a,b", "\n\n", '"', 'q"\n"q', "é\n日", "plain", "long " * 30 + "\n" + "end"]
    return [[f"rs{k}", *[rng.choice(values) for _ in NAMES[1:]]] for k in range(n)]


def written(path, rows, end="\n", names=NAMES):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([names, *rows])
    path.write_text(out.getvalue(), newline="")
    return str(path)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size,end", [(64, "\n"), (1000, "\n"), (777, "\r\n"), (1 << 27, "\n")])
def test_values_with_line_breaks(spark, tmp_path, small_splits, size, end):
    rows = table(60 if size < 100 else 400)
    path = written(tmp_path / "l.csv", rows, end)
    small_splits(size)
    got = csv_records.read_csv(spark, path)
    assert [[c or "" for c in r][:-1] for r in got.orderBy("seq").collect()] == [[c.strip(" ") for c in r] for r in rows]
    assert size > 2000 or csv_records.read_records(spark, path).rdd.getNumPartitions() > 3


def test_one_value_over_many_splits(spark, tmp_path, small_splits):
    rows = [["rs1", "a", "", "", "", "", "x"], ["rs2", "line\n" * 500 + "end", "b", "", "", "", "y"], ["rs3", "c", "", "", "", "", "z"]]
    path = written(tmp_path / "l.csv", rows)
    small_splits(200)
    got = csv_records.read_csv(spark, path).orderBy("seq").collect()
    assert [[c or "" for c in r][:-1] for r in got] == rows


@pytest.mark.parametrize("bad", ["rs9,1\n", "rs9,1,2,3,4,5,6,7\n", 'rs9,"open\n'])
def test_ragged_and_open_records_fail(spark, tmp_path, bad):
    path = written(tmp_path / "l.csv", table(20))
    with open(path, "a") as f:
        f.write(bad)
    with pytest.raises(Exception):
        tables.read_lookup_csv(spark, path).collect()


def test_stray_quotes_are_text(spark, tmp_path, small_splits):
    (tmp_path / "l.csv").write_text(",".join(NAMES) + '\nrs1,5" pipe,b"c,1,2,3,exact\n\nrs2, "a\nb" ,c,1,2,3,exact\n   \nrs3,x,"""",1,2,3,exact')
    small_splits(40)
    got = tables.read_lookup_csv(spark, str(tmp_path / "l.csv")).orderBy("seq").collect()
    assert [(r.query_rsid, r.query_chrom, r.query_pos) for r in got] == [("rs1", '5" pipe', 'b"c'), ("rs2", "a\nb", "c"), ("rs3", "x", '"')]


def test_empty_files_and_headers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert tables.read_lookup_csv(spark, str(tmp_path / "e.csv")).count() == 0
    assert tables.read_lookup_csv(spark, written(tmp_path / "h.csv", [])).count() == 0
    with pytest.raises(ValueError):
        tables.read_lookup_csv(spark, written(tmp_path / "x.csv", [["1"]], names=["a"]))
    spaced = written(tmp_path / "s.csv", [["rs1", *["v"] * 6]], names=[f" {n} " for n in NAMES])
    assert tables.read_lookup_csv(spark, spaced).select(F.col("query_rsid")).first()[0] == "rs1"


def test_line_states_by_hand():
    cases = [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('"a","b"', False, False), ('"a","b', False, True), ('a"b,c', False, False), ('x","y', True, True), ('x"', True, False), ('"a""', False, True), ("", True, True), (' "a', False, True), ('x" ,"y"', True, False)]
    assert [csv_records.ends_inside(line, inside) for line, inside, _ in cases] == [want for *_, want in cases]
