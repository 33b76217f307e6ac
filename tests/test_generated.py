"""The older generator's rows and the lookup they are made of are read once, by built-in functions where each line is a record."""

import itertools

from pyspark.sql import functions as F

from helixlake.operators import synthetic
from helixlake.sinks import genotype_files
from helixlake.sources import csv_records, tables

HEAD = "query_rsid,query_chrom,query_pos,ref_pos,ref,alt,status\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lookup(tmp_path, n, alt='"C,T"'):
    path = tmp_path / "l.csv"
    path.write_text(HEAD + "".join(f"rs{k},1,{k},{k},A,{alt},{'exact' if k % 3 else 'window'}\n" for k in range(n)))
    return str(path)


def test_spark_sees_what_python_sees_of_quotes(spark):
    lines = ["".join(x) for n in range(8) for x in itertools.product('", a', repeat=n)] + ["x" * 100_000 + ',"' + 'a""' * 50_000 + '"\r', '\t"a" b,c', '"a"\t"', "a," * 20_000]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string")
    whole = ~F.contains("value", F.lit('"')) | F.col("value").rlike(csv_records._SPARK_WHOLE)
    got = [r.whole for r in rows.select("k", whole.alias("whole")).orderBy("k").collect()]
    assert got == [not csv_records.ends_inside(x, False) for x in lines]


def test_lines_that_are_records_take_no_python(spark, tmp_path):
    got = csv_records.read_csv(spark, lookup(tmp_path, 500))
    assert "MapInArrow" not in plan(got)
    assert [(r.query_rsid, r.alt, r.seq) for r in got.orderBy("seq").collect()] == [(f"rs{k}", "C,T", k + 1) for k in range(500)]
    broken = csv_records.read_csv(spark, lookup(tmp_path, 500, '"C,\nT"'))
    assert [(r.query_rsid, r.alt, r.seq) for r in broken.orderBy("seq").collect()] == [(f"rs{k}", "C,\nT", 2 * k + 1) for k in range(500)]


def test_splits_and_files_keep_their_order(spark, tmp_path):
    """Also with line ends of two characters, an empty file and a header of its own in each file."""
    (tmp_path / "many").mkdir()
    body = [[f'{name}{k},"{k},x"' for k in range(3000)] for name in "ab"]
    for name, lines in zip("ab", body):
        (tmp_path / "many" / f"{name}.csv").write_text("id,v\r\n" + "".join(f"{x}\r\n" for x in lines), newline="")
    (tmp_path / "many" / "0.csv").write_text("")
    given = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = csv_records.read_csv(spark, str(tmp_path / "many"))
        assert got.columns == ["id", "v", "seq"] and "MapInArrow" not in plan(got)
        assert [tuple(r) for r in got.orderBy("seq").collect()] == [(f"{name}{k}", f"{k},x", 3001 * at + k + 1) for at, name in enumerate("ab") for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", given)


def test_generated_rows_read_the_lookup_once(spark, tmp_path):
    rows = tables.exact_rows(tables.read_lookup_csv(spark, lookup(tmp_path, 90)))
    made = synthetic.generated_rows(rows, spark.createDataFrame([(0,)], "file_idx long"), 0.25, 7)
    assert plan(made).count("FileScan") == 1 and "CartesianProduct" not in plan(made)
    genotype_files.write_generated_file(made, str(tmp_path / "g.txt"))
    lines = [x for x in (tmp_path / "g.txt").read_text().split("\n") if x and not x.startswith("#")]
    assert [x.split("\t")[:3] for x in lines] == [[f"rs{k}", "1", str(k)] for k in range(90) if k % 3]
