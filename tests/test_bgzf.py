"""Blocked gzip VCF: ranges, index, filters, and the writer, against the plain text."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixlake.functions import bins
from helixlake.operators import lookup
from helixlake.sinks import bgzf as writer
from helixlake.sources import bgzf, tables

HEAD = "##fileformat=VCFv4.2\n##contig=<ID=c1>\n##contig=<length=5,ID=none>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


def records(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        pos, long = rng.choice([rng.randint(1, 300_000), rng.randint(250_000, 40_000_000)]), rng.random() < 0.1
        stop = pos + rng.choice([10, 20_000, 3_000_000]) if long else pos + rng.randint(0, 3)
        ref, info = ("A", f"END={stop}") if long else ("A" * (stop - pos + 1), "VC=SNV" + "x" * rng.choice([0, 0, 300]))
        out.append((rng.choice(["c1", "c2", "c10"]), pos, stop, k, f"rs{k}\t{ref}\tG\t.\tPASS\t{info}"))
    return sorted(out)


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    rows = records()
    path = str(tmp_path_factory.mktemp("bgzf") / "x.vcf.gz")
    df = spark.createDataFrame([(c, p, s, o, f"{c}\t{p}\t{rest}") for c, p, s, o, rest in rows], "contig string, pos long, stop long, order long, line string").repartition(5)
    assert writer.write_bgzf_vcf(df, path, HEAD, parts=4, block_bytes=700) > 1
    return path, rows


def test_the_file_is_gzip_and_in_order(file):
    path, rows = file
    assert gzip.open(path, "rt").read() == HEAD + "".join(f"{c}\t{p}\t{rest}\n" for c, p, _, _, rest in rows)
    assert bgzf.header_lines(path) == HEAD.splitlines() and tables.declared_contigs(HEAD.splitlines()) == ["c1", "none"]


@pytest.mark.parametrize("split", [1, 100, 1777, 1 << 20])
def test_ranges_read_each_line_once(file, split):
    path, rows = file
    reader = bgzf.VcfBlocksReader({"path": path, "splitBytes": str(split)})
    parts = reader.partitions()
    assert split > 2000 or len(parts) > 10
    lines = [line for p in parts for b in reader.read(p) for line in b.column("line").to_pylist()]
    assert lines == [f"{c}\t{p}\t{rest}" for c, p, _, _, rest in rows]


def offsets(reader):
    return [at for p in reader.partitions() for b in reader.read(p) for at in b.column("file_order").to_pylist()]


def test_regions_read_only_their_blocks(file):
    path, rows = file
    rng = random.Random(4)
    whole = bgzf.VcfBlocksReader({"path": path})
    every = {at >> 16 for at in offsets(whole)}
    for n in range(60):
        regions = [[rng.choice(["c1", "c2", "c10", "c99"]), a := rng.choice([0, rng.randint(0, 40_000_000)]), a + rng.choice([1, 500, 100_000])] for _ in range(rng.choice([1, 1, 4]))]
        reader = bgzf.VcfBlocksReader({"path": path, "regions": __import__("json").dumps(regions), "splitBytes": str(rng.choice([1, 3000, 1 << 20]))})
        found = [line.split("\t")[2] for p in reader.partitions() for b in reader.read(p) for line in b.column("line").to_pylist()]
        want = [f"rs{o}" for c, p, s, o, _ in rows if any(c == rc and p - 1 < b and s > a for rc, a, b in regions)]
        assert sorted(found) == sorted(want) and len(set(found)) == len(found)
        if len(regions) == 1:
            touched = {at >> 16 for p in reader.partitions() for a, b in p.chunks for at in range(a >> 16, (b >> 16) + 1) if at in every}
            # A level of long records and the bins of a region: a small part of the file.
            assert len(touched) < len(every) / 2


def test_regions_of_one_read_leave_others_alone(spark, file):
    path, rows = file
    whole, part = bgzf.read_blocks(spark, path, split_bytes=2000), bgzf.read_blocks(spark, path, [("c2", 1_000_000, 5_000_000)], 2000)
    want = sorted(f"{c}\t{p}\t{rest}" for c, p, s, _, rest in rows if c == "c2" and s > 1_000_000 and p <= 5_000_000)
    assert sorted(r.line for r in part.collect()) == want and part.rdd.getNumPartitions() < whole.rdd.getNumPartitions() / 2
    assert whole.where("contig = 'c2' and stop > 1000000 and pos <= 5000000").count() == len(want)
    assert whole.count() == len(rows) and part.where("pos < 0").count() == 0 and part.count() == len(want)


def test_index_comes_back(file):
    path, rows = file
    index = bgzf.Index.read(f"{path}.tbi")
    assert index.names == sorted({r[0] for r in rows}) and index.content() == bgzf.Index(index.names, index.bins, index.windows).content()
    for contig, own in zip(index.names, index.bins):
        assert set(own) == {bins.bin_number(p - 1, s) for c, p, s, _, _ in rows if c == contig}


def test_bins(spark):
    rng = random.Random(2)
    spans = [(a := rng.randint(0, 1 << rng.randint(1, 29)), a + rng.randint(1, 1 << rng.randint(1, 28))) for _ in range(500)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", bins.bin_of(F.col("a"), F.col("b")).alias("bin"), bins.level_of(F.col("a"), F.col("b")).alias("level"))
    for r in df.collect():
        assert r.bin == bins.bin_number(r.a, r.b) and any(r.bin in x for x in bins.bins_over(r.a, r.b))
        assert r.b - r.a <= bins.level_span(r.level) and all(any(r.bin in x for x in bins.bins_over(a, b)) for a, b in spans if a < r.b and b > r.a)


def test_odd_files(spark, tmp_path):
    line = "c1\t5\trs1\tA\tG\t.\tPASS\t."
    for name, data in (("open", writer.in_blocks((HEAD + line).encode())), ("ended", writer.in_blocks((HEAD + line + "\n").encode()) + bgzf.END_BLOCK), ("windows", writer.in_blocks((HEAD + line + "\r\n").encode()) + bgzf.END_BLOCK)):
        (tmp_path / f"{name}.vcf.gz").write_bytes(data)
        assert [(r.pos, r.ref, r.info_rs) for r in tables.read_vcf_blocks(spark, tmp_path / f"{name}.vcf.gz", split_bytes=7).collect()] == [(5, "A", None)]
    (tmp_path / "none.vcf.gz").write_bytes(writer.in_blocks(HEAD.encode()) + bgzf.END_BLOCK)
    assert tables.read_vcf_blocks(spark, tmp_path / "none.vcf.gz").count() == 0
    broken = bytearray(writer.in_blocks((HEAD + line).encode()))
    broken[40] ^= 1
    (tmp_path / "broken.vcf.gz").write_bytes(broken)
    with pytest.raises(Exception):
        tables.read_vcf_blocks(spark, tmp_path / "broken.vcf.gz").collect()
    with gzip.open(tmp_path / "plain.vcf.gz", "wt") as f:
        f.write(HEAD + line + "\n")
    assert not tables.is_blocked(tmp_path / "plain.vcf.gz") and tables.is_blocked(tmp_path / "open.vcf.gz") and not tables.is_blocked(tmp_path / "x.vcf")
    empty = spark.createDataFrame([], "contig string, pos long, stop long, line string")
    writer.write_bgzf_vcf(empty, str(tmp_path / "no.vcf.gz"), HEAD)
    assert tables.read_vcf_blocks(spark, tmp_path / "no.vcf.gz").count() == 0 and bgzf.Index.read(str(tmp_path / "no.vcf.gz.tbi")).names == []


def test_converted_table_is_pruned_by_both_bounds(spark, file, tmp_path):
    path, rows = file
    out = str(tmp_path / "records")
    tables.vcf_to_parquet(spark, [path], out)
    vcf = tables.read_vcf(spark, out)
    asked = spark.createDataFrame([("rs1", "1", 20_000_000)], "rsid string, chromosome string, position long")
    named = vcf.withColumn("contig", F.when(F.col("contig") == "c1", "NC_000001.11").otherwise(F.col("contig")))
    assert lookup.prune_records(named, asked).count() < vcf.count() / 2
    plan = lookup.prune_records(vcf, asked)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(pos," in plan and "LessThanOrEqual(pos," in plan and "PartitionFilters" in plan
    for at in (1, 20_000_000, 39_999_000):
        one = spark.createDataFrame([("rs1", "1", at)], "rsid string, chromosome string, position long")
        kept = {r.file_order for r in lookup.prune_records(named, one, 10).collect()}
        assert kept >= {r.file_order for r in named.where(f"contig = 'NC_000001.11' and pos - 1 < {at + 10} and stop > {at - 11}").collect()}
    known = {r.contig: r for r in tables.vcf_contigs(spark, out).collect()}
    assert known["none"].records == 0 and known["none"].declared and not known["c2"].declared
    with pytest.raises(FileExistsError):
        tables.vcf_to_parquet(spark, [path], str(tmp_path))
