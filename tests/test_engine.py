"""Store, lookup, overlays, synthetic files, differences, reports, command line and streaming on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from helixlake import cli
from helixlake.functions import draws
from helixlake.functions.variants import genotype_combinations, split_alternates, synthesize_genotype, variant_kind
from helixlake.operators import diff, lookup, overlay, store, summary, synthetic
from helixlake.sinks import genotype_files, reports
from helixlake.sources import genotype_text, tables
from helixlake.streaming.ingest import ingest_files

LOOKUP_HEAD = "query_rsid,query_chrom,query_pos,ref_contig,ref_pos,ref,alt,filters,status\n"
LOOKUP = LOOKUP_HEAD + 'rs2,2,21,NC_000002.12, 21 ,G,"A,C",PASS,exact\nrs2,2,22,NC_000002.12,22,G,C,PASS,EXACT\nrsrs5,X,7,,,T,,,exact\nrs6,1,8,,,,,,not_found\n'


@pytest.fixture
def kept(spark, tmp_path):
    s = store.Store(spark, tmp_path / "store")
    s.replace("references", spark.createDataFrame([(1, 1, "1", 10, "A", "C"), (2, 7, "2", 20, "G", "T"), (3, 1, "10", 5, "AT", "A"), (4, 1, "X", 9, "A", "")], s.read("references").schema))
    return s


def load(spark, kept, tmp_path, text):
    (tmp_path / "l.csv").write_text(text)
    return kept.load_lookup(tables.read_lookup_csv(spark, str(tmp_path / "l.csv")))


def test_store_load(spark, kept, tmp_path):
    assert [tuple(r) for r in kept.read("formats").collect()] == [(1, "dynamic_dna", "GRCh38")]
    assert load(spark, kept, tmp_path, LOOKUP) == {"imported": 3, "skipped": 1}
    rows = {r.rsid: tuple(r)[1:] for r in kept.read("references").collect()}
    assert rows[2] == (7, "2", 22, "G", "C") and rows[5] == (1, "X", 7, "T", "") and len(rows) == 5
    assert [r.chromosome for r in store.ordered_references(kept.read("references")).collect()] == ["1", "10", "2", "X", "X"]
    assert store.Store(spark, kept.path).read("formats").count() == 1
    assert load(spark, kept, tmp_path, LOOKUP_HEAD) == {"imported": 0, "skipped": 0}
    assert load(spark, kept, tmp_path, "") == {"imported": 0, "skipped": 0}


@pytest.mark.parametrize("bad", ["rs7,1,abc,,,,,,exact\n", "rsx,1,5,,,,,,exact\n", "rs7,1,5,,,,,exact\n"])
def test_a_bad_row_leaves_the_store(spark, kept, tmp_path, bad):
    before = sorted(map(tuple, kept.read("references").collect()))
    with pytest.raises(Exception):
        load(spark, kept, tmp_path, LOOKUP + bad)
    assert sorted(map(tuple, kept.read("references").collect())) == before


def test_summaries(spark, kept):
    formats = spark.createDataFrame([(1, "a", "GRCh38"), (7, "b", None), (9, "c", None)], "id long, name string, genome_build string")
    refs = kept.read("references")
    assert [tuple(r) for r in summary.format_counts(formats, refs).collect()] == [("a", 3), ("b", 1), ("c", 0)]
    assert [tuple(r) for r in summary.build_counts(formats).collect()] == [(None, 2), ("GRCh38", 1)]
    one = summary.summary(formats, refs, "p").first()
    assert (one.files_processed, one.total_variants, one.unique_rsids, one.skipped_rows) == (0, 4, 4, 0)
    stats = spark.createDataFrame([("f", 5, 2), ("g", 1, 0)], "file_path string, variant_count long, skipped_rows long")
    seen = summary.summary(formats, refs, "p", stats).first()
    assert (seen.files_processed, seen.total_variants, seen.skipped_rows) == (2, 6, 2)


def test_variant_rules(spark):
    cases = [("A", "G", "snp", "AA", "GG"), ("A", "C, T", "snp", "AA", "CC"), ("A", "", "snp", "AA", "AA"), ("ATG", "", "snp", "ATGATG", "ATGATG"), ("AC", "GT,CA", "mnv", "AA", "GG"), ("A", "AT", "insertion", "DD", "II"),
             ("AT", "A", "deletion", "II", "DD"), ("A", "AT,G", "insertion", "DD", "II"), ("A", "G,AT", "mnv", "AA", "GG"), ("", "A", "insertion", "DD", "II"), ("", "", "snp", "", "")]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "r string, a string").withColumn("l", split_alternates(F.col("a")))
    make = lambda use: synthesize_genotype(F.col("r"), F.col("l"), F.lit(use), F.lit(0))
    assert [tuple(r) for r in df.select("r", "a", variant_kind(F.col("r"), F.col("l")), make(False), make(True)).collect()] == cases
    combos = spark.range(1).select(genotype_combinations(F.lit("A"), F.array(F.lit("C"), F.lit(""), F.lit("G")))).first()[0]
    assert combos == ["AA", "AC", "AG", "CC", "CG", "GG"]


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
NC_000001.11\t98\trs9\tATTT\tA\t.\t.\tX=1
NC_000001.11\t100\trs1\tA\tG\t.\tPASS\tRS=1
NC_000001.11\t200\t.\tC\tT,G\t.\tq10;s50\tVC=SNV;RS=7,8
NC_000001.11\t300\trs3;rs4\tC\t.\t.\tPASS\t.
NC_000001.11\t301\trs3\tC\tA\t.\tPASS\t.
"""


def test_lookup(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    vcf = tables.read_vcf_text(spark, [str(tmp_path / "x.vcf")])
    asked = [("rs1", "chr1", 100), ("rs1", "1", 103), ("rs9", "1", 100), ("rs7", "1", 200), ("rs4", "1", 300), ("rs1", "zz", 100), ("rs1", "Y", 5), ("rs3", "1", 301), ("rs1", "1", 0), ("rs1", "chr1", 100)]
    df = spark.createDataFrame(asked, "rsid string, chromosome string, position long")
    status = lambda w: [(r.rsid, r.position, r.status) for r in lookup.find_records(df, vcf, w).collect()]
    assert sorted(status(0)) == sorted([("rs1", 100, "exact"), ("rs1", 103, "not_found"), ("rs9", 100, "exact"), ("rs7", 200, "exact"), ("rs4", 300, "exact"), ("rs1", 100, "no_contig"), ("rs1", 5, "missing_contig"),
                                        ("rs3", 301, "exact"), ("rs1", 0, "not_found"), ("rs1", 100, "exact")])
    assert ("rs1", 103, "window") in status(5)
    rows = {(r.query_rsid, r.query_pos, r.status): r for r in lookup.lookup_rows(lookup.find_records(df, vcf)).collect()}
    assert tuple(rows["rs9", "100", "exact"])[3:] == ("NC_000001.11", "98", "ATTT", "A", "PASS", "exact")
    assert rows["rs7", "200", "exact"].alt == "T,G" and rows["rs7", "200", "exact"].filters == "q10;s50" and rows["rs1", "5", "missing_contig"].ref_pos == ""
    assert tables.by_id(vcf, "rs3").count() == 1 and lookup.find_records(df, vcf, before=50, after=50).where("status = 'window'").count() == 1
    tables.vcf_to_parquet(spark, [str(tmp_path / "x.vcf")], str(tmp_path / "vcf"))
    assert spark.read.parquet(str(tmp_path / "vcf")).count() == 5


def test_diff(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\nrs1\t1\t5\tAA\nrs2\t1\t6\tAG\nrs3\t1\t7\tCC\nshort\t1\n")
    (tmp_path / "b.txt").write_text("rs1\t1\t5\tAA\nrs2\t1\t6\tGG\nrs4\t1\t8\tTT\nrs4\t1\t8\tTA\n")
    a, b = (tables.genotype_map(genotype_text.read_lines(spark, [str(tmp_path / n)])) for n in ("a.txt", "b.txt"))
    text = reports.diff_report(diff.compare(a, b))
    assert text.split("\n") == ["Baseline rows: 3", "Candidate rows: 3", "Missing in candidate: 1", "Not present in baseline: 1", "Genotype/position differences: 1",
                                "- rs2: baseline 1:6 AG vs candidate 1:6 GG", "Sample missing rsids: rs3", "Sample new rsids: rs4"]
    same = diff.diff_summary(diff.compare(a, a)).first()
    assert (same.missing, same.added, same.differences) == (0, 0, 0)
    assert {r.rsid: r.genotype for r in b.collect()}["rs4"] == "TA"


OVERLAY = {"g": {"description": "d", "variants": [{"rsid": "rs2", "chromosome": "9", "position": 99, "reference": "I", "alternates": ["D"]}, {"rsid": "rs77", "chromosome": "7", "position": 7, "genotypes": ["QQ"]}]}}


def test_overlay_errors(spark):
    specs = lambda *v: overlay.checked_specs(tables.overlay_variants(spark, text=json.dumps({"g": {"variants": list(v)}}))).collect()
    good = {"rsid": "rs1", "chromosome": "1", "position": 1, "reference": "A"}
    assert specs(good)[0].options == ["AA"]
    for bad in ([good, good], [{**good, "genotypes": []}], [{"rsid": "rs1", "chromosome": "1", "position": 1}], [{**good, "rsid": "x"}]):
        with pytest.raises(Exception):
            specs(*bad)
    with pytest.raises(ValueError):
        tables.overlay_variants(spark, "p", "{}")
    assert tables.overlay_variants(spark).count() == 0


def test_synthetic_rows(spark, kept):
    refs = store.ordered_references(kept.read("references"))
    specs = overlay.checked_specs(tables.overlay_variants(spark, text=json.dumps(OVERLAY)))
    files = spark.range(3).select(F.col("id").alias("file_idx"))
    make = lambda n, f=0.5: synthetic.synthetic_rows(refs.repartition(n), files.repartition(n), specs, f, 11)
    one = sorted(map(tuple, make(1).collect()))
    assert one == sorted(map(tuple, make(5).collect())) and len(one) == 15
    assert all(r[3:6] != ("2", 20, "GG") and r[3] == "9" and r[5] in ("DD", "DI", "II") for r in one if r[2] == 2)
    assert [(r[1], r[5]) for r in one if r[2] == 77] == [(True, "QQ")] * 3
    assert all(r[5] == {1: "AA", 3: "II", 4: "AA"}[r[2]] for r in map(tuple, make(2, 0.0).collect()) if r[2] in (1, 3, 4))
    many = spark.range(5000).select(F.col("id").alias("rsid"), F.lit("1").alias("chromosome"), F.col("id").alias("position"), F.lit("A").alias("reference"), F.lit("C,G").alias("alternates"))
    rows = synthetic.synthetic_rows(many, files, None, 0.2, 3)
    share = rows.agg(F.avg((F.col("genotype") != "AA").cast("double"))).first()[0]
    assert abs(share - 0.2) < 0.02 and rows.where("cast(gs as double) not between 0.2 and 1 or cast(baf as double) not between 0 and 1 or cast(lrr as double) not between -0.5 and 0.5").count() == 0


def test_arguments_and_plans(spark):
    for bad in (dict(alt_frequency=1.5), dict(alt_frequency=float("nan")), dict(count=0), dict(count=2), dict(id_min=5, id_max=4), dict(month_min=0), dict(day_max=32), dict(month_min=5, month_max=4)):
        with pytest.raises(ValueError):
            synthetic.check_arguments("x.txt", **bad)
    with pytest.raises(ValueError):
        synthetic.check_arguments("{id}", count=11, id_min=1, id_max=10)
    plans = synthetic.file_plans(spark, "{id}-{index}-{date}", 10, 4, 1, 10).collect()
    assert sorted(p.id for p in plans) == list(range(1, 11)) and len({p.path for p in plans}) == 10 and [p.seed for p in sorted(plans)] == list(range(4, 14))
    with pytest.raises(Exception):
        synthetic.file_plans(spark, "{date}", 1, 1, year=2025, month_min=2, month_max=2, day_min=30, day_max=30).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutations_take_each_place_once(spark, size):
    made = lambda seed: [r[0] for r in spark.range(size).orderBy("id").select(draws.permuted(F.col("id"), size, seed, "id")).collect()]
    assert sorted(made(1)) == list(range(size)) and (size < 16 or made(1) != made(2) != list(range(size)))


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    home, lookup_csv = tmp_path / "store", tmp_path / "l.csv"
    lookup_csv.write_text(LOOKUP)
    run("reference-load", "--sqlite", home, "--lookup", lookup_csv)
    run("allele-report", "--sqlite", home, "--output", tmp_path / "r" / "report.html")
    html = (tmp_path / "r" / "report.html").read_text()
    assert html.count("<td>rs") == 2 and "Unique rsids: <b>2</b>" in html
    with pytest.raises(ValueError):
        run("allele-report", "--sqlite", home, "--output", tmp_path / "report")
    (tmp_path / "o.json").write_text(json.dumps(OVERLAY))
    run("synthetic", "--sqlite", home, "--output", tmp_path / "out" / "{index}.txt", "--count", 3, "--seed", 5, "--variants-file", tmp_path / "o.json")
    written = sorted((tmp_path / "out").iterdir())
    assert [p.name for p in written] == ["0001.txt", "0002.txt", "0003.txt"]
    lines = written[0].read_text().split("\n")
    assert lines[:18] == genotype_files.HEADER.split("\n")[:18] and [x.split("\t")[0] for x in lines[18:-1]] == ["rs2", "rs5", "rs77"]
    run("genostats", "-i", tmp_path / "out", "--sqlite", home, "--summary-json", tmp_path / "s.json")
    seen = json.loads((tmp_path / "s.json").read_text())
    assert (seen["files_processed"], seen["total_variants"], seen["skipped_rows"], seen["unique_rsids"]) == (3, 9, 0, 2)
    written[2].rename(tmp_path / "out" / "_0003.txt")
    run("genostats", "-i", tmp_path / "out", "--sqlite", home, "--skip-recorded-files", "--summary-json", tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text())["files_processed"] == 4 and store.Store(spark, home).read("manifest").where("file_path like '%/_0003.txt'").count() == 1
    run("genostats", "-i", tmp_path / "out", "--sqlite", home, "--skip-recorded-files", "--mode", "parity")
    run("diff", written[0], written[0])
    assert "Genotype/position differences: 0" in capsys.readouterr().out
    (tmp_path / "x.vcf").write_text(VCF)
    (tmp_path / "g.txt").write_text("# h\nrs1\t1\t100\tAG\nrs1\t1\t103\tAG\nrs7\t1\t2_00\tCC\nrs7\t1\tx\tCC\n")
    run("extract", "--input", tmp_path / "g.txt", "--vcf", tmp_path / "x.vcf", "--output", tmp_path / "e.csv", "--missing-output", tmp_path / "m.csv")
    assert (tmp_path / "e.csv").read_text().split("\n")[1].startswith("rs1,1,100,NC_000001.11,100,A,G,PASS,exact") and (tmp_path / "m.csv").read_text().count("\n") == 2
    run("generate", "--lookup", lookup_csv, "--output", tmp_path / "gen.txt", "--seed", 1, "--alt-frequency", 0)
    assert [x.split("\t")[:4] for x in (tmp_path / "gen.txt").read_text().split("\n")[18:-1]] == [["rs2", "2", "21", "GG"], ["rsrs5", "X", "7", "TT"]]


def test_streaming_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("rs1 1 5 AA\nrs2 1 x AA\n")
    go = lambda: ingest_files(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    go()
    (folder / "b.csv").write_text("rsid,chr,pos,gt\nrs1,1,5,AA\n")
    go()
    rows = {r.file_path.split("/")[-1]: (r.variant_count, r.skipped_rows) for r in store.Store(spark, tmp_path / "store").read("manifest").collect()}
    assert rows == {"a.txt": (1, 1), "b.csv": (1, 0)}
