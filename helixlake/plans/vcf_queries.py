"""Queries over blocked gzip VCF files and converted tables, written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake import storage
from helixlake.operators import lookup
from helixlake.plans import base
from helixlake.plans.base import spark_sql
from helixlake.plans.queries import QUERIES, found_sql, query
from helixlake.sinks.bgzf import write_bgzf_vcf
from helixlake.sources import bgzf, tables

#: Records that lie far apart, one in eight of them a long deletion that INFO/END bounds and that reaches over many bins.
LONG_VCF = f"""SELECT contig, pos, id, CASE WHEN long THEN 'A' ELSE ref END AS ref, CASE WHEN long THEN '<DEL>' WHEN file_order % 3 = 0 THEN '.' WHEN file_order % 3 = 1 THEN 'G' ELSE 'G,T' END AS alt, rs_info, file_order,
  CASE WHEN long THEN pos + file_order % 50 * 4001 ELSE pos - 1 + length(ref) END AS stop, long
  FROM (SELECT contig, (pos - 10) * 977 + 10 AS pos, id, ref, rs_info, file_order, file_order % 8 = 3 AS long FROM ({base.VCF}) AS v) AS w"""
LONG_ASKED = "SELECT concat('rs', CAST(c_custkey % 300 AS VARCHAR(20))) AS rsid, CASE c_custkey % 7 WHEN 0 THEN '1' WHEN 1 THEN 'chr2' WHEN 2 THEN ' Chr3 ' WHEN 3 THEN 'x' WHEN 4 THEN 'M' WHEN 5 THEN '7' ELSE 'Y' END AS chromosome, (c_custkey % 510) * 977 + 5 AS position, c_custkey FROM {customer}"
#: A contig that the header declares and no record has.
DECLARED = ["NC_000007.14", "NC_000001.11"]
HEADER = "##fileformat=VCFv4.2\n" + "".join(f"##contig=<ID={c},length=1000000>\n" for c in DECLARED) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
WINDOW, BLOCK, SPLIT = 9_000, 4_096, 4_096
FOUND = found_sql(WINDOW, source=LONG_ASKED, vcf=LONG_VCF, declared="'NC_000007.14'")


def _blocked_file(spark, sf_dir) -> str:
    info = F.concat_ws(";", F.lit("VC=X"), F.concat(F.lit("RS="), F.col("rs_info").cast("string")), F.when(F.col("long"), F.concat(F.lit("END="), F.col("stop").cast("string"))))
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("PASS"), info)
    rows = spark_sql(spark, sf_dir, LONG_VCF).select("contig", "pos", "stop", F.col("file_order").alias("order"), line.alias("line"))
    path = f"{storage.new_path(spark, 'query')}/records.vcf.gz"
    write_bgzf_vcf(rows, path, HEADER, parts=5, block_bytes=BLOCK)
    return path


@query(f"""SELECT contig, pos, stop, id, ref, CASE alt WHEN '.' THEN '' ELSE replace(alt, ',', '/') END AS alts, CAST(rs_info AS VARCHAR) AS rs FROM ({LONG_VCF}) AS t""")
def bgzf_records(spark, sf_dir):
    """All records of a blocked file in ranges of a few blocks, without its index."""
    rows = tables.read_vcf_blocks(spark, _blocked_file(spark, sf_dir), split_bytes=SPLIT)
    return rows.select("contig", "pos", "stop", "id", "ref", F.array_join("alts", "/").alias("alts"), F.array_join(F.col("info_rs").cast("array<string>"), ",").alias("rs"))


@query(f"SELECT contig, pos, stop, file_order % 8 = 3 AS symbolic FROM ({LONG_VCF}) AS t WHERE contig IN ('NC_000002.12', 'NC_000023.11') AND stop > 200000 AND pos <= 260000")
def bgzf_region_fetch(spark, sf_dir):
    """A region of two contigs through the index, deletions that begin far before it included."""
    regions = [("NC_000002.12", 200_000, 260_000), ("NC_000023.11", 200_000, 260_000)]
    rows = bgzf.read_blocks(spark, _blocked_file(spark, sf_dir), regions, SPLIT)
    return rows.select("contig", "pos", "stop", F.col("line").contains("<DEL>").alias("symbolic"))


@query(FOUND)
def bgzf_marker_lookup(spark, sf_dir):
    """Markers of customer against the indexed file: only the blocks of their windows are read; a declared contig without records is known."""
    path, asked = _blocked_file(spark, sf_dir), spark_sql(spark, sf_dir, LONG_ASKED)
    vcf = tables.read_vcf_blocks(spark, path, lookup.wanted_regions(asked, WINDOW), SPLIT)
    names = tables.declared_contigs(tables.header_of(spark, path)) + bgzf.Index.read(f"{path}.tbi").names
    known = spark.createDataFrame([(c,) for c in dict.fromkeys(names)], "contig string")
    return lookup.find_records(asked, vcf, WINDOW, known=known).select("c_custkey", "rsid", "contig", "record.pos", "record.ref", "status")


def _converted(spark, sf_dir) -> str:
    out = f"{storage.new_path(spark, 'query')}/records"
    tables.vcf_to_parquet(spark, [_blocked_file(spark, sf_dir)], out)
    return out


@query(FOUND)
def binned_marker_lookup(spark, sf_dir):
    """The same markers against the converted table, pruned by contig, level and both bounds of the position."""
    path, asked = _converted(spark, sf_dir), spark_sql(spark, sf_dir, LONG_ASKED)
    vcf = lookup.prune_records(tables.read_vcf(spark, path), asked, WINDOW)
    return lookup.find_records(asked, vcf, WINDOW, known=tables.vcf_contigs(spark, path)).select("c_custkey", "rsid", "contig", "record.pos", "record.ref", "status")


@query(f"""SELECT contig, count(*) AS records, max(stop - pos + 1) AS longest, min(pos) AS least, max(pos) AS most, contig IN ('NC_000001.11') AS declared FROM ({LONG_VCF}) AS t GROUP BY contig
  UNION ALL SELECT 'NC_000007.14', 0, NULL, NULL, NULL, true""")
def vcf_contig_table(spark, sf_dir):
    return tables.vcf_contigs(spark, _converted(spark, sf_dir))


assert QUERIES
