"""Lookup CSV, plain genotype rows, VCF text and overlay JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import schemas, shared_files
from helixlake.functions.bins import level_of
from helixlake.functions.text import parse_python_int, trim
from helixlake.functions.variants import split_alternates
from helixlake.sources import bgzf, csv_records
from helixlake.storage import exists, names, new_path, read_text


def read_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns by name, trimmed, empty for blank cells, with seq, the rows' order in the file. A row too short or too long fails the whole read."""
    rows = csv_records.read_csv(spark, path)
    if rows is None:  # a file without a header line
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in schemas.LOOKUP_NEEDED) + ", seq long")
    if missing := [c for c in schemas.LOOKUP_NEEDED if c not in rows.columns]:
        raise ValueError(f"{path} has no column {missing}")
    return rows.select(*[F.coalesce(trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns if c != "seq"], "seq")


def exact_rows(lookup: DataFrame) -> DataFrame:
    """The older generator's view of a lookup: status exactly 'exact', alternates as a list, rows without reference dropped, order kept."""
    rows = lookup.where("status = 'exact'").select(F.col("query_rsid").alias("rsid"), F.col("query_chrom").alias("chromosome"), F.col("query_pos").alias("position"),
                                                   trim(F.col("ref")).alias("reference"), split_alternates(F.col("alt")).alias("alternates"), "seq")
    return rows.where("reference <> ''")


def _tab_rows(lines: DataFrame, least: int) -> DataFrame:
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", F.split(trim(F.col("value")), "\t", -1))
    return rows.where(F.size("f") >= least)


def marker_rows(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """rsid, chromosome, position, line_no of tab rows of three fields or more with an integer position; the first limit of them (none or 0: all)."""
    rows = _tab_rows(lines, 3).select("line_no", F.get("f", F.lit(0)).alias("rsid"), F.get("f", F.lit(1)).alias("chromosome"), parse_python_int(F.get("f", F.lit(2))).alias("position"))
    rows = rows.where("position is not null")
    return rows.orderBy("line_no").limit(limit) if limit else rows


def genotype_map(lines: DataFrame) -> DataFrame:
    """rsid, chromosome, position (text), genotype of tab rows of four fields or more; the last row of an rsid counts."""
    rows = _tab_rows(lines, 4).select("line_no", *[F.get("f", F.lit(k)).alias(c) for k, c in enumerate(("rsid", "chromosome", "position", "genotype"))])
    last = rows.groupBy("rsid").agg(F.max_by(F.struct("chromosome", "position", "genotype"), "line_no").alias("r"))
    return last.select("rsid", "r.*")


def vcf_columns(lines: DataFrame) -> DataFrame:
    """The columns of a VCF table (but level) from line and file_order; lines of fewer than eight fields are left out."""
    lines = lines.withColumn("f", F.split(F.regexp_replace("line", "\r$", ""), "\t", -1)).where(F.size("f") >= 8)
    field = lambda k: F.get("f", F.lit(k))
    listed = lambda c, mark: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, mark, -1))
    rs, end = F.regexp_extract(field(7), r"(?:^|;)RS=([0-9,]+)", 1), F.regexp_extract(field(7), r"(?:^|;)END=([0-9]+)", 1)
    pos = field(1).cast("bigint")
    stop = F.greatest(F.when(end != "", end.cast("bigint")).otherwise(pos - 1 + F.length(field(3))), pos)
    return lines.select(field(0).alias("contig"), pos.alias("pos"), field(2).alias("id"), field(3).alias("ref"), listed(field(4), ",").alias("alts"),
                        F.when(field(6) != ".", F.split(field(6), ";", -1)).alias("filters"),
                        F.when(rs != "", F.transform(F.split(rs, ",", -1), lambda x: x.cast("bigint"))).alias("info_rs"), stop.alias("stop"), "file_order")


def read_vcf_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of VCF text (plain or gzip), with the order of the file. stop is the end of the record's interval, from INFO/END where it has one."""
    from helixlake.sources.genotype_text import read_lines

    lines = read_lines(spark, paths).where(~F.col("value").startswith("#"))
    return vcf_columns(lines.select(F.col("value").alias("line"), F.col("line_no").alias("file_order")))


def is_blocked(path: str) -> bool:
    """Whether a file of a .gz or .bgz name is blocked gzip."""
    if not str(path).endswith((".gz", ".bgz")):
        return False
    with shared_files.opened(path) as f:
        return bgzf.block_size(f.read(64)) is not None


def read_vcf_blocks(spark: SparkSession, path: str, regions: list | None = None, split_bytes: int = bgzf.SPLIT_BYTES) -> DataFrame:
    """Records of a blocked gzip file; with regions (contig, start, stop) and an index, only what overlaps them is read."""
    return vcf_columns(bgzf.read_blocks(spark, path, regions, split_bytes))


def declared_contigs(header: list[str]) -> list[str]:
    """The contigs that header lines declare, in their order."""
    found = [re.match(r"##contig=<(?:[^>]*,)?ID=([^,>]+)", line) for line in header]
    return [m[1] for m in found if m]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The header lines of VCF text, plain, gzip or blocked gzip; of a text file its comment lines, wherever they stand."""
    if is_blocked(path):
        return bgzf.header_lines(path)
    # A header has a line for each contig, filter and field that is declared.
    return [r[0] for r in spark.read.text(path).where(F.col("value").startswith("##contig=")).collect()]


def is_converted(spark: SparkSession, path: str) -> bool:
    return any(n.startswith("contig=") for n in names(spark, path))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a converted table (a folder), or of VCF text, which is parsed once and kept converted in the shared folder."""
    if not is_converted(spark, path):
        converted = new_path(spark, "vcf")
        vcf_to_parquet(spark, [path], converted)
        path = converted
    return spark.read.schema(schemas.VCF_TABLE).parquet(path)


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """What is known of a converted table's contigs, one row each: number of records, longest one, least and largest position, whether the header declares it."""
    return spark.read.schema(schemas.VCF_CONTIGS).parquet(f"{str(path).rstrip('/')}.contigs")


def vcf_to_parquet(spark: SparkSession, paths: list[str], out: str) -> None:
    """One-off conversion: in folders by contig and level of bins, sorted by position, so that later lookups read only what they need; out.contigs beside it has the contigs.

    Levels tell long records from short ones: what reaches into a region begins in it, or before it by no more than the level's span. A folder that
    holds something else is not replaced.
    """
    if exists(spark, out) and names(spark, out) and not is_converted(spark, out):
        raise FileExistsError(f"{out} is no converted table")
    rows, header = None, []
    for path in paths:
        own = read_vcf_blocks(spark, path) if is_blocked(path) else read_vcf_text(spark, [path])
        header += header_of(spark, path)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("level", level_of(F.col("pos") - 1, F.col("stop")))
    order = ["contig", "level", "pos", "file_order"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("contig", "level").parquet(out)
    names_ = spark.createDataFrame([(c, True) for c in dict.fromkeys(declared_contigs(header))], "contig string, declared boolean")
    found = spark.read.schema(schemas.VCF_TABLE).parquet(out).groupBy("contig").agg(
        F.count(F.lit(1)).alias("records"), F.max(F.col("stop") - F.col("pos") + 1).alias("longest"), F.min("pos").alias("least"), F.max("pos").alias("most"))
    both = found.join(names_, "contig", "full_outer")
    both.select("contig", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), "longest", "least", "most", F.coalesce("declared", F.lit(False)).alias("declared")).coalesce(1).write.mode("overwrite").parquet(f"{str(out).rstrip('/')}.contigs")


def by_id(vcf: DataFrame, target: str) -> DataFrame:
    """Records whose ID column equals target as a whole."""
    return vcf.where(F.col("id") == target).select("contig", "pos", "id", "ref", "alts")


def overlay_variants(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """group, n (place in the group), rsid, chromosome, position, genotypes, reference, alternates; none given: no rows."""
    if path and text:
        raise ValueError("give the overlay as a file or as text, not both")
    if path:
        text = read_text(spark, path)
    raw = spark.createDataFrame([(text or "{}",)], "text string").select(F.from_json("text", schemas.OVERLAY, {"mode": "FAILFAST"}).alias("m"))
    groups = raw.select(F.explode("m").alias("group", "body"))
    return groups.select("group", F.posexplode("body.variants").alias("n", "v")).select("group", "n", "v.*")
