"""Counts over formats, references and parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_counts(formats: DataFrame, references: DataFrame) -> DataFrame:
    """value, count: references of each format, 0 for those without, most first. References are counted before the join."""
    counts = references.groupBy("format_id").agg(F.count(F.lit(1)).alias("n"))
    joined = formats.join(counts, formats["id"] == counts["format_id"], "left")
    return joined.select(F.col("name").alias("value"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"), "id").orderBy(F.desc("count"), "id").drop("id")


def build_counts(formats: DataFrame) -> DataFrame:
    """value, count: formats of each genome build, null among them, most first."""
    return formats.groupBy(F.col("genome_build").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


def coverage_rows(formats: DataFrame, references: DataFrame) -> DataFrame:
    """format, rsid, count (1) of every reference whose format is known, by name and number."""
    rows = references.select("rsid", "format_id").join(formats.select("id", F.col("name").alias("format")), F.col("format_id") == F.col("id"))
    return rows.select("format", "rsid", F.lit(1).alias("count")).orderBy("format", "rsid")


def coverage_summary(references: DataFrame) -> DataFrame:
    return references.agg(F.count_distinct("format_id").alias("unique_formats"), F.count(F.lit(1)).alias("unique_rsids"), F.count(F.lit(1)).alias("total_rows"))


def summary(formats: DataFrame, references: DataFrame, store_path: str = "", stats: DataFrame | None = None) -> DataFrame:
    """One row: files_processed, total_variants, unique_rsids, skipped_rows, formats_seen, builds_seen, store_path.

    With stats (per-file counts) files and rows are those parsed; without, they are 0 and variants are counted in the references.
    """
    listed = lambda df, names: df.agg(F.coalesce(F.collect_list(F.struct("value", "count")), F.array()).alias(names))
    # Both lists have a row for each format at most.
    formats_seen = listed(format_counts(formats, references), "formats_seen").select(F.expr("array_sort(formats_seen, (a, b) -> CASE WHEN a.count > b.count THEN -1 WHEN a.count < b.count THEN 1 ELSE 0 END)").alias("formats_seen"))
    builds_seen = listed(build_counts(formats), "builds_seen")
    total = references.agg(F.count(F.lit(1)).alias("unique_rsids"))
    if stats is None:
        by_format = format_counts(formats, references).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_variants"))
        files = by_format.select(F.lit(0).cast("bigint").alias("files_processed"), "total_variants", F.lit(0).cast("bigint").alias("skipped_rows"))
    else:
        files = stats.agg(F.count(F.lit(1)).alias("files_processed"), F.coalesce(F.sum("variant_count"), F.lit(0)).alias("total_variants"), F.coalesce(F.sum("skipped_rows"), F.lit(0)).alias("skipped_rows"))
    one = files.crossJoin(total).crossJoin(formats_seen).crossJoin(builds_seen)  # one row each
    return one.select("files_processed", "total_variants", "unique_rsids", "skipped_rows", "formats_seen", "builds_seen", F.lit(store_path).alias("store_path"))
