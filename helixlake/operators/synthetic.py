"""Synthetic genotype rows: references times files, with overlays in their place.

All randomness is a hash of seed, file and marker (helixlake.functions.draws), so rows are the same for any number of
partitions and each file differs from the others.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import draws
from helixlake.functions.templates import date_pattern, fill_template
from helixlake.functions.variants import split_alternates, synthesize_genotype


def check_arguments(template: str, count: int = 1, alt_frequency: float = 0.01, id_min: int = 100_000, id_max: int = 999_999, month_min: int = 1, month_max: int = 12, day_min: int = 1, day_max: int = 28) -> None:
    if not 0 <= alt_frequency <= 1:
        raise ValueError("the alternate frequency must lie between 0 and 1")
    if count < 1:
        raise ValueError("count must be at least 1")
    if count > 1 and not any(p in template for p in ("{id}", "{index}", "{date}", "{month}", "{day}")):
        raise ValueError("several files need a placeholder in the output template")
    if id_min > id_max:
        raise ValueError("the least id is above the largest")
    if not (1 <= month_min <= month_max <= 12 and 1 <= day_min <= day_max <= 31):
        raise ValueError("months must lie in 1-12 and days in 1-31, the least first")
    if "{id}" in template and count > id_max - id_min + 1:
        raise ValueError("there are fewer ids than files")


def file_plans(spark: SparkSession, template: str, count: int = 1, seed: int = 0, id_min: int = 100_000, id_max: int = 999_999, year: int = 2025,
               month_min: int = 1, month_max: int = 12, day_min: int = 1, day_max: int = 28, date_format: str = "%m-%d-%Y") -> DataFrame:
    """file_idx, id, month, day, path, seed of each file. Ids are distinct: a keyed permutation of the range. A day that a month lacks is an error."""
    files = spark.range(count).select(F.col("id").alias("file_idx"))
    none = F.lit("")
    pick = lambda low, high, stream: (F.lit(low) + draws.draw(seed, F.col("file_idx"), none, stream) % (high - low + 1)).cast("int")
    files = files.withColumn("month", pick(month_min, month_max, "month")).withColumn("day", pick(day_min, day_max, "day"))
    # Files beyond the range, which check_arguments refuses where ids are shown, have none.
    size = id_max - id_min + 1
    own = F.when(F.col("file_idx") < size, (F.lit(id_min) + draws.permuted(F.col("file_idx"), size, seed, "id")).cast("int"))
    plans = files.withColumn("id", own).withColumn("date", F.date_format(F.make_date(F.lit(year), "month", "day"), date_pattern(date_format)))
    path = fill_template(template, F.col("file_idx"), F.col("id"), F.col("date"), F.col("month"), F.col("day"), F.lit(year))
    return plans.select("file_idx", "id", "month", "day", path.alias("path"), (F.lit(seed) + F.col("file_idx")).alias("seed"))


def _drawn(h: Callable[[str], Column], alternates: Column, alt_frequency: float) -> tuple[Column, list[Column]]:
    """Genotype of a row with a reference, and gs, baf, lrr, from its draws."""
    pick = F.when(F.size(alternates) > 0, h("pick") % F.size(alternates)).otherwise(0)
    own = synthesize_genotype(F.col("reference"), alternates, draws.happens(h("alt"), alt_frequency), pick)
    return own, [draws.gs(h("gs")).alias("gs"), draws.baf(h("baf")).alias("baf"), draws.lrr(h("lrr")).alias("lrr")]


def synthetic_rows(references: DataFrame, files: DataFrame, overlays: DataFrame | None = None, alt_frequency: float = 0.01, seed: int = 0) -> DataFrame:
    """file_idx, leftover, rsid, chromosome, position, genotype, gs, baf, lrr (text) for every file and marker.

    files: file_idx. overlays: rsid, chromosome, position, options; an overlay replaces genotype, chromosome and position of its marker,
    or, where no reference has it, comes after the others (leftover). The product is what is asked for: every file holds every marker.
    """
    every = files.select("file_idx").crossJoin(references)
    h = lambda stream: draws.draw(seed, F.col("file_idx"), F.col("rsid"), stream)
    own, metrics = _drawn(h, split_alternates(F.col("alternates")), alt_frequency)
    if overlays is None:
        return every.select("file_idx", F.lit(False).alias("leftover"), "rsid", "chromosome", "position", own.alias("genotype"), *metrics)
    forced = overlays.select("rsid", F.col("chromosome").alias("_chromosome"), F.col("position").alias("_position"), "options")
    choice = F.get("options", (h("option") % F.size("options")).cast("int"))
    shown = every.join(forced, "rsid", "left")
    rows = shown.select("file_idx", F.lit(False).alias("leftover"), "rsid", F.coalesce("_chromosome", "chromosome").alias("chromosome"), F.coalesce("_position", "position").alias("position"),
                        F.when(F.col("options").isNotNull(), choice).otherwise(own).alias("genotype"), *metrics)
    left = files.select("file_idx").crossJoin(forced.join(references.select("rsid"), "rsid", "left_anti"))
    left = left.select("file_idx", F.lit(True).alias("leftover"), "rsid", F.col("_chromosome").alias("chromosome"), F.col("_position").alias("position"), choice.alias("genotype"), *metrics)
    return rows.unionByName(left)


def generated_rows(exact: DataFrame, files: DataFrame, alt_frequency: float = 0.01, seed: int = 0) -> DataFrame:
    """The older generator's rows: seq, rsid, chromosome, position (as the lookup has them), genotype, gs, baf, lrr for every exact row of a lookup; its place stands for the marker in the draws."""
    # Plans are few; rows are read once, and not again for each partition of the plans.
    every = exact.crossJoin(F.broadcast(files.select("file_idx")))
    own, metrics = _drawn(lambda stream: draws.draw(seed, F.col("file_idx"), F.col("seq"), stream), F.col("alternates"), alt_frequency)
    return every.select("file_idx", "seq", "rsid", "chromosome", "position", own.alias("genotype"), *metrics)


def file_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_idx").agg(F.count(F.lit(1)).alias("rows"))


def random_seed() -> int:
    """A seed for callers that give none."""
    return secrets.randbits(31)
