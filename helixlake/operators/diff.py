"""Differences between two sets of genotypes, by rsid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FIELDS = ["chromosome", "position", "genotype"]


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """rsid, baseline, candidate (structs), change: missing, added, changed or same. Both sides have one row an rsid."""
    side = lambda df, name: df.select("rsid", F.struct(*FIELDS).alias(name))
    both = side(baseline, "baseline").join(side(candidate, "candidate"), "rsid", "full_outer")
    change = (F.when(F.col("candidate").isNull(), "missing").when(F.col("baseline").isNull(), "added")
              .when(F.col("baseline").eqNullSafe(F.col("candidate")), "same").otherwise("changed"))
    return both.withColumn("change", change)


def diff_summary(compared: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return compared.agg(n("missing", "changed", "same").alias("baseline_rows"), n("added", "changed", "same").alias("candidate_rows"),
                        n("missing").alias("missing"), n("added").alias("added"), n("changed").alias("differences"))


def first_changes(compared: DataFrame, change: str, limit: int = 20) -> DataFrame:
    """The first rsids, as text, with that change."""
    return compared.where(F.col("change") == change).orderBy("rsid").limit(limit)


def diff_line() -> Column:
    part = lambda side: F.concat(F.col(f"{side}.chromosome"), F.lit(":"), F.col(f"{side}.position"), F.lit(" "), F.col(f"{side}.genotype"))
    return F.concat(F.lit("- "), F.col("rsid"), F.lit(": baseline "), part("baseline"), F.lit(" vs candidate "), part("candidate"))
