"""Overlay variants: forced genotypes for chosen markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions.text import parse_rsid, trim
from helixlake.functions.variants import genotype_combinations


#: What can be wrong with a variant.
BAD_RSID, NO_GENOTYPES, NOTHING_GIVEN, TWICE = "no valid rsid: ", "no genotypes given for ", "neither genotypes nor a reference for ", "given more than once: "


def _problem() -> Column:
    """What is wrong with a variant by itself, with its rsid; else null."""
    name = F.coalesce("rsid", F.lit("?"))
    return (F.when(parse_rsid(trim(F.col("rsid"))).isNull(), F.concat(F.lit(BAD_RSID), name))
            .when(F.col("genotypes").isNotNull() & (F.size("genotypes") == 0), F.concat(F.lit(NO_GENOTYPES), name))
            .when(F.col("genotypes").isNull() & F.col("reference").isNull(), F.concat(F.lit(NOTHING_GIVEN), name)))


def overlay_problems(variants: DataFrame) -> DataFrame:
    """group, n and problem of each variant that checked_specs would refuse."""
    rsid = parse_rsid(trim(F.col("rsid")))
    named = variants.withColumn("number", rsid)
    twice = named.where("number is not null").groupBy("number").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    met = named.join(twice, "number", "left")
    own = F.coalesce(_problem(), F.when(F.col("times") > 1, F.concat(F.lit(TWICE), "rsid")))
    return met.select("group", "n", own.alias("problem")).where("problem is not null")


def overlay_specs(variants: DataFrame) -> DataFrame:
    """group, n, rsid (number), chromosome, position, options: the genotypes given, else all combinations of the alleles.

    A bad rsid, an empty list of genotypes, or neither genotypes nor a reference ends the query with an error.
    """
    alternates = F.coalesce("alternates", F.array("reference"))
    wrong = _problem()
    options = (F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<string>")).when(F.col("genotypes").isNotNull(), F.col("genotypes"))
               .otherwise(genotype_combinations(F.col("reference"), alternates)))
    rsid = F.coalesce(parse_rsid(trim(F.col("rsid"))), F.raise_error(wrong).cast("bigint"))
    return variants.select("group", "n", rsid.alias("rsid"), "chromosome", "position", options.alias("options"))


def checked_specs(variants: DataFrame) -> DataFrame:
    """As overlay_specs; an rsid that comes twice is an error."""
    specs = overlay_specs(variants)
    twice = specs.groupBy("rsid").count().where("count > 1").orderBy("rsid").limit(1).collect()
    if twice:
        raise ValueError(f"overlay has rs{twice[0]['rsid']} more than once")
    return specs
