"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import remove, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then v is the component of u."""
    one = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    centres = edges.select(F.col("v").alias("centre")).distinct()
    return one.join(centres, F.col("u") == F.col("centre"), "left").where("n > 1 or centre is not null").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of any direction: node, component, the smallest node it is linked with; nodes with edges only.

    Every step is a grouped minimum and a join on the same key, whose large groups adaptive execution may split; the
    number of steps grows with the logarithm of the longest path. Each step's edges are stored, none come to the driver;
    those of the step before are deleted.
    """
    spark = edges.sparkSession
    e, at = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large, next_ = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        remove(spark, at)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, at = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, next_)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
