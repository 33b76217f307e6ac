"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group and stay together. All groups, largest first, go one by one to the least-loaded shard
through a heap. Groups of one size cannot be told apart by it, so the driver schedules sizes with their numbers of groups: sizes
that differ add up to no more than the total, so there are at most sqrt(2 * total) of them. Where many groups have one size, all that
surely fill the shards up to one level are given at once, and the heap decides on the rest: the shards get what single steps would give them. Which
group of a size goes where follows from its number among them. Rows and groups never pass through the driver.

Defined results: a null text is the empty text; repeated rows are rows of one group; an empty table gives no rows;
of the input only the columns id_col and text_col are read, so extra columns cannot clash. A group larger than a
shard's share fills its shard alone, which no rule can even out.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import broadcast_if_small, stored, table


def lpt(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """From (size, number of groups): for each size, largest first, how many of its groups each shard gets; ties go to the smaller shard."""
    loads, out = [0] * shards, []
    for size, n in sorted(sizes, reverse=True):
        got = [0] * shards
        if n > 2 * shards:
            # Below this level no shard stays behind: what is under it for certain is given at once.
            low = sorted(loads)
            for k in range(shards, 0, -1):
                level = (sum(low[:k]) + n * size) // k - size
                if level >= low[k - 1]:
                    break
            got = [max(0, (level - load) // size) for load in loads]
            loads = [load + g * size for load, g in zip(loads, got)]
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, s = heap[0]
            got[s] += 1
            loads[s] = load + size
            heapq.heapreplace(heap, (loads[s], s))
        out.append((size, got))
    return out


def numbered(rows: DataFrame, group: list[str], order: list[Column], run: int, name: str) -> DataFrame:
    """rows with their number (from 0) in their group, as column name. Groups are cut into runs of about run rows by a hash of order, so that no task sorts a large one."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / run).alias("_runs"))
    dealt = rows.join(broadcast_if_small(stored(sizes, "shard-groups")), group).withColumn("_run", F.pmod(F.xxhash64(*order), F.col("_runs")))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_run").orderBy(*[c.asc_nulls_last() for c in order])
    out = dealt.withColumn("_k", F.row_number().over(within)).join(broadcast_if_small(stored(offsets, "shard-runs")), [*group, "_run"])
    return out.withColumn(name, (F.col("_offset") + F.col("_k") - 1).cast("long")).drop("_runs", "_run", "_offset", "_k")


def shard_by_size(docs: DataFrame, shards: int = 16, rows_per_run: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_group")), "shard-rows")

    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "shard-texts")
    sizes = groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most sqrt(2 * total) rows
    plan = lpt(list(zip(sizes.column("_bytes").to_pylist(), sizes.column("n").to_pylist())), shards)
    upto = []
    for _, got in plan:
        sums, total = [], 0
        for g in got:
            total += g
            sums.append(total)
        upto.append(sums)
    dealt = spark.createDataFrame(pa.table({"_bytes": pa.array([s for s, _ in plan], pa.int64()), "_upto": pa.array(upto, pa.list_(pa.int64()))}), "_bytes long, _upto array<long>")
    ranked = numbered(groups, ["_bytes"], [F.col("_group")], rows_per_run, "_number")
    shard = F.size(F.filter("_upto", lambda n: n <= F.col("_number"))).cast("int")
    of_group = stored(ranked.join(broadcast_if_small(dealt), "_bytes").select("_group", "_rows", shard.alias("shard")), "shard-plan")

    # The rows of a group of copies are spread over many tasks: its shard comes to them. 
    often = of_group.where(F.col("_rows") > rows_per_run // 16).select("_group", F.col("shard").alias("_own"))
    marked = rows.join(broadcast_if_small(often), "_group", "left")
    few = marked.where("_own is null").drop("_own").join(of_group.select("_group", "shard"), "_group")
    placed = few.unionByName(marked.where("_own is not null").withColumnRenamed("_own", "shard"))
    out = numbered(stored(placed, "shard-placed"), ["shard"], [F.col(id_col), F.col("_group")], rows_per_run, "slot")
    return out.select(id_col, "size", "text_crc32", "shard", "slot")


def op2_lpt_sharding(spark, sf_dir):
    return shard_by_size(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
