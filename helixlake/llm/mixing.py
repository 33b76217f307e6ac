"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations alone.

Sources share the tokens of the mix by weight; none gets more than max_repeats times what it has, and what it cannot
take is shared again by weight. Targets are cut into blocks of block_tokens tokens, which go to the sources, and then
within a source to its shards, by the highest quotients v / (2k + 1). A shard holds about rows_per_shard documents, so
a large source has many and no sort grows with it. Within a shard the documents stand in an order that a hash of seed,
id, text and the number among equal rows gives; the shard's blocks are cut along it, and its quota takes them from the front, going round again where
the quota exceeds what the shard has. Only the block at the end of a quota can take part of a document.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, ranked last; repeated rows are
separate documents; without any word every target is 0; an empty table gives no rows; of the input only id, text and
source are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import WORD_PATTERN, stored, table

WEIGHTS = (5, 2, 1)


def cyclic_weight(rank: Column, weights: tuple[int, ...]) -> Column:
    """The weight of the source of that rank, from 1; weights repeat."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """source, source_size, rows, target of each source.

    In the order of limit to weight, a source is stopped when the share per weight that is left for it and those after
    it exceeds its limit; those that are stopped come first, so running sums give the answer without iteration.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = by.withColumn("w", cyclic_weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())), weights))
    ranked = ranked.withColumn("limit", F.col("source_size") * max_repeats)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("total_w", F.sum("w").over(everything))
              .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(prior), F.lit(0)))
              .withColumn("left_w", F.col("total_w") - F.coalesce(F.sum("w").over(prior), F.lit(0)))
              .withColumn("stopped", F.col("left") * F.col("w") > F.col("limit") * F.col("left_w")))
    stopped = F.col("stopped")
    ranked = (ranked.withColumn("rest", F.col("total") - F.sum(F.when(stopped, F.col("limit")).otherwise(0)).over(everything))
              .withColumn("rest_w", F.col("total_w") - F.sum(F.when(stopped, F.col("w")).otherwise(0)).over(everything)))
    target = F.when(stopped, F.col("limit").cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / F.col("rest_w"))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def apportion(items: DataFrame, group: list[str], tie: list[str], value: str, seats: str, limit: str) -> DataFrame:
    """Add quota: the group's seats dealt to its items by the highest quotients value / (2k + 1), at most limit to an item.

    Rounding value * m gives the seats of the divisor method for the right m. For m = (seats - n/2) / sum it gives at
    most the seats, for (seats + n/2) / sum at least; only the quotients between are sorted, about 2 an item.
    """
    within = Window.partitionBy(*group)
    rows = (items.withColumn("_sum", F.sum(value).over(within)).withColumn("_n", F.count(F.lit(1)).over(within))
            .withColumn("_lo", F.when(F.col("_sum") > 0, F.floor(F.col(value) * F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2) / F.col("_sum") + 0.5)).otherwise(0))
            .withColumn("_lo", F.greatest(F.lit(0), F.least(F.col("_lo") - 1, F.col(limit))).cast("long"))
            .withColumn("_hi", F.when(F.col("_sum") > 0, F.ceil(F.col(value) * (F.col(seats) + F.col("_n") / 2) / F.col("_sum") + 1.5)).otherwise(0))
            .withColumn("_hi", F.least(F.col("_hi"), F.col(limit)).cast("long"))
            .withColumn("_free", F.col(seats) - F.sum("_lo").over(within)))
    seat = rows.where(F.col("_hi") > F.col("_lo")).withColumn("_k", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    highest = Window.partitionBy(*group).orderBy((F.col(value) / (2 * F.col("_k") + 1)).desc(), *[F.col(t).asc_nulls_last() for t in tie])
    won = seat.withColumn("_rank", F.row_number().over(highest)).where(F.col("_rank") <= F.col("_free"))
    # Quotients of an item fall with k, so its won seats follow each other: the last one gives its quota.
    last = won.groupBy(*[F.col(c).alias(f"_{c}") for c in [*group, *tie]]).agg((F.max("_k") + 1).alias("_quota"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, *tie]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = rows.join(last, on, "left").withColumn("quota", F.coalesce("_quota", "_lo"))
    return out.select(*items.columns, "quota")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, block_tokens: int = 16,
                rows_per_shard: int = 4096, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, shard, taken (tokens, repeats counted), and the columns in keep."""
    keep = keep or []
    rows = docs.select("doc_id", "source", *keep, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    # Equal rows are counted and numbered, so that many of them, or many rows without an id, do not stand at one place of the order.
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    place = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content", F.col("copy").cast("string"))
    rows = stored(same.withColumn("order", F.md5(place)).drop("content", "copies", "copy"), "mix-rows")
    targets = source_targets(rows, weights, max_repeats)
    sources = (targets.withColumn("one", F.lit(1)).withColumn("blocks", F.floor(F.sum("source_size").over(Window.partitionBy()) / block_tokens + 0.5))
               .withColumn("limit", F.ceil(F.col("source_size") * max_repeats / block_tokens)))
    sources = apportion(sources, ["one"], ["source"], "target", "blocks", "limit").withColumnRenamed("quota", "source_blocks")
    sources = stored(sources.select(F.col("source").alias("_source"), "source_size", "target", "source_blocks", F.ceil(F.col("rows") / rows_per_shard).alias("shards")), "mix-sources")

    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("shards")).cast("int"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_blocks").alias("source_blocks"))
    cells = cells.withColumn("limit", F.ceil(F.col("cell_size") * max_repeats / block_tokens))
    cells = apportion(cells, ["source"], ["shard"], "cell_size", "source_blocks", "limit")
    cells = cells.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size",
                         F.least(F.col("quota") * block_tokens, F.col("cell_size") * max_repeats).cast("long").alias("take"))

    seeded = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    rounds = F.when(F.col("cell_size") > 0, F.floor(F.col("take") / F.col("cell_size"))).otherwise(0)
    rest = F.col("take") - rounds * F.col("cell_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "shard", *keep, taken.cast("long").alias("taken"))


def op5_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, source, text)) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS lim, sum(source_size) OVER () AS total, sum(w) OVER () AS total_w, row_number() OVER (ORDER BY source_size * 3.0 / w, source NULLS LAST) AS r FROM s),
p AS (SELECT *, CAST(total - coalesce(sum(lim) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * w > lim * CAST(total_w - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stopped FROM c),
t AS (SELECT *, CASE WHEN stopped THEN CAST(lim AS DOUBLE) ELSE CAST(w * (total - coalesce(sum(lim) FILTER (WHERE stopped) OVER (), 0)) AS DOUBLE) / CAST(total_w - coalesce(sum(w) FILTER (WHERE stopped) OVER (), 0) AS DOUBLE) END AS target,
  CAST(floor(CAST(total AS DOUBLE) / 16 + 0.5) AS BIGINT) AS blocks FROM p),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS rank, blocks FROM t, LATERAL (SELECT unnest(range(0, CAST(least(ceil(lim / 16.0), blocks) AS BIGINT))) AS k) AS u WHERE target > 0),
sb AS (SELECT t.source, source_size, target, ceil(n / 4096.0) AS shards, (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM t.source AND rank <= q.blocks) AS source_blocks FROM t),
e AS (SELECT d.*, sb.source_size, sb.target, sb.source_blocks, CAST('0x' || substr(o, 1, 8) AS BIGINT) % CAST(shards AS BIGINT) AS shard FROM d JOIN sb ON d.source IS NOT DISTINCT FROM sb.source),
ce AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell, any_value(source_blocks) AS b FROM e GROUP BY source, shard),
cq AS (SELECT source, shard, b, row_number() OVER (PARTITION BY source ORDER BY CAST(cell AS DOUBLE) / (2 * k + 1) DESC, shard) AS rank FROM ce, LATERAL (SELECT unnest(range(0, CAST(least(ceil(cell * 3 / 16.0), b) AS BIGINT))) AS k) AS u),
ct AS (SELECT source, shard, cell, least((SELECT count(*) FROM cq WHERE cq.source IS NOT DISTINCT FROM ce.source AND cq.shard = ce.shard AND rank <= cq.b) * 16, cell * 3) AS take FROM ce)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN cell = 0 THEN 0 ELSE take // cell * size + greatest(0, least(size, take % cell
  - coalesce(sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY o, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS BIGINT) AS taken
FROM e JOIN ct ON e.source IS NOT DISTINCT FROM ct.source AND e.shard = ct.shard
"""
