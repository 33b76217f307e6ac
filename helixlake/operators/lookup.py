"""Markers against VCF records: by identifier, within an interval around the position.

A record answers a query only if it bears the query's identifier, so identifiers are exploded and joined by equality
with the contig; the interval is a filter on what meets. No interval join is needed, and identifiers do not repeat much, so neither
does a key. What is found depends on contig, identifier and position alone: each such key is looked up once, and joined back by its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions.bins import LEVELS, WINDOW_BITS, level_span
from helixlake.functions.contigs import contig_of
from helixlake.functions.text import trim


def record_ids(vcf: DataFrame) -> DataFrame:
    """A row for each record and each of its distinct identifiers: those of the ID column, and rs numbers of INFO."""
    named = F.filter(F.transform(F.split(F.coalesce("id", F.lit("")), ";", -1), trim), lambda x: (x != "") & (x != "."))
    numbered = F.transform(F.coalesce("info_rs", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("rs"), x.cast("string")))
    return vcf.withColumn("record_id", F.explode(F.array_distinct(F.concat(named, numbered))))


def find_records(queries: DataFrame, vcf: DataFrame, window: int = 0, before: int | None = None, after: int | None = None,
                 known: DataFrame | None = None) -> DataFrame:
    """queries (rsid, chromosome, position, and others) with contig, record and status, which replace columns of these names.

    status: no_contig (unknown chromosome), missing_contig (none of the records has it), exact (the first record with the
    identifier that overlaps the position), window (else, the first that overlaps the position widened by window), not_found.
    before and after, where given, widen the second interval unevenly: from position - before to before position + after.
    known: the contigs (column contig) that exist, where vcf is but a part of them: those that the header declares and those of all records.
    A record reaches from pos to its column stop, where vcf has one, else as far as ref is long.
    A query without identifier or position finds nothing; queries that come twice are answered twice.
    """
    queries = queries.drop("contig", "record", "status")
    asked = queries.withColumn("contig", contig_of(F.col("chromosome")))
    stop = F.col("stop") if "stop" in vcf.columns else F.col("pos") - 1 + F.length("ref")
    ids = record_ids(vcf).select(F.col("contig").alias("_contig"), "record_id", "file_order", (F.col("pos") - 1).alias("_start"), stop.alias("_stop"), F.struct("contig", "pos", "ref", "alts", "filters").alias("record"))
    keys = asked.select(*[F.col(c).alias(f"_{c}") for c in ("contig", "rsid", "position")]).distinct().withColumnRenamed("_contig", "_on")
    met = keys.join(ids, (F.col("_on") == F.col("_contig")) & (F.col("_rsid") == F.col("record_id")))

    def overlaps(low, high):
        return (F.greatest(F.lit(0), low) < high) & (F.col("_start") < high) & (F.col("_stop") > F.greatest(F.lit(0), low))

    at = F.col("_position")
    exact = overlaps(at - 1, at)
    near = overlaps(at - before, at + after) if before is not None else overlaps(at - 1 - window, at + window)
    wide = window > 0 or before is not None
    hits = met.withColumn("rank", F.when(exact, 0).when(near if wide else F.lit(False), 1)).where("rank is not null")
    first = hits.groupBy("_on", "_rsid", "_position").agg(F.min(F.struct("rank", "_start", "file_order", "record")).alias("_hit"))
    known = (vcf if known is None else known).select(F.col("contig").alias("_known")).distinct()
    same = (F.col("contig") == F.col("_on")) & (F.col("rsid") == F.col("_rsid")) & (F.col("position") == F.col("_position"))
    out = asked.join(first, same, "left").join(known, F.col("contig") == F.col("_known"), "left")
    status = (F.when(F.col("contig").isNull(), "no_contig").when(F.col("_known").isNull(), "missing_contig").when(F.col("_hit").isNull(), "not_found")
              .when(F.col("_hit.rank") == 0, "exact").otherwise("window"))
    return out.select(*queries.columns, "contig", F.col("_hit.record").alias("record"), status.alias("status"))


#: More runs of windows than this are taken together by contig in the condition that prunes a table.
CONDITION_RUNS = 200


def wanted_regions(queries: DataFrame, window: int = 0, before: int | None = None, after: int | None = None) -> list[tuple[str, int, int]]:
    """Where records can answer the queries, as half-open intervals (contig, start, stop): runs of windows of 2^14 positions, so that the genome bounds their number."""
    low, high = (window + 1, window) if before is None else (max(before, 1), max(after, 0))
    at = queries.select(contig_of(F.col("chromosome")).alias("contig"), F.greatest(F.col("position") - low, F.lit(0)).alias("a"), (F.col("position") + high).alias("b")).where("contig is not null and b > a")
    cells = at.select("contig", F.explode(F.sequence(F.shiftright("a", WINDOW_BITS), F.shiftright(F.col("b") - 1, WINDOW_BITS))).alias("w")).distinct()
    # Neighbouring windows have the same difference to their number.
    runs = cells.withColumn("run", F.col("w") - F.row_number().over(Window.partitionBy("contig").orderBy("w"))).groupBy("contig", "run").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    return sorted((r["contig"], r["a"] << WINDOW_BITS, (r["b"] + 1) << WINDOW_BITS) for r in runs.collect())


def prune_records(vcf: DataFrame, queries: DataFrame, window: int = 0, before: int | None = None, after: int | None = None) -> DataFrame:
    """Records that can answer the queries, by conditions on contig, level and position, by which a converted table is read.

    Each level of bins has a bound of its own below: short records begin at most 2^14 positions before a region, and only the few
    long ones are looked for farther away. A table without levels is pruned by pos and stop.
    """
    runs = wanted_regions(queries, window, before, after)
    spans: dict[str, tuple[int, int]] = {}
    for contig, a, b in runs:
        spans[contig] = (min(a, spans.get(contig, (a, b))[0]), max(b, spans.get(contig, (a, b))[1]))
    if len(runs) > CONDITION_RUNS:
        runs = [(c, a, b) for c, (a, b) in spans.items()]
    pos, out = F.col("pos"), F.lit(False)
    if "level" not in vcf.columns:
        stop = F.col("stop") if "stop" in vcf.columns else F.col("pos") - 1 + F.length("ref")
        for contig, a, b in runs:
            out = out | ((F.col("contig") == contig) & (pos <= b) & (stop > a))
        return vcf.where(out)
    near = len(LEVELS) - 1
    for contig, a, b in runs:
        out = out | ((F.col("contig") == contig) & (F.col("level") == near) & (pos > a - level_span(near)) & (pos <= b))
    for contig, (a, b) in spans.items():
        for level in range(near):
            out = out | ((F.col("contig") == contig) & (F.col("level") == level) & (pos > a - level_span(level)) & (pos <= b))
    return vcf.where(out)


def lookup_rows(found: DataFrame, *more: str) -> DataFrame:
    """The columns of a lookup table, all text, blank where nothing was found; and the columns named in more."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    filters = F.when(F.col("record").isNotNull(), F.coalesce(F.array_join("record.filters", ";"), F.lit("PASS")))
    return found.select(F.col("rsid").alias("query_rsid"), F.col("chromosome").alias("query_chrom"), F.col("position").cast("string").alias("query_pos"), blank(F.col("record.contig")).alias("ref_contig"),
                        blank(F.col("record.pos").cast("string")).alias("ref_pos"), blank(F.col("record.ref")).alias("ref"), blank(F.array_join("record.alts", ",")).alias("alt"), blank(filters).alias("filters"), "status", *more)


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
