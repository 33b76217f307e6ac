"""Genotype text files: delimiter and header per file by aggregation, then every line by itself.

A file's lines are read in parallel: once to count each split's, once for the rows. What a line needs to know of its file (delimiter, header) is one small row a file,
from two grouped aggregations over the files' first lines, which tasks read from the files' beginnings alone; it is stored, and broadcast while there are no more than BROADCAST_FILES
files. So the rows themselves take no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake import shared_files
from helixlake.functions.text import WHITE_SPACE, normalize_name, parse_long, split_fields, strip_comment_prefix, strip_inline_comment, trim
from helixlake.sources.files import metadata_name, visible
from helixlake.storage import stored

LOOK_AHEAD, BROADCAST_FILES = 2048, 100_000
#: Normalised header names of each column, in the order in which they are tried.
ALIASES = {
    "rsid": ["id", "marker", "name", "rsid", "snp"],
    "chromosome": ["chr", "chrom", "chromosome"],
    "position": ["basepair", "basepairposition", "coordinate", "pos", "position"],
    "genotype": ["call", "calls", "code", "genotype", "genotypevalue", "gt", "result", "result1", "results", "variation", "yourcode"],
    "allele1": ["allele1", "allele1top", "allelea"],
    "allele2": ["allele2", "allele2top", "alleleb"],
}
DEFAULT_HEADER = ["rsid", "chromosome", "position", "genotype"]


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, line_no (from 0), value. Splits of a file are numbered apart, so a large file stays in many tasks, and in built-in functions.

    A line's number is its split's offset, from the splits' counts, and its distance from the split's first line: lines of a split follow each other
    within a partition, where monotonic ids rise by one.
    """
    # The same splits in both scans, also where executors come and go.
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    rows = spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # A split is a partition's worth of lines, or a whole file.
    if 2 * rows.rdd.getNumPartitions() + len(paths) <= BROADCAST_FILES:
        blocks = F.broadcast(blocks)
    return rows.join(blocks, ["file_path", "block"]).select("file_path", (F.col("id") + F.col("shift")).alias("line_no"), "value")


def read_heads(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first lines of each file, as read_lines gives them, and no further than delimiter and header need: up to a data line that shows
    the delimiter, at least LOOK_AHEAD lines where none does, and to the first data line in any case. None where only Spark reaches the files."""
    if not all(map(shared_files.reachable, paths[:1])):
        return None
    named = spark.createDataFrame([(metadata_name(spark, p), p) for p in paths], "file_path string, at string")
    named = named.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    return named.mapInArrow(_heads, "file_path string, line_no long, value string")


def _heads(batches):
    for batch in batches:
        for name, at in zip(batch.column("file_path").to_pylist(), batch.column("at").to_pylist()):
            held, first = [], 0
            for n, line in enumerate(shared_files.lines_of(at)):
                held.append(line)
                bare = line.strip(WHITE_SPACE)
                data = bare != "" and not bare.startswith(("#", "//"))
                shown = data and ("\t" in line or "," in line or any(c in WHITE_SPACE for c in bare))
                met = data or (n > 0 and met)
                done = shown or (met and n + 1 >= LOOK_AHEAD)
                if done or len(held) == LOOK_AHEAD:
                    yield _head_batch(name, first, held)
                    held, first = [], n + 1
                if done:
                    break
            if held:
                yield _head_batch(name, first, held)


def _head_batch(name: str, first: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines)], names=["file_path", "line_no", "value"])


def _broadcast_files(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_FILES else rows


def _looks_like_header(fields: Column) -> Column:
    return F.coalesce(normalize_name(F.get(fields, F.lit(0))).isin(ALIASES["rsid"]), F.lit(False))


def file_profiles(lines: DataFrame) -> DataFrame:
    """One row a file: delimiter (T, C, S), first_data (line number), header (normalised names), has_header.

    lines: file_path, line_no, t (trimmed), kind (blank, comment, data), value.
    """
    data = F.col("kind") == "data"
    hint = F.when(F.col("value").contains("\t"), "T").when(F.col("value").contains(","), "C").when(F.col("t").rlike(r"(?U)\s"), "S")
    ahead = data & (F.col("line_no") < LOOK_AHEAD) & hint.isNotNull()
    first = lines.groupBy("file_path").agg(
        F.coalesce(F.min_by(F.when(ahead, hint), F.when(ahead, F.col("line_no"))), F.lit("T")).alias("delimiter"), F.min(F.when(data, F.col("line_no"))).alias("first_data"))
    first = _broadcast_files(stored(first, "file-starts"))
    near = lines.join(first, "file_path").where((F.col("line_no") == F.col("first_data")) | ((F.col("kind") == "comment") & (F.col("line_no") < F.col("first_data"))))
    source = F.when(F.col("kind") == "data", F.col("value")).otherwise(strip_comment_prefix(F.col("t")))
    near = near.withColumn("fields", split_fields(source, F.col("delimiter")))
    comment = (F.col("kind") == "comment") & _looks_like_header(F.col("fields"))
    heads = near.groupBy("file_path").agg(
        F.max(F.when(F.col("kind") == "data", F.col("fields"))).alias("first_fields"), F.max_by(F.when(comment, F.col("fields")), F.when(comment, F.col("line_no"))).alias("comment_fields"))
    has = _looks_like_header(F.col("first_fields"))
    default = F.slice(F.array(*map(F.lit, DEFAULT_HEADER)), 1, F.size("first_fields"))
    header = F.when(has, F.col("first_fields")).when(F.col("comment_fields").isNotNull(), F.col("comment_fields")).otherwise(default)
    return first.join(heads, "file_path", "left").select("file_path", "delimiter", "first_data", F.transform(header, normalize_name).alias("header"), has.alias("has_header"))


def _lookup(fields: Column, places: Column) -> Column:
    """The first alias with a value; an alias that names several columns means the last of them that the line has."""
    values = F.transform(places, lambda at: F.get(fields, F.array_max(F.filter(at, lambda p: p < F.size(fields)))))
    several = F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))
    # As a rule one alias names one column.
    first = F.get(places, F.lit(0))
    return F.when(F.size(places) == 0, None).when((F.size(places) == 1) & (F.size(first) == 1), F.nullif(F.get(fields, F.get(first, F.lit(0))), F.lit(""))).otherwise(several)


def _marked(lines: DataFrame) -> DataFrame:
    t = trim(F.col("value"))
    kind = F.when(t == "", "blank").when(t.startswith("#") | t.startswith("//"), "comment").otherwise("data")
    return lines.select("file_path", "line_no", "value", t.alias("t"), kind.alias("kind"))


def parse_lines(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """From file_path, line_no, value: one row a data line, with outcome parsed or skipped; blank, comment and header lines give none.

    heads: the lines that show each file's delimiter and header, as read_heads has them; without them all lines are searched for these.
    """
    profile = file_profiles(_marked(lines if heads is None else heads))
    lines = _marked(lines).drop("t")
    where = lambda name: F.filter(F.sequence(F.lit(0), F.size("header") - 1), lambda i: F.get(F.col("header"), i) == name)
    for column, aliases in ALIASES.items():
        # An alias that names no column has no value in any line.
        profile = profile.withColumn(f"at_{column}", F.when(F.size("header") > 0, F.filter(F.array(*[where(a) for a in aliases]), lambda at: F.size(at) > 0)))
    profile = _broadcast_files(stored(profile, "file-columns"))
    rows = lines.where("kind = 'data'").join(profile, "file_path").where(~(F.col("has_header") & (F.col("line_no") == F.col("first_data"))))
    fields = F.transform(split_fields(F.col("value"), F.col("delimiter"), trimmed=False), strip_inline_comment)
    # The one element of the array binds the fields, which are made once a line, to f.
    row = F.transform(F.array(fields), lambda f: F.struct(*[_lookup(f, F.col(f"at_{c}")).alias(c) for c in ALIASES]))
    rows = rows.select("file_path", "line_no", F.inline(row)).withColumn("position", parse_long(F.col("position")))
    called = F.col("genotype").isNotNull() | F.col("allele1").isNotNull() | F.col("allele2").isNotNull()
    ok = F.col("rsid").isNotNull() & F.col("chromosome").isNotNull() & F.col("position").isNotNull() & called
    return rows.select("file_path", "line_no", *ALIASES, F.when(ok, "parsed").otherwise("skipped").alias("outcome"))


def file_stats(rows: DataFrame) -> DataFrame:
    """variant_count and skipped_rows of each file."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return rows.groupBy("file_path").agg(count("parsed").alias("variant_count"), count("skipped").alias("skipped_rows"))


def read_genotypes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parsed rows of the files; of those whose names Spark hides copies in the shared folder are read."""
    shown = visible(spark, paths)
    lines, heads = read_lines(spark, list(shown.values())), read_heads(spark, list(shown.values()))
    renamed = [(metadata_name(spark, to), metadata_name(spark, p)) for p, to in shown.items() if to != p]
    if renamed:
        names = spark.createDataFrame(renamed, "file_path string, _given string")
        given = lambda rows: rows.join(names, "file_path", "left").select(F.coalesce("_given", "file_path").alias("file_path"), "line_no", "value")
        lines, heads = given(lines), None if heads is None else given(heads)
    return parse_lines(lines, heads)
