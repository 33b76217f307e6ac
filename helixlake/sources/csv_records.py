"""Records of CSV text whose quoted values may hold line breaks, in as many tasks as the file has splits.

Whether a line begins within quotes is known from all text before it. A first pass gives for each split where it ends when it begins outside quotes, and where when
it begins within; composed over the splits of a file these give each split's true beginning. A second pass puts the lines of each split together
to records; the pieces of a record that reaches over splits, two a split at most, are joined afterwards.

Where every line of the file is a record by itself, quoted values and all, no split begins within quotes: built-in functions see that
in one pass, and give the lines as records.

A quote opens only where a field begins; a doubled one within quotes is a quote; elsewhere quotes are text, as Spark's CSV reader has it.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A record that ends with its line; what is left of a quoted value, and of the field behind its closing quote.
_FIELD = r'(?:[ \t]*"(?:[^"]|"")*"(?!")[^,]*|(?![ \t]*")[^,]*)'
_WHOLE = re.compile(f"{_FIELD}(?:,{_FIELD})*\\Z", re.S)
#: The same as _WHOLE for built-in functions, without steps back, which would change nothing: a long line takes no deep stack.
_SPARK_FIELD = r'(?:[ \t]*+"(?:[^"]++|"")*+"(?!")[^,]*+|(?![ \t]*")[^,]*+)'
_SPARK_WHOLE = rf"\A{_SPARK_FIELD}(?:,{_SPARK_FIELD})*+\z"
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(?:,|\Z)', re.S)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open behind a line."""
    if '"' not in line:
        return inside
    if inside:
        close = _CLOSE.match(line)
        if not close:
            return True
        if close[0][-1] != ",":
            return False
        line = line[close.end() :]
    return not _WHOLE.match(line)


def _splits(batch: pa.RecordBatch):
    for name, block, line, value in zip(*(batch.column(c).to_pylist() for c in ("file_path", "block", "id", "value"))):
        yield (name, block), line, value


def _states(batches):
    """A row for each split: its first id, its lines, and where it ends from outside and from within quotes."""
    at, ends, first, n, out = None, [False, True], 0, 0, []
    for batch in batches:
        for split, number, value in _splits(batch):
            if split != at:
                out += [(*at, first, n, *ends)] if at else []
                at, ends, first, n = split, [False, True], number, 0
            ends = [ends_inside(value, e) for e in ends]
            n += 1
    out += [(*at, first, n, *ends)] if at else []
    columns = list(zip(*out)) or [[]] * 6
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_path", "block", "start", "n", "outside", "inside"])


def _records(begins: dict[tuple[str, int], tuple[bool, int]]):
    """Records and pieces of them: seq (number of the first line), begun (holds a record's beginning), done (holds its end); first: the file's first record begins here.

    begins: for each split whether it begins within quotes, and what makes line numbers of its ids.
    """
    schema = pa.schema([("file_path", pa.string()), ("seq", pa.int64()), ("begun", pa.bool_()), ("done", pa.bool_()), ("first", pa.bool_()), ("record", pa.string())])

    def run(batches):
        at, inside, shift, held, line, begun, first, out = None, False, 0, [], 0, True, False, []

        def piece(done: bool):
            out.append((at[0], line, begun, done, first and begun, "\n".join(held)))

        for batch in batches:
            for split, number, value in _splits(batch):
                if split != at:
                    if held:
                        piece(False)
                    at, (inside, shift), held, first = split, begins[split], [], split[1] == 0
                    begun = not inside
                if not held:
                    line = number + shift
                held.append(value)
                inside = ends_inside(value, inside)
                if not inside:
                    piece(True)
                    held, begun, first = [], True, False
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if held:
            piece(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _records_and_head(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """What read_records gives, and the first record where that is one line; None: it must be looked for."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):  # the same splits in all passes
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    whole = ~F.contains("value", F.lit('"')) | F.col("value").rlike(_SPARK_WHOLE)
    splits = rows.groupBy("file_path", "block").agg(F.min("id").alias("start"), F.count(F.lit(1)).alias("n"), F.bool_and(whole).alias("whole")).collect()  # a row a split
    splits.sort(key=lambda r: (r["file_path"], r["block"]))
    head = None
    if splits:
        at = splits[0]
        line = rows.where((F.col("file_path") == at["file_path"]) & (F.col("block") == at["block"]) & (F.col("id") == at["start"])).select("value").limit(1).collect()[0][0]
        head = None if ends_inside(line, False) else line.removesuffix("\r")
    if all(r["whole"] for r in splits):
        before = itertools.accumulate((r["n"] for r in splits), initial=0)
        known = spark.createDataFrame([(r["file_path"], r["block"], r["start"], n) for r, n in zip(splits, before)], "file_path string, block long, start long, before long")
        first = (F.col("block") == 0) & (F.col("id") == F.col("start"))
        seq = F.col("id") - F.col("start") + F.col("before")
        found = rows.join(F.broadcast(known), ["file_path", "block"]).select("file_path", seq.alias("seq"), first.alias("first"), F.col("value").alias("record"))
    else:
        found = _put_together(rows)
    return found.withColumn("record", F.regexp_replace("record", "\r$", "")), head


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file_path, seq (the number of a record's first line, over all files in the order of their names), first (the file's first record), record: its text without the line's end."""
    return _records_and_head(spark, path)[0]


def _put_together(rows: DataFrame) -> DataFrame:
    """Records, some of which reach over lines, of the lines of splits (file_path, block, id, value)."""
    states = rows.mapInArrow(_states, "file_path string, block long, start long, n long, outside boolean, inside boolean").collect()  # a row a split
    begins, name, inside, lines = {}, None, False, 0
    for r in sorted(states, key=lambda r: (r["file_path"], r["block"])):
        inside = inside if r["file_path"] == name else False
        name, begins[r["file_path"], r["block"]] = r["file_path"], (inside, lines - r["start"])
        inside, lines = r["inside"] if inside else r["outside"], lines + r["n"]
    found = rows.mapInArrow(_records(begins), "file_path string, seq long, begun boolean, done boolean, first boolean, record string")
    whole = found.where("begun and done").select("file_path", "seq", "first", "record")
    if any(r["outside"] for r in states):  # some split ends within a record
        pieces = found.where("not (begun and done)").withColumn("n", F.sum(F.col("begun").cast("int")).over(Window.partitionBy("file_path").orderBy("seq")))
        joined = pieces.groupBy("file_path", "n").agg(F.min("seq").alias("seq"), F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("l"))
        whole = whole.unionByName(joined.select("file_path", "seq", "first", F.array_join(F.transform("l", lambda x: x["record"]), "\n").alias("record")))
    return whole


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns of a CSV file as text, by its header, and seq, which follows the file; a record of more or fewer fields ends the query with an error. None: the file is empty."""
    import csv

    records, head = _records_and_head(spark, path)
    if head is None:
        heads = records.where("first").orderBy("seq").select("record").limit(1).collect()
        if not heads:
            return None
        head = heads[0][0]
    names = next(csv.reader([head], skipinitialspace=True), [])
    if not names:
        return None
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"mode": "FAILFAST", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    rows = records.where(~F.col("first") & (F.trim("record") != ""))
    # One value of the whole record, so that no part of it is read without the check of its length.
    parsed = rows.select(F.from_csv("record", F.lit(schema), options).alias("r"), "seq")
    return parsed.select(*[F.col(f"r.c{k}").alias(name.strip()) for k, name in enumerate(names)], "seq")
