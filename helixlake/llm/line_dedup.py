"""Removal of lines that many documents share.

Texts stay where they are: every line becomes a row of a 128-bit hash of its key, its document and its position.
The rows are range-partitioned by (hash, document), so that a line found in a third of all documents is spread over
many partitions, and sorted within them by document and position. A stream over each partition sees the occurrences of
a key in order; it holds a batch of rows, and of the key at the batch's end its first and last row. Rows of a key that is undecided there, or at the
border of a partition, are told to be open, and are decided afterwards from the counts of such keys, a few rows a partition and batch. What comes back to a document is a
zlib-compressed bitmap of the lines it keeps.

A document is a row identified by (id, text). Defined results: a null or empty text is one empty line; repeated rows
are one document, so they count once and get the same result; a null id is an id like any other; lines whose key has
fewer than min_chars code points always stay; an empty table gives no rows; only id_col and text_col of the input are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import SPACES, ascii_lower, column, remove, shuffle_partitions, stored, table, unused, written

#: What a row of the stream says: a line to drop; a line of a key undecided at a border; what a border key has here.
DROP, OPEN, BORDER = 0, 1, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _stream(min_docs: int, keep_first: bool, id_type: pa.DataType):
    """A function for mapInArrow over rows sorted by (h1, h2, id, th, pos)."""
    schema = pa.schema([("kind", pa.int32()), ("id", id_type), ("th", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64())])

    def emit(kind: int, rows: pa.Table, docs: int | None = None) -> pa.RecordBatch:
        n = rows.num_rows
        columns = [pa.array(np.full(n, kind, np.int32)), *(rows.column(c).combine_chunks() for c in ("id", "th", "pos", "h1", "h2")), pa.array([docs] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    def changed(rows: pa.Table, names: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(rows.num_rows, bool)
        out[:1] = True
        for c in names:
            x = rows.column(c).combine_chunks()
            code = x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if c == "id" else x.to_numpy(zero_copy_only=False)
            out[1:] |= code[1:] != code[:-1]
        return out

    def function(batches):
        # Of the run that the rows read so far end with: its key, documents, first and last row, and whether a border or rows already sent need its count.
        key, docs, first, last, open_ = None, 0, None, None, True

        def ended(border: bool):
            if key is not None and (border or open_):
                yield emit(BORDER, first, docs)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            key_new = changed(rows, ("h1", "h2"))
            doc_new = key_new | changed(rows, ("id", "th"))
            if key == (rows.column("h1")[0].as_py(), rows.column("h2")[0].as_py()):
                key_new[0] = False
                doc_new[0] = changed(pa.concat_tables([last, rows.slice(0, 1)]), ("id", "th"))[1]
            begin = np.flatnonzero(key_new)
            more = int(begin[0]) if len(begin) else rows.num_rows
            if more:  # the run goes on
                docs += int(doc_new[:more].sum())
                last = rows.slice(more - 1, 1)
                open_ |= docs < min_docs
                yield emit(DROP if docs >= min_docs else OPEN, rows.slice(0, more))
            if not len(begin):
                continue
            yield from ended(False)
            end = np.append(begin[1:], rows.num_rows)
            counts = np.add.reduceat(doc_new.astype(np.int64), begin)
            begun = key is not None
            lo = 0
            if not begun and len(begin) > 1:  # the partition's first run may go on before it
                yield emit(BORDER, rows.slice(0, 1), int(counts[0]))
                rest = rows.slice(int(keep_first), int(end[0]) - int(keep_first))
                yield emit(DROP if counts[0] >= min_docs else OPEN, rest)
                lo = 1
            drop = np.repeat(counts >= min_docs, end - begin)
            drop[: begin[lo] - more] = False
            drop[begin[-1] - more :] = False
            if keep_first:
                drop[begin - more] = False
            if drop.any():
                yield emit(DROP, rows.slice(more).filter(pa.array(drop)))
            # What the last run has so far goes out at once, so only its ends are held.
            at = int(begin[-1])
            key, docs = (rows.column("h1")[at].as_py(), rows.column("h2")[at].as_py()), int(counts[-1])
            first, last = rows.slice(at, 1), rows.slice(rows.num_rows - 1, 1)
            open_ = docs < min_docs or (not begun and len(begin) == 1)
            yield emit(DROP if docs >= min_docs else OPEN, rows.slice(at + int(keep_first)))
        yield from ended(True)

    return function


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop as rows (id, th, pos); th is the hash that tells rows with one id but other texts apart."""
    spark = docs.sparkSession
    # Stored, since a range partition reads its rows twice: once for the bounds.
    rows, at = written(line_rows(docs, min_chars, id_col, text_col), "line-rows")
    id_type = rows.schema["id"].dataType
    order = ["h1", "h2", "id", "th"]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "pos")
    from pyspark.sql.pandas.types import to_arrow_type

    said = stored(dealt.mapInArrow(_stream(min_docs, keep_first, to_arrow_type(id_type)), f"kind int, id {id_type.simpleString()}, th long, pos int, h1 long, h2 long, docs long"), "line-drops")
    remove(spark, at)
    border = said.where(F.col("kind") == BORDER)
    totals = border.groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.min(F.struct("id", "th", "pos")).alias("first")).where(F.col("all") >= min_docs)
    late = said.where(F.col("kind") == OPEN).join(totals, ["h1", "h2"], "left_semi")
    out = said.where(F.col("kind") == DROP).unionByName(late).select("id", "th", "pos")
    if keep_first:  # the first row of a run's later pieces is no first occurrence
        later = border.join(totals, ["h1", "h2"]).where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
        out = out.unionByName(later.select("id", "th", "pos"))
    return out


@F.pandas_udf(T.BinaryType())
def keep_bitmap(positions: pd.Series, n_lines: pd.Series) -> pd.Series:
    """zlib of one bit a line, most significant first; 1: the line stays, as do lines after the last bit."""
    def one(drop, n):
        drops = np.zeros(n, bool)
        drops[np.asarray(drop, np.int64)] = True
        return zlib.compress((~np.packbits(drops)).tobytes())

    return pd.Series([one(d, n) for d, n in zip(positions, n_lines)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document that loses lines: id, th, n_dropped and the bitmap of the lines it keeps."""
    drops = dropped_lines(docs, min_docs, min_chars, keep_first, id_col, text_col)
    lists = drops.groupBy("id", "th").agg(F.collect_set("pos").alias("drop"))
    return lists.select("id", "th", F.size("drop").cast("long").alias("n_dropped"), keep_bitmap("drop", F.array_max("drop") + 1).alias("keep"))


def _kept(text: str | None, keep: bytes | None) -> str:
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    drops = np.unpackbits(~np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(x for x, b in zip(lines, drops) if not b)


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([_kept(t, k) for t, k in zip(text, keep)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_sha256(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(_kept(t, k).encode()).hexdigest() for t, k in zip(text, keep)], dtype=object)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with each document's bitmap and number of dropped lines (null and 0: nothing is dropped), and the names of these two columns, which docs has not."""
    keep, dropped, key, th = (unused(docs, c) for c in ("keep", "n_dropped", "drop_id", "drop_th"))
    b = bitmaps.select(F.col("id").alias(key), F.col("th").alias(th), F.col("keep").alias(keep), F.col("n_dropped").alias(dropped))
    on = column(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(column(text_col)) == F.col(th))
    joined = docs.join(b, on, "left")
    return joined.select(*map(column, docs.columns), F.col(keep), F.coalesce(dropped, F.lit(0).cast("long")).alias(dropped)), keep, dropped


def _changed(text_col: str, keep: str) -> tuple[Column, Column]:
    """Text and bitmap, for Python; of a document that keeps all lines the text stays where it is."""
    return F.when(F.col(keep).isNotNull(), column(text_col)), F.col(keep)


def remove_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept lines as their text; all other columns as they were."""
    joined, keep, _ = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col), id_col, text_col)
    text = F.when(F.col(keep).isNull(), column(text_col)).otherwise(kept_text(*_changed(text_col, keep)))
    return joined.select(*[text.alias(c) if c == text_col else column(c) for c in docs.columns])


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined, keep, dropped = with_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return joined.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.col(dropped).alias("n_dropped"),
                         F.when(F.col(keep).isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise(kept_sha256(*_changed("text", keep))).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE s.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s ON keyed.key = s.key GROUP BY doc_id
"""
