"""What the operators share: table access, storage that cuts lineage, ASCII text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.storage import release, remove, stored, written  # noqa: F401

#: The white space that separates words and pads lines.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text, modulo folds, equals fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


#: Up to this many ids are broadcast (16 bytes each: 8 MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(rows: DataFrame, name: str) -> str:
    """name, or name with marks behind it that no column of rows has."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replacing(rows: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """rows with the fields of the struct made as columns, in the place of any of these names."""
    kept = [c for c in rows.columns if c.lower() not in names]
    at = unused(rows, "made")
    return rows.select(*map(column, kept), made.alias(at)).select(*map(column, kept), f"{at}.*")
