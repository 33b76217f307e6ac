"""The store: Parquet tables of formats, reference alleles and processed files, kept in buckets of their key.

A table is a folder of versions and of numbered commits. A commit is a small file that names, for each bucket, the version whose folder holds it, and its
number of rows; the highest commit counts. A load writes the buckets that its keys fall into, as a new version, and its commit last: other
buckets' files stay as they are and are named again. A commit that is there already cannot be written again. So a reader sees the
old table or the new one, a load that fails anywhere leaves the store as it was, and of two writers that started from one commit the
second is refused. What the last two commits do not name is deleted. All goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import schemas, storage
from helixlake.functions.text import parse_long, parse_rsid, trim

TABLES = {"formats": schemas.FORMATS, "references": schemas.REFERENCES, "manifest": schemas.MANIFEST}
KEYS = {"formats": "id", "references": "rsid", "manifest": "file_path"}
#: A new table's buckets; a table with more rows than this a bucket on average gets twice as many.
BUCKETS, BUCKET_ROWS = 16, 2_000_000


class Store:
    def __init__(self, spark: SparkSession, path, create: bool = True, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        """create: make what is missing, and see that the default format is there; else nothing is written."""
        self.spark, self.path, self.seen = spark, str(path).rstrip("/"), {}
        self.buckets, self.bucket_rows = buckets, bucket_rows
        if not create:
            if not storage.exists(spark, self.path):
                raise FileNotFoundError(f"no store at {path}")
            return
        for name, schema in TABLES.items():
            if not self.commits(name):
                self.replace(name, spark.createDataFrame([], schema))
        formats = self.read("formats")
        if not has_default(formats):
            self.replace("formats", seed_formats(formats))

    def commits(self, table: str) -> list[int]:
        return sorted(int(n) for n in storage.names(self.spark, f"{self.path}/{table}/commits") if n.isdigit())

    def state(self, table: str, commit: int | None = None) -> dict:
        """buckets (their number) and files ({bucket: [version, rows]}) of a commit, the latest unless one is given."""
        commits = self.commits(table) if commit is None else [commit]
        if not commits:
            return {"buckets": self.buckets, "files": {}}
        self.seen[table] = max(commits[-1], self.seen.get(table, 0)) if commit is not None else commits[-1]
        state = json.loads(storage.read_text(self.spark, f"{self.path}/{table}/commits/{commits[-1]:010d}"))
        return state | {"files": {int(k): f for k, f in state["files"].items()}}

    def _read(self, table: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/{version}/bucket={k}" for k, (version, _) in sorted(state["files"].items()) if buckets is None or k in buckets]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def read(self, table: str) -> DataFrame:
        return self._read(table, self.state(table))

    def _write(self, table: str, rows: DataFrame, buckets: int) -> tuple[str, dict]:
        """A version of the rows' buckets, and what a commit says of them."""
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.path}/{table}/{version}"
        rows.withColumn("bucket", bucket_of(KEYS[table], rows, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(at)
        if not any(n.startswith("bucket=") for n in storage.names(self.spark, at)):
            return version, {}
        counts = self.spark.read.parquet(at).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket, from the files' footers
        return version, {r["bucket"]: [version, r["n"]] for r in counts}

    def _commit(self, table: str, version: str, state: dict) -> None:
        commit = self.seen.get(table, 0) + 1
        if not storage.write_new(self.spark, f"{self.path}/{table}/commits/{commit:010d}", json.dumps(state)):
            storage.remove(self.spark, f"{self.path}/{table}/{version}")
            raise RuntimeError(f"{table} has been replaced by another writer")
        old = [c for c in self.commits(table) if c < commit - 1]
        gone = {(k, f[0]) for c in old for k, f in self.state(table, c)["files"].items()}
        kept = {(k, f[0]) for c in (commit - 1, commit) if c for k, f in self.state(table, c)["files"].items()}
        self.seen[table] = commit
        for k, v in gone - kept:
            storage.remove(self.spark, f"{self.path}/{table}/{v}/bucket={k}")
        for v in {v for _, v in gone} - {v for _, v in kept}:
            storage.remove(self.spark, f"{self.path}/{table}/{v}")
        for c in old:
            storage.remove(self.spark, f"{self.path}/{table}/commits/{c:010d}")

    def replace(self, table: str, rows: DataFrame, buckets: int | None = None) -> None:
        """Make rows, computed from what read() gave last, the whole table; an error if another writer has been faster."""
        buckets = buckets or (self.state(table, self.seen[table])["buckets"] if table in self.seen else self.buckets)
        version, files = self._write(table, rows, buckets)
        self._commit(table, version, {"buckets": buckets, "files": files})

    def merge(self, table: str, stage: Callable[[int], DataFrame], combine: Callable[[DataFrame, DataFrame], DataFrame], told: list[Column] | None = None) -> dict:
        """Merge changes into the buckets that their keys fall into; returns told, sums over the changes.

        stage gives, for a number of buckets, the changes with a column bucket (null: rows that only count). They are stored first, so
        what they come from is read once; combine makes the new rows of old rows and changes.
        """
        state, at = self.state(table), storage.new_path(self.spark, "changes")
        try:
            changes = storage.written_by(stage(state["buckets"]), at, "bucket")
            touched = [int(n.removeprefix("bucket=")) for n in storage.names(self.spark, at) if n.removeprefix("bucket=").isdigit()]
            if touched:
                own = changes.where("bucket is not null").drop("bucket")
                version, files = self._write(table, combine(self._read(table, state, touched), own), state["buckets"])
                # A bucket that the merge leaves empty has no files.
                self._commit(table, version, {"buckets": state["buckets"], "files": {k: f for k, f in state["files"].items() if k not in touched} | files})
                self._divide(table)
            return changes.agg(*told).first().asDict() if told else {}
        finally:
            storage.remove(self.spark, at)

    def _divide(self, table: str) -> None:
        """Twice as many buckets, as often as it takes, for a table that has outgrown its own."""
        state = self.state(table)
        wanted, rows = state["buckets"], sum(n for _, n in state["files"].values())
        while rows > wanted * self.bucket_rows:
            wanted *= 2
        if wanted > state["buckets"]:
            self.replace(table, self._read(table, state), wanted)

    def load_lookup(self, lookup: DataFrame) -> dict[str, int]:
        """Upsert the exact rows of a lookup; nothing is stored if any of them is bad. The lookup is read once, its counters included."""
        own = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("copies"))), F.lit(0).cast("bigint"))
        told = [own(F.col("rsid").isNotNull()).alias("imported"), own(F.col("rsid").isNull()).alias("skipped")]
        return self.merge("references", lambda n: staged_lookup(lookup, n), lambda old, new: upserted(old, new.drop("copies")), told)

    def record_files(self, stats: DataFrame) -> None:
        """Add per-file counts to the manifest; a file's latest counts stay."""
        self.merge("manifest", lambda n: stats.withColumn("bucket", bucket_of("file_path", stats, n)), merge_manifest)

    def unrecorded(self, files: DataFrame) -> DataFrame:
        return not_recorded(files, self.read("manifest"))


def bucket_of(key: str, rows: DataFrame, buckets: int) -> Column:
    """Whole numbers by themselves, which are dense enough, anything else by a hash."""
    whole = rows.schema[key].dataType.typeName() in ("long", "integer")
    return F.pmod(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(buckets)).cast("int")


def staged_lookup(lookup: DataFrame, buckets: int) -> DataFrame:
    """What a load changes: the last exact row of each rsid with its bucket, and how many rows it stands for; all other rows as one without rsid or bucket."""
    exact = F.coalesce(is_exact(trim(F.col("status"))), F.lit(False))
    named = [c for c in typed_columns() if c != "seq"]
    rows = lookup.select(*[F.when(exact, value).alias(c) for c, value in typed_columns().items()])
    last = rows.groupBy("rsid").agg(F.max_by(F.struct(*named[1:]), "seq").alias("r"), F.count(F.lit(1)).alias("copies"))
    return last.select("rsid", *[F.col("r")[c].alias(c) for c in named[1:]], "copies").withColumn("bucket", F.when(F.col("rsid").isNotNull(), bucket_of("rsid", last, buckets)))


def merge_manifest(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    old = manifest.join(stats.select("file_path"), "file_path", "left_anti")
    return old.unionByName(stats.select("file_path", "variant_count", "skipped_rows"))


def not_recorded(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of files (file_path and others) whose file the manifest does not have."""
    return files.join(manifest, "file_path", "left_anti")


def _defaults(formats: DataFrame) -> DataFrame:
    number, name, _ = schemas.DEFAULT_FORMAT
    return formats.where((F.col("id") == number) | (F.col("name") == name))


def has_default(formats: DataFrame) -> bool:
    return not _defaults(formats).isEmpty()


def seed_formats(formats: DataFrame) -> DataFrame:
    """Insert the default format unless its id or its name is there."""
    row = formats.sparkSession.createDataFrame([schemas.DEFAULT_FORMAT], schemas.FORMATS)
    return formats.unionByName(row.join(_defaults(formats).select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti"))


def is_exact(status: Column) -> Column:
    return F.lower(status) == "exact"


def typed_columns(strict: bool = True) -> dict[str, Column]:
    """The columns of an exact row; see typed_lookup."""
    blank = lambda c: F.coalesce(trim(F.col(c)), F.lit(""))
    position = F.coalesce(parse_long(blank("ref_pos")), parse_long(blank("query_pos")))
    rsid = parse_rsid(blank("query_rsid"))
    if strict:
        position = F.coalesce(position, F.raise_error(F.concat(F.lit("no valid position: "), blank("query_rsid"))).cast("bigint"))
        rsid = F.coalesce(rsid, F.raise_error(F.concat(F.lit("no valid rsid: "), blank("query_rsid"))).cast("bigint"))
    return {"rsid": rsid, "chromosome": blank("query_chrom"), "position": position, "reference": blank("ref"), "alternates": blank("alt"), "seq": F.col("seq")}


def typed_lookup(lookup: DataFrame, strict: bool = True) -> DataFrame:
    """rsid, chromosome, position, reference, alternates, seq of the exact rows; ref_pos, else query_pos, gives the position.

    strict: a bad number ends the query with an error; otherwise the row has nulls.
    """
    return lookup.where(is_exact(trim(F.col("status")))).select(*[value.alias(c) for c, value in typed_columns(strict).items()])


def load_counters(lookup: DataFrame) -> DataFrame:
    exact = F.coalesce(is_exact(trim(F.col("status"))), F.lit(False))
    return lookup.agg(F.count_if(exact).alias("imported"), F.count_if(~exact).alias("skipped"))


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: that with the largest order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])


def upsert(references: DataFrame, loaded: DataFrame) -> DataFrame:
    """New rows get format 1; of a known rsid all but the format is replaced; the last loaded row of an rsid counts."""
    return upserted(references, last_wins(loaded, "rsid", F.col("seq")).drop("seq"))


def upserted(references: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert, for new rows of which each rsid has one."""
    old = references.select("rsid", *[F.col(c).alias(f"_{c}") for c in references.columns if c != "rsid"])
    both = old.join(new, "rsid", "full_outer")
    return both.select("rsid", F.coalesce("_format_id", F.lit(1).cast("bigint")).alias("format_id"), *[F.coalesce(c, f"_{c}").alias(c) for c in ("chromosome", "position", "reference", "alternates")])


def ordered_references(references: DataFrame, limit: int | None = None) -> DataFrame:
    """The five allele columns by chromosome (as text), position and rsid."""
    out = references.select("rsid", "chromosome", "position", "reference", "alternates").orderBy("chromosome", "position", "rsid")
    return out if limit is None else out.limit(limit)
