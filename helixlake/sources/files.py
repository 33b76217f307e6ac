"""Discovery of genotype files on any shared file system: tasks list folders, look into files and copy those with hidden names; the driver gets names."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import shared_files, storage

SUFFIXES = {".txt", ".tsv", ".csv"}


def is_candidate(path: PurePosixPath) -> bool:
    """Of a directory's files those ending in .txt, .tsv or .csv, in any case, or without an ending."""
    return path.suffix == "" or path.suffix.lower() in SUFFIXES


def _named(system: fs.FileSystem, given: str, at: str) -> str:
    """A found path as the caller would write it: with the scheme that was given, and on a local file system without links."""
    if isinstance(system, fs.LocalFileSystem):
        try:
            return os.path.realpath(at, strict=True)
        except OSError:
            return at
    scheme, _, rest = given.partition("://")
    return f"{scheme}://{rest.partition('/')[0]}/{at.partition('/')[2]}" if rest and isinstance(system, fs.S3FileSystem | fs.GcsFileSystem) else f"{scheme}://{rest.partition('/')[0]}{at}" if rest else at


def _listed(deep: bool):
    """For mapInArrow over paths: kind (file, folder, missing) and path of what is there; folders' candidates, at any depth or in the folder itself."""
    def run(batches):
        for batch in batches:
            out = []
            for given in batch.column("path").to_pylist():
                system, at = shared_files.located(given)
                info = system.get_file_info(at)
                if info.type == fs.FileType.NotFound:
                    out.append(("missing", given))
                elif info.type == fs.FileType.File:
                    out.append(("file", _named(system, given, at)))
                else:
                    for entry in system.get_file_info(fs.FileSelector(at, recursive=deep)):
                        if entry.type == fs.FileType.File and is_candidate(PurePosixPath(entry.path)):
                            out.append(("file", _named(system, given, entry.path)))
                        elif entry.type == fs.FileType.Directory and not deep:
                            out.append(("folder", _named(system, given, entry.path)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], names=["kind", "path"])

    return run


def _spread(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, min(len(paths), 8 * spark.sparkContext.defaultParallelism)))


def discover(spark: SparkSession, inputs: list, max_files: int | None = None) -> list[str]:
    """Sorted, distinct paths: files as they are given, candidates of directories at any depth; links of local paths are followed.

    A task lists each input, and one each folder in it.
    """
    if not inputs:
        raise ValueError("no input given")
    first = _spread(spark, [str(p) for p in inputs]).mapInArrow(_listed(False), "kind string, path string").distinct().collect()
    if missing := sorted(r["path"] for r in first if r["kind"] == "missing"):
        raise FileNotFoundError(f"neither a file nor a directory: {missing[0]}")
    found = {r["path"] for r in first if r["kind"] == "file"}
    folders = [r["path"] for r in first if r["kind"] == "folder"]
    if folders:
        found |= {r["path"] for r in _spread(spark, folders).mapInArrow(_listed(True), "kind string, path string").where("kind = 'file'").select("path").distinct().collect()}
    if not found:
        raise FileNotFoundError("no genotype files found")
    return sorted(found)[:max_files]


def _tried(batches):
    for batch in batches:
        errors = []
        for path in batch.column("path").to_pylist():
            try:
                with shared_files.opened(path) as f:
                    errors.append(None if f.read(1) else "file is empty")
            except OSError as error:
                errors.append(str(error))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(errors, pa.string())], names=["file_path", "error"])


def split_failures(spark: SparkSession, paths: list[str]) -> tuple[list[str], DataFrame]:
    """The paths that can be read, and file_path, error of those that cannot: empty files and unreadable ones."""
    if not paths:
        return [], spark.createDataFrame([], "file_path string, error string")
    bad = _spread(spark, paths).mapInArrow(_tried, "file_path string, error string").where("error is not null").collect()  # names
    failed = {r["file_path"] for r in bad}
    return [p for p in paths if p not in failed], spark.createDataFrame(bad, "file_path string, error string")


def visible(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """For each path one that Spark does not hide: tasks copy files whose names begin with _ or . to the shared folder, under other names."""
    hidden = [p for p in paths if p.rsplit("/", 1)[-1][:1] in ("_", ".")]
    if not hidden:
        return {p: p for p in paths}
    folder = metadata_name(spark, storage.new_path(spark, "shown"))

    def copy(batches):
        for batch in batches:
            own = batch.column("path").to_pylist()
            # The attempt's own name, so a task that runs twice does no harm.
            made = [f"{shared_files.attempt_name(folder, k)}-shown{p.rsplit('/', 1)[-1]}" for k, p in enumerate(own)]
            for p, to in zip(own, made):
                shared_files.copied([p], to)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made)], names=["path", "shown"])

    made = {r["path"]: r["shown"] for r in _spread(spark, hidden).mapInArrow(copy, "path string, shown string").collect()}
    return {p: made.get(p, p) for p in paths}


def metadata_name(spark: SparkSession, path: str) -> str:
    """A path or URI of any file system as Spark's file metadata has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    name = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return name.replace("file:///", "file:/", 1) if name.startswith("file:///") else name


def with_errors(paths: DataFrame, failures: DataFrame) -> DataFrame:
    """paths (file_path and others) with error, blank for those that can be read."""
    return paths.join(failures, "file_path", "left").withColumn("error", F.coalesce("error", F.lit("")))
