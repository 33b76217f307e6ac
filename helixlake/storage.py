"""Tables and files in the folder that driver and executors share, through Spark's file systems."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one a folder of our own, in local mode only, where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="helixlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back, and the path, for remove(): lineage is cut, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written_by(df: DataFrame, path: str, column: str) -> DataFrame:
    """Write df at a path, in folders by a column (nulls have one too), and read it back."""
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffles and broadcasts of finished steps now: it does so once the driver's garbage is collected.

    Those of the last step are found by the second collection only (seen in a run).
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _at(spark: SparkSession, path: str):
    """The path's file system, without files of checksums beside what is written, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)
    return system, at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names of what is in a folder; none if there is no such folder."""
    system, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a string."""
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there already; whether it was written."""
    system, at = _at(spark, path)
    system.mkdirs(at.getParent())
    try:
        stream = system.create(at, False)
    except Exception:
        if system.exists(at):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename, replacing a file that is there."""
    system, at = _at(spark, target)
    system.mkdirs(at.getParent())
    system.delete(at, False)
    if not system.rename(_at(spark, source)[1], at):
        raise OSError(f"cannot write {target}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, replacing one that is there."""
    system, at = _at(spark, path)
    system.mkdirs(at.getParent())
    stream = system.create(at, True)
    stream.write(bytearray(data))
    stream.close()


def concatenated(spark: SparkSession, files: dict[str, list[str]]) -> None:
    """Make each file (a new name) of others, one behind the other; those may be gone then. The driver handles names only.

    A file system that can concatenate does so without copying. Elsewhere a task for each file copies the bytes to a name of its attempt, which is then
    renamed, so a task that runs twice does no harm.
    """
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    left = {}
    for target, (first, *rest) in files.items():
        system, at = _at(spark, first)
        others = spark.sparkContext._gateway.new_array(paths, len(rest))
        for k, path in enumerate(rest):
            others[k] = _at(spark, path)[1]
        try:
            if rest:
                system.concat(at, others)
            move(spark, first, target)
        except Exception as error:  # not offered here
            if "Unsupported" not in str(error) and "not supported" not in str(error).lower():
                raise
            left[target] = [first, *rest]
    for target, draft in (_copied_by_tasks(spark, left) if left else {}).items():
        move(spark, draft, target)


def uri(spark: SparkSession, path: str) -> str:
    system, at = _at(spark, path)
    return system.makeQualified(at).toString()


def _copied_by_tasks(spark: SparkSession, files: dict[str, list[str]]) -> dict[str, str]:
    """Copies of the sources of each target, under names of their own."""
    def copy(batches):
        import pyarrow as pa

        from helixlake import shared_files

        for batch in batches:
            drafts = [f"{target}.draft-{uuid.uuid4().hex}" for target in batch.column("target").to_pylist()]
            for draft, sources in zip(drafts, batch.column("sources").to_pylist()):
                shared_files.copied(sources, draft)
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(drafts, pa.string())], names=["n", "draft"])

    targets = list(files)
    rows = [(n, uri(spark, t), [uri(spark, s) for s in files[t]]) for n, t in enumerate(targets)]
    named = spark.createDataFrame(rows, "n long, target string, sources array<string>").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "n")
    return {targets[r["n"]]: r["draft"] for r in named.mapInArrow(copy, "n long, draft string").collect()}


def write_text_file(lines: DataFrame, path: str, before: str = "", after: str = "", line_end: str = "\n") -> None:
    """One file of the lines (one column), in their order, between two texts: tasks write parts, which are put one behind the other, and the file gets its name last."""
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.option("lineSep", line_end).text(parts)
    release(spark)  # the sort's shuffle, before the parts are copied
    own = [f"{parts}/{name}" for name in names(spark, parts) if name.startswith("part-")]
    write_bytes(spark, f"{parts}/before", before.encode())
    write_bytes(spark, f"{parts}/behind", after.encode())
    concatenated(spark, {path: [f"{parts}/before", *own, f"{parts}/behind"]})
    remove(spark, parts)
