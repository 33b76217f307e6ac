"""Incremental ingestion of genotype files: an extension of the batch reader.

A file source with a checkpoint takes each file of a folder and those below it once, if it is a candidate, which is what skipping recorded files means for a folder that
grows. Files are parsed as wholes by the batch operators in each micro-batch, and their counts are merged into the manifest, so a
batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from helixlake.operators.store import Store
from helixlake.sources.files import is_candidate
from helixlake.sources.genotype_text import file_stats, read_genotypes


def ingest_files(spark: SparkSession, folder: str, store_path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Start a query that records the counts of all files that are in folder and have not been seen, and then stops."""
    names = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path"))

    def record(batch: DataFrame, _: int) -> None:
        paths = [p for p in (r["path"] for r in batch.collect()) if is_candidate(PurePosixPath(p))]  # at most files_per_batch names
        if paths:
            Store(batch.sparkSession, store_path).record_files(file_stats(read_genotypes(batch.sparkSession, paths)))

    return names.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
