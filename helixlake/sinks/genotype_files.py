"""Synthetic rows as named text files, one for each plan, written by as many tasks as their size asks for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake import shared_files, storage
from helixlake.schemas import GENOTYPE_COLUMNS

#: The comment lines at the head of a file; the last one names its columns.
HEADER = """# This data file generated by Dynamic DNA (DDNA) Laboratories at: Thu Nov 7 16:03:14 2024
#\t\t\t\t\t\t
# This file contains raw genetic data, including data that is not used in DDNA reports. \t\t\t\t\t\t
# This data has undergone a general quality review however only a subset of markers have been \t\t\t\t\t\t
# individually reviewed for accuracy. As such, this data is suitable only for research,  \t\t\t\t\t\t
# educational, and informational use and not for any medical or diagnostic use. \t\t\t\t\t\t
# \t\t\t\t\t\t
# Below is a text version of your data.  Fields are TAB-separated and\t\t\t\t\t\t
# each line corresponds to a single SNP.  For each SNP, we provide its identifier,  \t\t\t\t\t\t
# it chromosomal location realtive to Build 38 of the human reference genome, and the \t\t\t\t\t\t
# genotype call oriented with respect to the plus strand on the human reference sequence.\t\t\t\t\t\t
# More information about Dynamic DNA Laboratories can be found at:\t\t\t\t\t\t
# https://dynamicdnalabs.com\t\t\t\t\t\t
# \t\t\t\t\t\t
# More information on reference human assembly builds:\t\t\t\t\t\t
# https://www.ncbi.nlm.nih.gov/datasets/genome/GCF_000001405.40/\t\t\t\t\t\t
#\t\t\t\t\t\t
# rsid\tchromosome\tposition\tgenotype\tgs\tbaf\tlrr
"""


PLACE = ["file_idx", "part", "leftover", "chromosome", "position", "rsid"]


def genotype_lines(rows: DataFrame, header: str = HEADER) -> DataFrame:
    """The columns of PLACE and line: the header (part 0) and the rows (part 1) of each file; in the order of PLACE they are the file's lines."""
    label = F.concat(F.lit("rs"), F.col("rsid").cast("string"))
    order = PLACE[2:]
    lines = rows.select("file_idx", F.lit(1).alias("part"), *order, F.concat_ws("\t", label, *GENOTYPE_COLUMNS[1:]).alias("line"))
    heads = rows.select("file_idx").distinct().select("file_idx", F.lit(0).alias("part"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(header.removesuffix("\n")).alias("line"))
    return heads.unionByName(lines)


def _parts(folder: str):
    """For mapInArrow over sorted lines: each file's lines in this partition as a part of it, and their number without the header."""
    def write(batches):
        from pyspark import TaskContext

        task, name, out, at, count, told = TaskContext.get().partitionId(), None, None, None, 0, []
        for batch in batches:
            files, parts = (np.asarray(batch.column(c)) for c in ("file_idx", "part"))
            lines = batch.column("line")
            begin = np.flatnonzero(np.append(True, files[1:] != files[:-1])) if len(files) else []
            for a, b in zip(begin, np.append(begin[1:], len(files))):
                if out is None or files[a] != at:
                    if out is not None:
                        out.close()
                        told.append((at, task, name, count))
                    at, count, name = int(files[a]), 0, shared_files.attempt_name(folder, task)
                    out = shared_files.created(name)
                out.write(("\n".join(lines.slice(a, b - a).to_pylist()) + "\n").encode())
                count += int(parts[a:b].sum())
        if out is not None:
            out.close()
            told.append((at, task, name, count))
        columns = list(zip(*told)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=["file_idx", "task", "name", "rows"])

    return write


def write_genotype_files(rows: DataFrame, plans: DataFrame, header: str = HEADER) -> DataFrame:
    """Write each plan's rows to its path and return path and rows of each file written.

    Lines are dealt by file and place, so a large file is the work of many tasks and a task may write many small files. Each writes parts under names of its attempt
    and says how many rows they have; the parts of a file are then put one behind the other. Nothing is read back.
    """
    spark = rows.sparkSession
    paths = {r["file_idx"]: r["path"] for r in plans.select("file_idx", "path").collect()}  # names only
    folder = storage.new_path(spark, "genotypes")
    dealt = genotype_lines(rows, header).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).select("file_idx", "part", "line")
    made = dealt.mapInArrow(_parts(storage.uri(spark, folder)), "file_idx long, task int, name string, rows long").collect()  # a row a file and task
    parts: dict[str, list[str]] = {}
    counts: dict[str, int] = {}
    for r in sorted(made, key=lambda r: (r["file_idx"], r["task"])):
        path = paths[r["file_idx"]]
        parts.setdefault(path, []).append(r["name"])
        counts[path] = counts.get(path, 0) + r["rows"]
    storage.concatenated(spark, parts)
    storage.remove(spark, folder)
    return spark.createDataFrame(list(counts.items()), "path string, rows long")


def write_generated_file(rows: DataFrame, path: str, header: str = HEADER) -> None:
    """One file of the older generator's rows, in the order of the lookup."""
    lines = rows.select("seq", F.concat_ws("\t", "rsid", "chromosome", "position", *GENOTYPE_COLUMNS[3:]).alias("line"))
    # A global sort reads its input twice; the rows are made once.
    kept, at = storage.written(lines, "generated-lines")
    storage.write_text_file(kept.orderBy("seq").select("line"), path, header)
    storage.remove(rows.sparkSession, at)
