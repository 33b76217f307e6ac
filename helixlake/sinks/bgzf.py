"""VCF text as one blocked gzip file with its index, written by many tasks.

Records are sorted by a range partition; each task compresses its lines into blocks of a part of its own and says, a row for each run of records in one bin and
for each window of positions, at which virtual offsets they lie. Blocks can be put one behind the other, so the file is the header's block, the parts and
the block that ends it. What the driver handles are the offsets: rows for bins and windows of 2^14 positions, whose number the length of
the genome bounds, not the number of records.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake import shared_files, storage
from helixlake.functions.bins import WINDOW_BITS, bin_number
from helixlake.sources.bgzf import BLOCK_BYTES, END_BLOCK, Index, compressed

PLACES = "part int, name string, size long, contig string, bin int, window long, first long, upto long"


def in_blocks(data: bytes) -> bytes:
    return b"".join(compressed(data[k : k + BLOCK_BYTES]) for k in range(0, len(data), BLOCK_BYTES))


def _written(folder: str, block_bytes: int):
    """For mapInArrow over sorted records (contig, pos, stop, line): one part, and where its records lie in it."""
    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("contig", pa.string()), ("bin", pa.int32()), ("window", pa.int64()), ("first", pa.int64()), ("upto", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = shared_files.attempt_name(folder, part)
        done, buffer, run, windows, rows = 0, bytearray(), None, {}, []
        with shared_files.created(name) as out:
            for batch in batches:
                for contig, pos, stop, line in zip(*(batch.column(c).to_pylist() for c in ("contig", "pos", "stop", "line"))):
                    at = done << 16 | len(buffer)
                    buffer += line.encode() + b"\n"
                    while len(buffer) >= block_bytes:
                        done += out.write(block := compressed(bytes(buffer[:block_bytes]))) or len(block)
                        del buffer[:block_bytes]
                    upto = done << 16 | len(buffer)
                    start = max(pos - 1, 0)
                    number = bin_number(start, stop)
                    if run and run[:2] == (contig, number):
                        run = (*run[:3], upto)
                    else:
                        rows += [run] if run else []
                        run = (contig, number, at, upto)
                    for w in range(start >> WINDOW_BITS, ((stop - 1) >> WINDOW_BITS) + 1):
                        windows.setdefault((contig, w), at)
            if buffer:
                done += out.write(block := compressed(bytes(buffer))) or len(block)
        rows += [run] if run else []
        listed = [(part, name, done, c, b, None, a, z) for c, b, a, z in rows] + [(part, name, done, c, None, w, a, None) for (c, w), a in windows.items()] or [(part, name, done, None, None, None, None, None)]
        for k in range(0, len(listed), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*listed[k : k + 10_000]), schema)], schema=schema)

    return write


def write_bgzf_vcf(records: DataFrame, path: str, header: str, parts: int | None = None, block_bytes: int = BLOCK_BYTES) -> int:
    """Write contig, pos, stop, line, in the order of contig, pos and then order (a column, if there is one), and path.tbi; returns the number of parts."""
    spark = records.sparkSession
    order = ["contig", "pos", *[c for c in records.columns if c == "order"]]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = storage.new_path(spark, "bgzf")
    dealt = records.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("contig", "pos", "stop", "line")
    places = dealt.mapInArrow(_written(folder, block_bytes), PLACES).orderBy("part", "first").collect()
    head = in_blocks(header.encode())
    storage.write_bytes(spark, f"{folder}/head", head)
    storage.write_bytes(spark, f"{folder}/tail", END_BLOCK)
    names = {r["part"]: (r["name"], r["size"]) for r in places}
    base, at = {}, len(head)
    for part in sorted(names):
        base[part] = at
        at += names[part][1]
    moved = lambda r, c: r[c] + (base[r["part"]] << 16)
    contigs = list(dict.fromkeys(r["contig"] for r in sorted(places, key=lambda r: (r["part"], r["first"] or 0)) if r["contig"] is not None))
    bins: dict = {c: defaultdict(list) for c in contigs}
    windows: dict = {c: {} for c in contigs}
    for r in places:
        if r["bin"] is not None:
            own = bins[r["contig"]][r["bin"]]
            if own and own[-1][1] == moved(r, "first"):
                own[-1] = (own[-1][0], moved(r, "upto"))
            else:
                own.append((moved(r, "first"), moved(r, "upto")))
        elif r["window"] is not None:
            own = windows[r["contig"]]
            own[r["window"]] = min(own.get(r["window"], 1 << 63), moved(r, "first"))
    filled = []
    for c in contigs:
        own, last = [], 0
        for w in range(max(windows[c], default=-1) + 1):
            # A window without records has the offset of the one before it.
            last = windows[c].get(w, last)
            own.append(last)
        filled.append(own)
    storage.concatenated(spark, {str(path): [f"{folder}/head", *[names[p][0] for p in sorted(names)], f"{folder}/tail"]})
    storage.write_bytes(spark, f"{path}.tbi", in_blocks(Index(contigs, [bins[c] for c in contigs], filled).content()) + END_BLOCK)
    storage.remove(spark, folder)
    return len(names)
