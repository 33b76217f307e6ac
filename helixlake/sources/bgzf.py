"""VCF text in blocked gzip (BGZF), read in parallel, and through its index only where it is needed.

A BGZF file is a chain of small gzip members, each with its size in its header, so a task can begin at any of them: partitions are runs of blocks. The index
beside the file (.tbi) names, for each contig and each hierarchical bin, the pieces of the file that hold the bin's records. With regions
given, only the blocks of the bins that they meet are read.

    spark.read.format("bgzf_vcf").option("regions", '[["c", 1000, 2000]]').load(path)

Regions are an option of the read and not filters pushed down into it: Spark 4.1 keeps what a Python source answered to the last filters with the
relation, so a second query of the same DataFrame, with other filters or none, would read the first one's partitions.
Columns: contig, pos, stop (end of the interval, as a half-open one from 0), line, and file_order, the line's virtual offset (offset of the block, shifted by 16
bits, and place in it). Options: index (path; else path + '.tbi'), splitBytes (compressed bytes of a partition), regions (JSON: [[contig, start, stop], ...]).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixlake import shared_files
from helixlake.functions.bins import WINDOW_BITS, bins_over

#: What a block begins with, the field that holds its size, the block that ends a file, the largest content of a block.
MAGIC = b"\x1f\x8b\x08\x04"
SIZE_FIELD = b"BC\x02\x00"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES, HEADER_BYTES = 65_280, 18
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 18
LINES = "contig string, pos long, stop long, line string, file_order long"


def compressed(data: bytes) -> bytes:
    """One block of at most BLOCK_BYTES bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + SIZE_FIELD + struct.pack("<H", len(body) + HEADER_BYTES + 7)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with head, or None where none begins."""
    if len(head) < HEADER_BYTES or not head.startswith(MAGIC):
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    at = extra.find(SIZE_FIELD)
    return struct.unpack_from("<H", extra, at + 4)[0] + 1 if 0 <= at <= len(extra) - 6 else None


def blocks(file: pa.NativeFile, at: int):
    """(offset, content, size) of each block from the one at offset at."""
    file.seek(at)
    held = b""
    while True:
        if len(held) < 1 << 16:
            held += file.read(READ_BYTES)
        if not held:
            return
        size = block_size(held[: 1 << 16])
        if size is None or len(held) < size:
            raise ValueError(f"no whole block at {at}: the file is no BGZF, or damaged")
        begin = 12 + struct.unpack_from("<H", held, 10)[0]
        content = zlib.decompress(held[begin : size - 8], -15)
        if zlib.crc32(content) != struct.unpack_from("<I", held, size - 8)[0]:
            raise ValueError(f"the block at {at} is damaged")
        yield at, content, size
        held = held[size:]
        at += size


def first_block(file: pa.NativeFile, at: int, size: int) -> int:
    """Offset of the first block that begins at or after at; the file's size if there is none."""
    if at <= 0:
        return 0
    while at < size:
        file.seek(at)
        data = file.read((1 << 17) + HEADER_BYTES)
        k = data.find(MAGIC)
        while k >= 0:
            n = block_size(data[k : k + 64])
            after = data[k + n : k + n + 4] if n else None
            if n and at + k + n <= size and (after == MAGIC[: len(after)] if k + n < len(data) else at + k + n == size):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += 1 << 17
    return size


def text_lines(file: pa.NativeFile, start: int):
    """(virtual offset, bytes) of each line from a virtual offset on."""
    skip, rest, rest_at = start & 0xFFFF, b"", 0
    for at, data, _ in blocks(file, start >> 16):
        k, skip = skip, 0
        while (end := data.find(b"\n", k)) >= 0:
            yield (rest_at, rest + data[k:end]) if rest else (at << 16 | k, data[k:end])
            rest, k = b"", end + 1
        if k < len(data):
            rest_at = rest_at if rest else at << 16 | k
            rest += data[k:]
    if rest:
        yield rest_at, rest


def header_lines(path: str) -> list[str]:
    """The lines before the first record."""
    out = []
    with shared_files.opened(path) as file:
        for _, line in text_lines(file, 0):
            if not line.startswith(b"#"):
                break
            out.append(line.decode())
    return out


# --- the index --------------------------------------------------------------------------------------------------------


class Index:
    """names; for each contig its bins' chunks (pairs of virtual offsets) and the first offset of each window of 2^14 positions."""

    def __init__(self, names: list[str], bins: list[dict[int, list[tuple[int, int]]]], windows: list[list[int]]):
        self.names, self.bins, self.windows = names, bins, windows

    @classmethod
    def read(cls, path: str) -> Index:
        with shared_files.opened(path) as file:
            data = b"".join(content for _, content, _ in blocks(file, 0))
        if data[:4] != b"TBI\x01":
            raise ValueError(f"{path} is no index of this kind")
        count, *_, name_bytes = struct.unpack_from("<8i", data, 4)
        names = data[36 : 36 + name_bytes].decode().split("\0")[:count]
        at, bins, windows = 36 + name_bytes, [], []
        for _ in range(count):
            own: dict[int, list[tuple[int, int]]] = {}
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
                own[number] = list(zip(flat[::2], flat[1::2]))
                at += 8 + 16 * chunks
            (n,) = struct.unpack_from("<i", data, at)
            windows.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            bins.append(own)
            at += 4 + 8 * n
        return cls(names, bins, windows)

    def content(self) -> bytes:
        """What the index's file holds, uncompressed: for VCF, with contig and position in the first two columns."""
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [b"TBI\x01", struct.pack("<8i", len(self.names), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
        for own, windows in zip(self.bins, self.windows):
            out.append(struct.pack("<i", len(own)))
            for number in sorted(own):
                out.append(struct.pack("<Ii", number, len(own[number])) + b"".join(struct.pack("<QQ", *c) for c in own[number]))
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        return b"".join(out)

    def chunks(self, contig: str, start: int, stop: int) -> list[tuple[int, int]]:
        """Pieces of the file that hold all records of a contig which overlap an interval."""
        if contig not in self.names or stop <= start:
            return []
        k = self.names.index(contig)
        first = self.windows[k][min(start >> WINDOW_BITS, len(self.windows[k]) - 1)] if self.windows[k] else 0
        wanted = bins_over(start, stop)
        found = [c for number, own in self.bins[k].items() if any(number in r for r in wanted) for c in own]
        return sorted((max(a, first), b) for a, b in found if b > first)


def merged(chunks: list[tuple[int, int]], size: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Disjoint chunks in order; neighbours that share a block are joined until they have about size compressed bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        a = max(a, out[-1][1]) if out else a
        if b <= a:
            continue
        if out and a >> 16 == out[-1][1] >> 16 and (out[-1][1] >> 16) - (out[-1][0] >> 16) < size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def divided(chunks: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Disjoint chunks in runs of about size compressed bytes."""
    out, held, weight = [], [], 0
    for a, b in chunks:
        held.append((a, b))
        weight += (b >> 16) - (a >> 16) + 1
        if weight >= size:
            out.append(held)
            held, weight = [], 0
    return [*out, held] if held else out


# --- the data source --------------------------------------------------------------------------------------------------


@dataclass
class Blocks(InputPartition):
    """A range of compressed bytes (chunks is None), or chunks of the index."""

    first: int = 0
    upto: int = 0
    chunks: list | None = None

    def __init__(self, first: int = 0, upto: int = 0, chunks: list | None = None):
        super().__init__((first, upto, chunks))
        self.first, self.upto, self.chunks = first, upto, chunks


_END = re.compile(rb"(?:^|;)END=([0-9]+)")


def fields(line: bytes) -> tuple[str, int, int] | None:
    """contig, pos and stop of a record; None for a line that is none."""
    if line.startswith(b"#"):
        return None
    f = line.rstrip(b"\r").split(b"\t", 8)
    if len(f) < 8 or not f[1].isdigit():
        return None
    pos = int(f[1])
    end = _END.search(f[7])
    return f[0].decode(), pos, max(int(end[1]) if end else pos - 1 + len(f[3]), pos)


class Regions:
    """Intervals by contig, in order and disjoint; None: everything."""

    def __init__(self, listed: list | None):
        self.by_contig: dict[str, list[tuple[int, int]]] | None = None
        if listed is not None:
            self.by_contig = defaultdict(list)
            for contig, start, stop in sorted(map(tuple, listed)):
                own = self.by_contig[contig]
                if own and start <= own[-1][1]:
                    own[-1] = (own[-1][0], max(stop, own[-1][1]))
                else:
                    own.append((start, stop))

    def meet(self, contig: str, pos: int, stop: int) -> bool:
        if self.by_contig is None:
            return True
        own = self.by_contig.get(contig, ())
        # The last interval that begins before stop; earlier ones end before it begins.
        k = bisect_left(own, (stop,)) - 1
        return k >= 0 and own[k][1] > pos - 1


class VcfBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf_vcf"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return VcfBlocksReader(dict(self.options))


class VcfBlocksReader(DataSourceReader):
    def __init__(self, options: dict):
        named = {k.lower(): v for k, v in options.items()}
        self.path, self.index = named["path"], named.get("index", f"{named['path']}.tbi")
        self.split = int(named.get("splitbytes", SPLIT_BYTES))
        self.regions = Regions(json.loads(named["regions"]) if "regions" in named else None)

    def partitions(self) -> list[Blocks]:
        if self.regions.by_contig is not None and shared_files.exists(self.index):
            index = Index.read(self.index)
            wanted = merged([c for contig, own in self.regions.by_contig.items() for a, b in own for c in index.chunks(contig, a, b)], self.split)
            # An empty scan needs a partition all the same.
            return [Blocks(chunks=run) for run in divided(wanted, self.split)] or [Blocks(chunks=[])]
        size = shared_files.size_of(self.path)
        return [Blocks(a, min(a + self.split, size)) for a in range(0, size, self.split)] or [Blocks(chunks=[])]

    def _lines(self, part: Blocks):
        with shared_files.opened(self.path) as file:
            if part.chunks is not None:
                for a, b in part.chunks:
                    for at, line in text_lines(file, a):
                        if at >= b:
                            break
                        yield at, line
                return
            size = shared_files.size_of(self.path)
            first, upto = first_block(file, part.first, size), first_block(file, part.upto, size)
            if first >= size:
                return
            # A line belongs to the range in which it begins; one that begins with a block, to the range before that block.
            lines = text_lines(file, first << 16)
            if first:
                next(lines, None)
            for at, line in lines:
                if at > upto << 16:
                    return
                yield at, line

    def read(self, partition: Blocks):
        schema = pa.schema([("contig", pa.string()), ("pos", pa.int64()), ("stop", pa.int64()), ("line", pa.string()), ("file_order", pa.int64())])
        rows: list[tuple] = []
        for at, line in self._lines(partition):
            found = fields(line)
            if found and self.regions.meet(*found):
                rows.append((*found, line.decode("utf-8", "replace"), at))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_blocks(spark: SparkSession, path: str, regions: list | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records' lines (LINES); regions: (contig, start, stop), half-open intervals from 0 of which records overlap one; a bounded list, since it is part of the plan."""
    spark.dataSource.register(VcfBlocks)
    reader = spark.read.format("bgzf_vcf").option("splitBytes", split_bytes)
    if regions is not None:
        reader = reader.option("regions", json.dumps([list(r) for r in regions]))
    return reader.load(str(path))
