"""Exact Jaccard similarity join of documents on word shingles, in metric regions.

The Jaccard distance is a metric, but nearly every two documents are at distance 1 exactly, so document pivots drawn
from the whole corpus would put everything on every border. The first cut is therefore by size and by parts of the
sets. Sizes fall into levels; a document is replicated into every larger level whose least size is within the threshold of its own. On
a level whose largest size is m, two sets within the threshold t differ in k = floor(2 m (1 - t) / (1 + t)) elements
at most, so when a hash deals the elements to k + slack parts, they agree on slack parts at least. A part's content is
a pivot: the documents that hold exactly it form its region, and whoever is within the threshold shares a region.
Empty parts count only for sets that have slack of them or more, which alone could agree on nothing else.

Regions are found by range-partitioned, sorted streams over (part, document), one for each of DEALS ranges of the parts' hashes and one after the
other, so that the disk holds the shuffles of one range at a time: a region of any size is streamed, and
one that reaches over several partitions is put together from the first documents of its pieces. Texts
with passages in common can share a region by chance, so the documents of a region are compared by sketches first. A sketch
counts a set's elements in hash buckets, a few in each; the sum of differences of two sketches is no more than that of the
sets, so pairs it puts too far apart are no links. What is left of the regions makes clusters.

A cluster of one block is joined in a task. A larger one is divided by document pivots, with the work spread over its blocks: PIVOTS of
its documents, and the set of what most of these have in common. Documents near enough to one pivot are one
component, whether they are linked with it or, by the triangle inequality, with each other; so a group of thousands of near copies takes a
number of distances in proportion to its size. All others belong to the Voronoi region of their nearest pivot and, again by the triangle
inequality, to every one whose pivot is less than twice the threshold's distance farther; of the near documents those come with them that
can link with one of them. Regions are divided again, up to ROUNDS times, until they are a block; where pivots do not divide a region, its blocks are
compared in pairs, by sketches and then exactly. Within tasks, document pivots make Voronoi regions in the same way, recursively, with exact intersections
at the leaves. A task returns the edges of a spanning forest of its links, never its pairs.

Defined results: a null or empty text, or one of separators only, has no shingles and links with nothing; with fewer
words than width the whole sequence is one shingle; rows that share an id are one document in the components, each
with its own n_shingles; a row without id links with nothing and has no component; an empty table gives no rows; only
id_col and text_col are read, so extra columns cannot clash. Ids are integers.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import broadcast_if_small, release, remove, shuffle_partitions, stored, table, written
from helixlake.llm.components import components
from helixlake.llm.textvec import mix, shingles, slices, words

RATIO, LIST_ROWS = 1.3, 256
PIVOTS, ROUNDS = 15, 3
#: Ranges of the parts' hashes; a power of two.
DEALS = 4
PART_COLUMNS = [f"parts{k}" for k in range(DEALS)]
#: A block has at most this many shingles (16 MB), or one document.
BLOCK_SHINGLES = 1 << 21


def levels(upto: int) -> list[int]:
    """Least size of each level."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(np.ceil(RATIO * out[-1]))))
    return out


def parts_of(most: int, num: int, den: int) -> tuple[int, int]:
    """Parts on a level whose largest size is most, and how many of them two linked sets agree on at least.

    There are so many more parts than possible differences that a set seldom has as many empty ones as that surplus.
    """
    k = (den - num) * 2 * most // (den + num)
    if not k:
        return 1, 1
    slack = 4 + int(3 * k * np.exp(-most / RATIO / k))
    return k + slack, slack


def signatures(s: np.ndarray, num: int, den: int, bounds: list[int]) -> np.ndarray:
    """The part hashes of a set (sorted, distinct) on its level, and on every larger one whose least size is within the threshold of its own."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    home = int(np.searchsorted(bounds, n, side="right")) - 1
    out = []
    for level in range(home, len(bounds) - 1):
        if level > home and n * den < num * bounds[level]:
            break
        parts, slack = parts_of(bounds[level + 1] - 1, num, den)
        part = (((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)  # grows with s, so parts are runs
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums = np.add.reduceat(mix(s ^ np.uint64(0x5BD1E995)), begin)
        tag = mix(part[begin].astype(np.uint64) + np.uint64(level << 40) + np.uint64(1))
        out.append(mix(sums + tag))
        if parts - len(begin) >= slack:
            empty = np.setdiff1d(np.arange(parts), part[begin]).astype(np.uint64)
            out.append(mix(mix(empty + np.uint64(level << 40) + np.uint64(1)) + np.uint64(0x27D4EB2F)))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Counts, 255 at most, of the elements in 2^b buckets, three to six in each."""
    bits = max(3, int(len(s) // 6).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sketch_pairs(left: np.ndarray, right: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) whose sketches leave a link possible."""
    bits = np.array([len(x).bit_length() for x in sketches])
    found = []
    for b in np.unique(bits[left]):
        for c in np.unique(bits[right]):
            if abs(int(b) - int(c)) > 1 + int(np.log2(den / num)):
                continue
            width = 1 << (min(b, c) - 1)
            fold = lambda rows: np.minimum(np.stack([sketches[r].reshape(width, -1).sum(axis=1, dtype=np.int32) for r in rows]), 255).astype(np.int16)  # noqa: E731, B023
            i, j = left[bits[left] == b], right[bits[right] == c]
            x, y = fold(i), fold(j)
            for k, row in enumerate(x):
                near = np.abs(y - row).sum(axis=1, dtype=np.int64) * (den + num) <= (den - num) * (size[i[k]] + size[j])
                hits = j[near]
                hits = hits[hits != i[k]]
                found.append((np.full(len(hits), i[k]), hits))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _sets(batch: pa.RecordBatch, width: int):
    for part in slices(batch, "text"):
        yield part, shingles(words(part.column("text")), width)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _dealt(arrays: list[np.ndarray]) -> list[pa.Array]:
    """For each range of the hashes, the lists of those in it."""
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays])
    row = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    deal = (flat >> np.uint64(32)) * np.uint64(DEALS) >> np.uint64(32)
    out = []
    for k in range(DEALS):
        own = deal == k
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(arrays)))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[own].view(np.int64))))
    return out


def _described(width: int, num: int, den: int):
    """id, number of shingles, 128-bit hash of the set, part hashes in a column for each of their ranges, sketch."""
    def function(batches):
        for batch in batches:
            for part, sets in _sets(batch, width):
                bounds = levels(max([len(s) for s in sets], default=1) * den // num + 2)
                n = pa.array([len(s) for s in sets], pa.int64())
                h1 = pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
                h2 = pa.array(np.array([mix(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), n, h1, h2, *_dealt([signatures(s, num, den, bounds) for s in sets]), pa.array([sketch(s) for s in sets], pa.binary())],
                                                 names=["id", "n", "h1", "h2", *PART_COLUMNS, "sketch"])

    return function


def _regions(batches):
    """Over rows sorted by (part, id): the documents of each run of two or more.

    A run of up to LIST_ROWS documents inside the partition is a list: a row for each of its documents, key the hash of them all.
    Longer runs and those at the partition's ends are stars: the other documents with the first (centre), key 0; the ends are marked,
    whatever their length, since their runs may go on in the next partition.
    """
    held_p = held_i = np.zeros(0, np.int64)
    centre, part, star, first = None, None, False, True

    def rows(parts, keys, centres, ids, border=False):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(keys, pa.int64()), pa.array(centres), pa.array(ids), pa.array(np.full(n, border))], names=["part", "key", "centre", "id", "border"])

    def as_star(p, i, at):
        return rows(p, np.zeros(len(p), np.int64), np.full(len(p), at, i.dtype), i)

    def mark(at_part, at):
        return rows(np.array([at_part]), np.array([0]), np.array([at]), np.array([at]), True)

    for batch in batches:
        if not batch.num_rows:
            continue
        p, i = batch.column("part").to_numpy(), batch.column("id").to_numpy()
        if star:  # the run goes on
            n = int(np.searchsorted(p, part, side="right"))
            more = i[:n] != centre
            if more.any():
                yield as_star(p[:n][more], i[:n][more], centre)
            p, i = p[n:], i[n:]
            if not len(p):
                continue
            star = first = False
        elif len(held_p):
            p, i = np.concatenate([held_p, p]), np.concatenate([held_i, i])
        begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(begin, len(p)))
        if first and len(begin) > 1:
            yield mark(p[0], i[0])
            if size[0] > 1:
                yield as_star(p[1 : size[0]], i[1 : size[0]], i[0])
        lo = 1 if first and len(begin) > 1 else 0
        inner = np.arange(len(begin))
        inner = (inner >= lo) & (inner < len(begin) - 1) & (size > 1)
        first = first and len(begin) == 1
        short = inner & (size <= LIST_ROWS)
        if short.any():
            take = np.repeat(short, size)
            key = (mix(np.add.reduceat(mix(i.astype(np.uint64)), begin)) | np.uint64(1)).view(np.int64)
            yield rows(p[take], np.repeat(key, size)[take], np.repeat(i[begin], size)[take], i[take])
        for k in np.flatnonzero(inner & ~short).tolist():
            yield as_star(p[begin[k] + 1 : begin[k] + size[k]], i[begin[k] + 1 : begin[k] + size[k]], i[begin[k]])
        held_p, held_i = p[begin[-1] :], i[begin[-1] :]
        part, centre = held_p[0], held_i[0]
        if len(held_p) > LIST_ROWS:
            if first:
                yield mark(part, centre)
            yield as_star(held_p[1:], held_i[1:], centre)
            held_p = held_i = held_p[:0]
            star = True
    if part is not None:
        yield mark(part, centre)
        if len(held_i) > 1 and not star:
            yield as_star(held_p[1:], held_i[1:], centre)


def _regions_of(classes: DataFrame, kind: str) -> DataFrame:
    """The regions of the parts of classes (id, parts), of one range of the parts. The shuffles of the range before are dropped first."""
    spark = classes.sparkSession
    release(spark)
    deals = -(-2 * shuffle_partitions(spark) // DEALS)
    order = classes.select(F.explode("parts").alias("part"), "id").repartitionByRange(deals, "part", "id").sortWithinPartitions("part", "id")
    return order.mapInArrow(_regions, f"part long, key long, centre {kind}, id {kind}, border boolean")


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the elements that more than one set holds."""
    every = [*left, *right]
    values, place, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    use = shared[place]
    row, col = row[use], number[place[use]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = int(shared.sum())
    for begin in range(0, total, columns):
        lo, hi = np.searchsorted(col, [begin, begin + columns])
        m = np.zeros((len(every), min(columns, total - begin)), np.float32)
        m[row[lo:hi], col[lo:hi] - begin] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def metric_join(sets: list[np.ndarray], num: int, den: int, leaf: int = 64, pivots: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets within the threshold; some may come twice."""
    size = np.array([len(s) for s in sets], np.int64)
    reach = 1 - num / den
    rng = np.random.default_rng(len(sets))
    found = []

    def inside(a: np.ndarray, b: np.ndarray) -> None:
        both = intersections([sets[i] for i in a], [sets[j] for j in b]).astype(np.int64)
        union = size[a][:, None] + size[b][None, :] - both
        i, j = np.nonzero((den * both >= num * union) & (both > 0) & (a[:, None] < b[None, :]))
        found.append((a[i], b[j]))

    def join(rows: np.ndarray, depth: int) -> None:
        if len(rows) < 2:
            return
        if len(rows) > leaf and depth < 6:
            chosen = rng.choice(rows, pivots, replace=False)
            both = intersections([sets[i] for i in rows], [sets[j] for j in chosen])
            d = 1 - both / np.maximum(1, size[rows][:, None] + size[chosen][None, :] - both)
            regions = [rows[d[:, k] <= d.min(axis=1) + 2 * reach + 1e-6] for k in range(pivots)]
            if sum(len(r) for r in regions) < 2 * len(rows) or sum(len(r) ** 2 for r in regions) < len(rows) ** 2 / 2:
                for r in regions:
                    join(r, depth + 1)
                return
        rows = np.sort(rows)
        for a in range(0, len(rows), leaf):
            for b in range(a, len(rows), leaf):
                inside(rows[a : a + leaf], rows[b : b + leaf])

    join(np.arange(len(sets)), 0)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def smallest_linked(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that have a link, and for each the smallest id it is connected with."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    linked = np.unique(np.concatenate([i, j]))
    return ids[linked], ids[order[label[linked]]]


def cross_links(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], core: np.ndarray, num: int, den: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (i of left, j of right) of which not both are core."""
    size = np.array([len(s) for s in sets], np.int64)
    i, j = sketch_pairs(left, right, size, [np.frombuffer(sketch(s), np.uint8) for s in sets], num, den)
    open_ = ~(core[i] & core[j])
    i, j = i[open_], j[open_]
    found = [(i[:0], j[:0])]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
    for lo in range(0, len(begin), rows):
        upto = begin[lo + rows] if lo + rows < len(begin) else len(i)
        a, b = np.unique(i[begin[lo] : upto]), np.unique(j[begin[lo] : upto])
        both = intersections([sets[r] for r in a], [sets[r] for r in b]).astype(np.int64)
        linked = (den * both >= num * (size[a][:, None] + size[b][None, :] - both)) & (both > 0)
        x, y = np.nonzero(linked)
        found.append((a[x], b[y]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _arrays(column) -> list[np.ndarray]:
    """The sets of an Arrow column of lists."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def pivot_distances(num: int, den: int):
    """Of the rows of one piece of a region (id, key, set, pivot): a row for each document and each pivot it is near to or whose region it is in.

    The set that most pivots have in common is a pivot too, the last one. Near (core) are documents linked with a pivot, and those within half the
    threshold's distance of the common set, which are so linked with each other.
    """
    reach = 1 - num / den

    def measure(group):
        region, pivot, ids = group.column("region")[0], group.column("pivot").to_numpy(zero_copy_only=False).astype(bool), group.column("id").to_numpy()
        sets = _arrays(group.column("set"))
        at = np.flatnonzero(pivot)
        keys = group.column("key").to_numpy()
        chosen = [sets[k] for k in at[np.lexsort((keys[at], ids[at]))]]  # in the same order in every piece
        values, times = np.unique(np.concatenate(chosen), return_counts=True)
        common = values[2 * times > len(chosen)]
        half = np.zeros(len(chosen) + (len(common) > 0), bool)
        if len(common):
            chosen.append(common)
            half[-1] = True
        rows = np.flatnonzero(~pivot)
        size, other = np.array([len(sets[k]) for k in rows], np.int64), np.array([len(c) for c in chosen], np.int64)
        both = np.vstack([intersections([sets[k] for k in rows[lo : lo + 128]], chosen) for lo in range(0, len(rows), 128)]).astype(np.int64) if len(rows) else np.zeros((0, len(chosen)), np.int64)
        union = size[:, None] + other[None, :] - both
        apart = den * (union - both)
        near = np.where(half[None, :], 2 * apart <= (den - num) * union, apart <= (den - num) * union)
        d = 1 - both / np.maximum(1, union)
        i, k = np.nonzero(near | (d <= d.min(axis=1, keepdims=True) + 2 * reach + 1e-9))
        return pa.table({"region": pa.array([region.as_py()] * len(i), pa.int64()), "pivot": pa.array(k.astype(np.int32)), "id": ids[rows[i]], "key": keys[rows[i]], "core": near[i, k], "d": d[i, k]})

    return measure


def divide(large: DataFrame, sets: DataFrame, num: int, den: int, block_rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """From (region, id, key) of regions larger than a block, and (id, key, n, set): edges (u, v), and tables (region, id, key, core) of what is
    left to compare, where those whose core is set hang together already."""
    kind = large.schema["id"].dataType.simpleString()
    reach = 1 - num / den
    edges, leaves = [], []
    for round_ in range(ROUNDS):
        if large.isEmpty():
            break
        rows = stored(large.join(sets, ["id", "key"]).select("region", "id", "key", "n", "set"), "pivot-rows")
        sizes = broadcast_if_small(stored(with_blocks(rows, block_rows), "pivot-sizes"))
        draw = F.xxhash64(F.lit(round_), "id", "key")
        one = rows.groupBy("region", F.pmod(draw, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(draw.alias("draw"), F.col("id"), F.col("key"))).alias("p"))
        pivots = one.select("region", "p.id", "p.key").join(rows.select("region", "id", "key", "set"), ["region", "id", "key"]).join(sizes.select("region", "blocks"), "region")
        pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("piece"), "id", "key", "set", F.lit(True).alias("pivot"))
        members = rows.join(sizes.select("region", "blocks"), "region").select("region", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("piece"), "id", "key", "set", F.lit(False).alias("pivot"))
        measured = members.unionByName(pivots).groupBy("region", "piece").applyInArrow(pivot_distances(num, den), f"region long, pivot int, id {kind}, key long, core boolean, d double")
        measured = stored(measured, "pivot-distances")
        by = broadcast_if_small(stored(measured.groupBy("region", "pivot").agg(F.min(F.when(F.col("core"), F.col("id"))).alias("centre"), F.count_if("core").alias("cores"), F.min(F.when(~F.col("core"), F.col("d"))).alias("least")), "pivot-sums"))
        edges.append(measured.where("core").join(by, ["region", "pivot"]).select(F.col("id").alias("u"), F.col("centre").alias("v")))
        # A core document links with none of the others that is more than the threshold's distance farther from the pivot.
        parts = measured.join(by, ["region", "pivot"]).where(~F.col("core") | (F.col("d") >= F.col("least") - reach - 1e-9))
        own = ["region", "id", "key"]
        grown = parts.groupBy("region").agg(F.count(F.lit(1)).alias("rows_")).join(sizes.select("region", "size"), "region")
        whole = stored(grown.where("rows_ > 1.5 * size").select("region"), "pivot-whole")
        if not whole.isEmpty():
            whole = broadcast_if_small(whole)
            best = by.join(whole, "region", "left_semi").groupBy("region").agg(F.max_by(F.struct("pivot", "least"), F.struct("cores", -F.col("pivot"))).alias("b")).select("region", "b.*")
            cores = measured.where("core").join(broadcast_if_small(best), ["region", "pivot"])
            others = rows.join(whole, "region", "left_semi").select(own).join(cores.select(own), own, "left_anti")
            # Documents that have no row for the pivot are at least twice the threshold's distance away.
            close = cores.where(F.col("d") >= F.least(F.coalesce("least", F.lit(2 * reach)), F.lit(2 * reach)) - reach - 1e-9)
            leaves.append(others.withColumn("core", F.lit(False)).unionByName(close.select(*own, "core")))
            parts = parts.join(whole, "region", "left_anti")
        apart = stored(parts.select(F.xxhash64("region", "pivot").alias("region"), "id", "key", "core").join(sets.select("id", "key", "n"), ["id", "key"]), "pivot-parts")
        again = broadcast_if_small(stored(with_blocks(apart, block_rows).where("blocks > 1").select("region"), "pivot-again"))
        leaves.append(apart.drop("n").join(again, "region", "left_anti"))
        large = apart.drop("n").join(again, "region", "left_semi")
        if round_ == ROUNDS - 1:
            leaves.append(large)
        large = large.select(own)
    return edges, leaves


def with_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """region, size, total (shingles) and blocks from (region, n)."""
    by = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    return by.select("region", "size", "total", F.greatest(F.ceil(F.col("size") / block_rows), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def whole_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """id, key, n, set of classes (id, n, h1, h2); key tells the sets of an id apart, where its rows have several."""
    kind = docs.schema["id"].dataType.simpleString()

    def function(batches):
        for batch in batches:
            for part, sets in _sets(batch, width):
                h1, h2 = (pa.array(np.array([mix(s + np.uint64(k)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for k in (0, 77))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), h1, h2, _lists(sets)], names=["id", "n", "h1", "h2", "set"])

    found = docs.join(broadcast_if_small(classes), "id", "left_semi").mapInArrow(function, f"id {kind}, n long, h1 long, h2 long, set array<long>")
    return found.join(classes, ["id", "n", "h1", "h2"], "left_semi").groupBy("id", "n", F.col("h1").alias("key"), "h2").agg(F.first("set").alias("set")).drop("h2")


def compared(left: DataFrame, sets: DataFrame, num: int, den: int, block_rows: int) -> DataFrame:
    """Edges (u, v) from (region, id, key, core): small regions are gathered in buckets, large ones compared in pairs of blocks."""
    kind = left.schema["id"].dataType.simpleString()
    rows = left.join(sets, ["id", "key"])
    sizes = stored(with_blocks(left.join(sets.select("id", "key", "n"), ["id", "key"]), block_rows).where("size > 1"), "shingle-sizes")
    small = sizes.where("blocks <= 1").agg(F.sum("size"), F.sum("total")).first()
    buckets = max(1, -(-(small[0] or 0) // block_rows), -(-(small[1] or 0) // BLOCK_SHINGLES))
    spread = rows.join(broadcast_if_small(sizes.select("region", "blocks")), "region").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("gathered", F.col("blocks") == 1)
    spread = spread.select("gathered", F.when(F.col("gathered"), F.pmod(F.col("region"), F.lit(buckets))).otherwise(F.col("region")).alias("bucket"),
                           F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "region", "block", "id", "core", "set")

    def compare(key, group):
        lo, hi = key[2].as_py(), key[3].as_py()
        region, ids, block, core = (group.column(c).to_numpy(zero_copy_only=False) for c in ("region", "id", "block", "core"))
        core, sets_ = core.astype(bool), _arrays(group.column("set"))
        out = []
        order = np.argsort(region, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
            if core[rows].all():
                continue
            own = [sets_[r] for r in rows]
            if lo == hi:
                i, j = metric_join(own, num, den)
            else:
                i, j = cross_links(np.flatnonzero(block[rows] == lo), np.flatnonzero(block[rows] == hi), own, core[rows], num, den)
            if len(i):
                out.append(smallest_linked(ids[rows], i, j))
        u, v = (np.concatenate(x) for x in zip(*out)) if out else (ids[:0], ids[:0])
        return pa.table({"u": u, "v": v})

    return spread.groupBy("gathered", "bucket", "lo", "hi").applyInArrow(compare, f"u {kind}, v {kind}")


def similar_documents(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, block_rows: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row; documents link when den * intersection >= num * union."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{c} array<long>" for c in PART_COLUMNS)
    described, at = written(docs.mapInArrow(_described(width, num, den), f"id {kind}, n long, h1 long, h2 long, {columns}, sketch binary"), "shingle-parts")

    # Equal sets are one node, named by their smallest id.
    by_set, least = described.where("n > 0 and id is not null").groupBy("n", "h1", "h2"), F.min("id").alias("id")
    found = [written(_regions_of(by_set.agg(least, F.first(c).alias("parts")), kind), "shingle-regions") for c in PART_COLUMNS]
    stars = functools.reduce(DataFrame.unionByName, [rows for rows, _ in found])
    # The parts are in the regions now.
    classes = stored(by_set.agg(least), "shingle-classes")
    described = stored(described.drop(*PART_COLUMNS), "shingle-facts")
    remove(spark, at)
    release(spark)
    border = stars.where("border").select("part", "centre").distinct()
    joint = border.groupBy("part").agg(F.min("centre").alias("first"), F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    pieces = border.join(joint, "part").where("centre <> first").select("part", F.col("first").alias("centre"), F.col("centre").alias("id"))
    members = stars.where("not border and key = 0").select("part", "centre", "id").unionByName(pieces)
    # A region of several pieces has one pivot: the first of the first piece.
    members = members.join(joint.select("part", "first"), "part", "left").select("part", F.coalesce("first", "centre").alias("centre"), "id").distinct()
    # Many parts have the same documents; each list of documents is looked at once.
    lists = stored(stars.where("key <> 0").select("key", "id").distinct(), "shingle-lists")
    drawn = described.select("id", "n", "sketch").distinct()
    # Several buckets a partition, so that chance does not deal one partition a large share of them.
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(4 * shuffle_partitions(spark), -(-lists.count() // 1024))))

    def close_in_lists(group):
        key, ids, size = (group.column(c).to_numpy() for c in ("key", "id", "n"))
        sketches = [np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()]
        order = np.argsort(key, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            i, j = sketch_pairs(at, at, size, sketches, num, den)
            if len(i):
                place = np.full(len(ids), -1)
                place[at] = np.arange(len(at))
                out.append(smallest_linked(ids[at], place[i], place[j]))
        u, v = (np.concatenate(x) for x in zip(*out)) if out else (ids[:0], ids[:0])
        return pa.table({"u": u, "v": v})

    near_lists = lists.join(drawn, "id").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(close_in_lists, f"u {kind}, v {kind}")
    edges = members.select(F.col("centre").alias("u"), F.col("id").alias("v")).unionByName(near_lists)
    clusters = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    known = classes.select("id", "n", "h1", "h2")
    clusters = clusters.join(known, "id").select(F.xxhash64("cluster").alias("region"), "id", F.col("h1").alias("key"), "n", "h2")
    clusters = stored(clusters, "shingle-clusters")
    for _, stars_at in found:
        remove(spark, stars_at)
    release(spark)
    many = broadcast_if_small(stored(with_blocks(clusters, block_rows).where("blocks > 1").select("region"), "shingle-large"))
    sets = stored(whole_sets(docs, clusters.select("id", "n", F.col("key").alias("h1"), "h2"), width), "shingle-sets")
    clusters = clusters.select("region", "id", "key")
    large = clusters.join(many, "region", "left_semi")
    edges, leaves = divide(large, sets, num, den, block_rows)
    left = clusters.join(many, "region", "left_anti").withColumn("core", F.lit(False))
    for leaf in leaves:
        left = left.unionByName(leaf)
    links = [e.select("u", "v") for e in [*edges, compared(left, sets, num, den, block_rows)]]
    joined = components(functools.reduce(DataFrame.unionByName, links))
    release(spark)

    nodes = classes.select("n", "h1", "h2", F.col("id").alias("rep")).join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = described.select("id", "n", "h1", "h2").join(nodes, ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_jaccard_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS k) AS u WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n AS nx ON x = nx.doc_id JOIN n AS ny ON y = ny.doc_id WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS root FROM n UNION SELECT links.y, reach.root FROM reach JOIN links ON reach.x = links.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(root), d.doc_id) AS component_id FROM documents AS d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN reach ON d.doc_id = reach.x GROUP BY d.doc_id
"""
