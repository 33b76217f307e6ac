"""Near-duplicate embeddings: every link, found over blocks of cells whose angles leave one possible.

Equal vectors become one class with a multiplicity. Centroids are fitted by spherical k-means to sample_rows classes
taken by a hash; every class belongs to its nearest cell and there to a ring by its angle to the centre. By the triangle inequality
of angles, the angle between two centres and the rings' least and greatest angles bound the angle of any two members
from below: two rings are compared unless that bound excludes a link, so no link is missed. Rings are cut into blocks
of about block_rows, each packed into one row; a task takes a block and up to CHUNK blocks that it may link with. Products are
taken in single precision with room for its error, and what they leave is decided in double precision. A pair of blocks
returns a count for each vector and the edges of a spanning forest, never its pairs. Components then join the edges, and
the smallest id of each is kept.

Where vectors are clustered, most rings exclude each other. Where they are spread evenly in many dimensions no bound excludes
anything, and the products grow with the square of the rows; README has figures.

Defined results: a vector that is null, empty, zero, or has null or non-finite components, or has no id, links with
nothing; vectors of different lengths do not link; repeated rows are separate vectors that link with each other; an
empty table gives no rows; only id_col and vector_col are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import stored, table
from helixlake.llm.components import components
from helixlake.llm.vectors import is_valid, keyed, matrix

CELL_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 8192, 8192, 16_384
#: Rings have this width in radians; RINGS covers all angles. A task compares a block with at most CHUNK others.
RING, RINGS, CHUNK = 0.25, 13, 8
#: More than the error of an angle, in radians.
ANGLE_SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def may_link(between: np.ndarray, lo: float, hi: float, los: np.ndarray, his: np.ndarray, threshold: float) -> np.ndarray:
    """Whether members at angles lo to hi of one centre can link with members at los to his of centres at the angles between."""
    least = np.maximum(between - hi - his, np.maximum(lo - between - his, los - between - hi))
    return least <= np.arccos(np.clip(threshold, -1, 1)) + ANGLE_SLACK


#: Far more than two ways of summing a product of unit vectors can differ by.
CLOSE = 1e-9


def block_links(a: np.ndarray, b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray, same: bool, threshold: float, rows: int = 256):
    """Of unit rows a and b (the same block where same is set): numbers of those that link, their links, and a number linked with each, the same
    for all that hang together. Rows of b are numbered after those of a."""
    n, off = len(a), 0 if same else len(a)
    total = n + (0 if same else len(b))
    count, label, linked = np.zeros(total, np.int64), np.arange(total), np.zeros(total, bool)
    single_a, single_b = a.astype(np.float32), b.astype(np.float32)
    room = (a.shape[1] + 8) * 2.0**-23
    for begin in range(0, n, rows):
        first = begin if same else 0
        i, j = np.nonzero(single_a[begin : begin + rows] @ single_b[first:].T >= threshold - room)
        if not len(i):
            continue
        if len(i) > 16 * rows:
            # A matrix product rounds in its own way: what is close to the threshold is decided as everywhere else.
            exact = (a[begin : begin + rows] @ b[first:].T)[i, j]
            close = np.flatnonzero(np.abs(exact - threshold) < CLOSE)
            exact[close] = np.einsum("ij,ij->i", a[begin + i[close]], b[first + j[close]])
        else:
            exact = np.einsum("ij,ij->i", a[begin + i], b[first + j])
        i, j = begin + i, first + j
        keep = (exact >= threshold) & (i < j if same else True)
        i, j = i[keep], j[keep]
        count += np.bincount(i, weights=copies_b[j], minlength=total).astype(np.int64)
        count += np.bincount(j + off, weights=copies_a[i], minlength=total).astype(np.int64)
        linked[i] = linked[j + off] = True
        pairs = np.unique(label[i] * total + label[j + off])
        i, j = pairs // total, pairs % total
        root = np.arange(total)
        while True:  # the smallest number spreads over the links of this run, with pointer jumping
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        label = root[label]
    at = np.flatnonzero(linked)
    return at, count[at], label[at]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
                    sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    rows = keyed(vectors, id_col, vector_col)
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = stored(classes, "vector-classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = {}
    base = 0
    for d, n in sorted(sizes.items()):
        sample = classes.where(F.size("vector") == d).orderBy(F.xxhash64(F.lit(9), "h1", "h2")).limit(sample_rows).select("vector").toArrow()  # bounded
        x = unit(matrix(sample.column("vector")))
        k = max(1, min(-(-n // cell_rows), len(x) // 8))
        centres[d] = (base, spherical_kmeans(x, k))
        base += k
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            length = np.diff(batch.column("vector").offsets.to_numpy())
            ring, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                first, c = shared.value[int(d)]
                dots = unit(matrix(batch.column("vector").take(pa.array(at)))) @ c.T
                near = dots.argmax(axis=1)
                angle[at] = np.arccos(np.clip(dots[np.arange(len(at)), near], -1, 1))
                ring[at] = (first + near) * RINGS + (angle[at] / RING).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "vector")), pa.array(ring), pa.array(angle)], names=["rep", "copies", "vector", "ring", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    vector_kind = rows.schema["vector"].dataType.simpleString()
    assigned = stored(classes.mapInArrow(assign, f"rep {kind}, copies long, vector {vector_kind}, ring int, angle double"), "vector-rings")
    found_rings = assigned.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.first(F.size("vector")).alias("d"))
    rings = sorted(found_rings.collect())  # at most RINGS for each of sample_rows / 8 cells
    # A block has fewer rows where vectors are long: about the bytes of block_rows vectors of 64.
    pieces = [-(-r["n"] // max(1, min(block_rows, block_rows * 64 // r["d"]))) for r in rings]
    firsts = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
    by_length = {}
    for d, (base, c) in centres.items():
        at = np.array([k for k, r in enumerate(rings) if r["d"] == d], np.int64)
        cell = np.array([rings[k]["ring"] // RINGS - base for k in at], np.int64)
        by_length[d] = (at, cell, c, np.array([rings[k]["lo"] for k in at]), np.array([rings[k]["hi"] for k in at]))
    plan = spark.sparkContext.broadcast((firsts, by_length))
    dealt = spark.createDataFrame([(r["ring"], k, int(firsts[k]), pieces[k]) for k, r in enumerate(rings)], "ring int, at int, first long, pieces int")
    dealt = assigned.join(F.broadcast(dealt), "ring").withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("pieces")))

    def pack(key, group):
        """A block as one row, with the tasks it goes to: its own, and those of the blocks before it that it may link with."""
        first, lengths = plan.value
        block, k = key[0].as_py(), group.column("at")[0].as_py()
        x = matrix(group.column("vector"))
        at, cell, c, lo, hi = lengths[x.shape[1]]
        own = int(np.searchsorted(at, k))
        between = np.arccos(np.clip(c[cell] @ c[cell[own]], -1, 1))
        near = at[may_link(between, lo[own], hi[own], lo, hi, threshold)]
        others = np.concatenate([np.arange(first[o], first[o + 1]) for o in np.append(near, k)])
        chunks = np.unique(others[others >= block] // CHUNK)
        before = np.unique(others[others < block])
        left = np.append(np.full(len(chunks), block), before)
        tasks = pa.StructArray.from_arrays([pa.array(left), pa.array(np.append(chunks, np.full(len(before), block // CHUNK)))], names=["left", "chunk"])
        one = lambda values, type_: pa.array([values], type_)
        ids = group.column("rep").combine_chunks()
        return pa.table({"block": one(block, pa.int64()), "d": one(x.shape[1], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                         "copies": one(group.column("copies").to_numpy().tobytes(), pa.binary()), "x": one(x.tobytes(), pa.binary()),
                         "tasks": pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), tasks)})

    packed = dealt.select("block", "at", "rep", "copies", "vector").groupBy("block").applyInArrow(
        pack, f"block long, d int, ids array<{kind}>, copies binary, x binary, tasks array<struct<left: long, chunk: long>>")
    packed = packed.withColumn("task", F.explode("tasks")).select("task.left", "task.chunk", "block", "d", "ids", "copies", "x")
    wide = np.float32 if vector_kind == "array<float>" else np.float64 if vector_kind == "array<double>" else None
    if wide is None:
        raise ValueError(f"vectors must be array<float> or array<double>, not {vector_kind}")

    def compare(key, group):
        order = {b: k for k, b in enumerate(group.column("block").to_pylist())}
        members = group.column("ids").combine_chunks()

        def read(b):
            k = order[b]
            return (members[k].values, np.frombuffer(group.column("copies")[k].as_buffer(), np.int64),
                    unit(np.frombuffer(group.column("x")[k].as_buffer(), wide).reshape(-1, group.column("d")[k].as_py())))

        left, chunk = key[0].as_py(), key[1].as_py()
        out = {"rep": [members.values[:0]], "links": [np.zeros(0, np.int64)], "root": [members.values[:0]]}
        ids, copies, x = read(left)
        for b in sorted(order):
            if b // CHUNK != chunk:
                continue
            ids_b, copies_b, y = read(b)
            at, count, label = block_links(x, y, copies, copies_b, b == left, threshold)
            both = ids if b == left else pa.concat_arrays([ids, ids_b])
            for name, value in (("rep", both.take(pa.array(at))), ("links", count), ("root", both.take(pa.array(label)))):
                out[name].append(value)
        return pa.table({"rep": pa.concat_arrays(out["rep"]), "links": np.concatenate(out["links"]), "root": pa.concat_arrays(out["root"])})

    found = packed.groupBy("left", "chunk").applyInArrow(compare, f"rep {kind}, links long, root {kind}")
    found = stored(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")

    whole = classes.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    whole = whole.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = vectors.select(id_col, *[F.when(F.col(id_col).isNotNull() & is_valid(F.col(vector_col)), h).alias(n) for n, h in
                                     (("h1", F.xxhash64(vector_col)), ("h2", F.xxhash64(F.lit(3), vector_col)))])
    out = every.join(whole, ["h1", "h2"], "left")
    component = F.coalesce("component_id", F.col(id_col))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS root FROM v UNION SELECT links.y, reach.root FROM reach JOIN links ON reach.x = links.x),
roots AS (SELECT x, min(root) AS root FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN roots ON roots.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
