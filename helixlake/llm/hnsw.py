"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are one node, so that thousands of copies cannot cut the graph in pieces; a node keeps its smallest ids,
as many as a query can ask for. Nodes are dealt by a hash to shards of about shard_rows. A shard's graph is built in
one task of bounded size: nodes come in by a fixed random order, in batches that double up to BATCH. Each searches the graph of those before
it, from the entry down, with a list of candidates on every level that it has, and is linked there to a diverse
choice of those it finds and of its batch before it, and they to it. A node has room for 1.5 times links neighbours (twice that on the lowest level); where it is
full, a diverse choice stays. Vectors get one more component, which makes the largest inner product the nearest in the graph. The
graph is stored as flat arrays: for each level one array of neighbour numbers, of fixed width, -1 where there is none.
Queries are cut into blocks about as large as a shard, so that neither is copied much more than the other, and each shard is searched by each block in a task of its own: best-first with a list
of breadth candidates, for many queries at a time. The shards' results are merged by a window.

Defined results: a vector that is null, empty, zero, or has null or non-finite components, or has no id, takes no part
as candidate or query; only vectors as long as the query are its candidates; equal scores go to the smaller id;
repeated rows of an id are one candidate; with fewer candidates than k all that are found come back; empty tables give
no rows; only id_col and vector_col are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import stored, table
from helixlake.llm.vectors import keyed, matrix

SHARD_ROWS, QUERY_ROWS, LINKS, BUILD, BREADTH = 16_384, 16_384, 24, 64, 192
#: Nodes that come in, or queries that search, at a time; open candidates that a search follows at a time.
BATCH, EXPAND = 256, 4
#: Products between candidates that are held at a time.
PAIRS = 1 << 23


def diverse(x: np.ndarray, near: np.ndarray, to_node: np.ndarray, most: int) -> np.ndarray:
    """For each node a row of candidates, best first and -1 behind: those not closer to one already chosen than to the node, then the best of the others; most a row."""
    rows, width = near.shape
    out = np.full((rows, most), -1, np.int64)
    step = max(1, PAIRS // (width * width))
    for lo in range(0, rows, step):
        part, dots = near[lo : lo + step], to_node[lo : lo + step]
        vectors = x[part]
        among = vectors @ vectors.transpose(0, 2, 1)
        blocked, chosen, room = np.full(part.shape, -np.inf, np.float32), np.zeros(part.shape, bool), np.full(len(part), most)
        for k in range(width):
            chosen[:, k] = take = (part[:, k] >= 0) & (blocked[:, k] <= dots[:, k]) & (room > 0)
            room -= take
            np.maximum(blocked, among[:, k], out=blocked, where=take[:, None])
        order = np.argsort(np.where(chosen, 0, np.where(part >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out[lo : lo + step, : order.shape[1]] = np.take_along_axis(part, order, axis=1)
    return out


def best_of(near: np.ndarray, dots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's best candidates in order; -1 where a product is not finite."""
    order = np.argsort(-dots, axis=1, kind="stable")[:, :most]
    near, dots = np.take_along_axis(near, order, axis=1), np.take_along_axis(dots, order, axis=1)
    return np.where(np.isfinite(dots), near, -1), dots


def walk(x: np.ndarray, flat: np.ndarray, row_of: np.ndarray, q: np.ndarray, start: np.ndarray, breadth: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all q at a time: the breadth best nodes found from start (one for each), best first, and their products."""
    b, n = len(q), len(x)
    found, score, open_ = np.full((b, breadth), -1, np.int64), np.full((b, breadth), -np.inf, np.float32), np.zeros((b, breadth), bool)
    found[:, 0], score[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", q, x[start]), True
    seen = np.zeros(b * n, bool)  # a place for each query and node
    seen[np.arange(b) * n + start] = True
    active = np.arange(b)
    while True:
        rank = np.cumsum(open_[active], axis=1, dtype=np.int32)
        more = rank[:, -1] > 0
        active, rank = active[more], rank[more]
        if not len(active):
            return found, score
        r, c = np.nonzero(open_[active] & (rank <= expand))  # lists are sorted: the first open ones are the best
        r = active[r]
        near = flat.take(row_of[found[r, c]], axis=0)
        open_[r, c] = False
        places = (near + (r * n)[:, None])[near >= 0]
        places = np.sort(places[~seen.take(places)])
        if not len(places):
            continue
        places = places[np.append(True, places[1:] != places[:-1])]  # two nodes can have a neighbour in common
        seen[places] = True
        r, node = np.divmod(places, n)
        dots = np.einsum("ij,ij->i", q.take(r, axis=0), x.take(node, axis=0))
        better = dots > score[r, -1]
        r, node, dots = r[better], node[better], dots[better]
        if not len(r):
            continue
        count = np.bincount(r, minlength=b)
        met = np.flatnonzero(count)
        line, column = np.repeat(np.arange(len(met)), count[met]), breadth + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        nodes, scores, fresh = (np.full((len(met), breadth + count.max()), fill, kind) for fill, kind in ((-1, np.int64), (-np.inf, np.float32), (False, bool)))
        nodes[:, :breadth], scores[:, :breadth], fresh[:, :breadth] = found[met], score[met], open_[met]
        nodes[line, column], scores[line, column], fresh[line, column] = node, dots, True
        best = np.argsort(-scores, axis=1, kind="stable")[:, :breadth]
        found[met], score[met], open_[met] = (np.take_along_axis(a, best, axis=1) for a in (nodes, scores, fresh))


def link_back(x: np.ndarray, member: np.ndarray, row_of: np.ndarray, flat: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Enter each node with the neighbours chosen for it; where a row has no room for those that come, a diverse choice of two thirds of its width stays."""
    k, c = np.nonzero(chosen >= 0)
    target, source = row_of[chosen[k, c]], nodes[k]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    rows, first, count = np.unique(target, return_index=True, return_counts=True)
    degree, width = (flat[rows] >= 0).sum(axis=1), flat.shape[1]
    column = np.arange(len(target)) + np.repeat(degree - first, count)
    over = degree + count > width
    late = np.repeat(over, count)
    flat[target[~late], column[~late]] = source[~late]
    if over.any():
        full = rows[over]
        near = np.full((len(full), (degree + count)[over].max()), -1, np.int64)
        near[:, :width] = flat[full]
        near[np.repeat(np.cumsum(over) - 1, count)[late], column[late]] = source[late]
        dots = (x[near] @ x[member[full]][:, :, None])[:, :, 0]
        near, dots = best_of(near, np.where(near >= 0, dots, -np.inf), near.shape[1])
        flat[full] = -1
        flat[full, : 2 * width // 3] = diverse(x, near, dots, 2 * width // 3)


def build_graph(x: np.ndarray, links: int = LINKS, candidates: int = BUILD, seed: int = 5) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """Entry node, and for each level from the lowest its members (sorted) and their flat neighbour array."""
    n = len(x)
    rng = np.random.default_rng(seed)
    size = (x * x).sum(axis=1)
    x = np.hstack([x, np.sqrt(np.maximum(size.max() - size, 0))[:, None]]).astype(np.float32)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 6)
    order = rng.permutation(n)
    entry = int(np.flatnonzero(level == level.max())[0])
    order = np.append(entry, order[order != entry])
    members = [np.flatnonzero(level >= at) for at in range(int(level.max()) + 1)]
    row_of = [np.full(n, -1, np.int64) for _ in members]
    for rows, m in zip(row_of, members):
        rows[m] = np.arange(len(m))
    flat = [np.full((len(m), 3 * links if at == 0 else 3 * links // 2), -1, np.int32) for at, m in enumerate(members)]
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, done)]
        done += len(batch)
        at = np.full(len(batch), entry)
        for lv in range(len(members) - 1, -1, -1):
            deep = level[batch] >= lv
            if (~deep).any():
                at[~deep] = walk(x, flat[lv], row_of[lv], x[batch[~deep]], at[~deep], 1, 1)[0][:, 0]
            if not deep.any():
                continue
            new = batch[deep]
            found, score = walk(x, flat[lv], row_of[lv], x[new], at[deep], candidates)
            at[deep] = found[:, 0]
            mates = np.where(np.tri(len(new), k=-1, dtype=bool), x[new] @ x[new].T, -np.inf)  # those of the batch before it
            near, dots = best_of(np.hstack([found, np.broadcast_to(new, mates.shape)]), np.hstack([score, mates]), candidates)
            near = diverse(x, near, dots, links)
            flat[lv][row_of[lv][new], :links] = near
            link_back(x, members[lv], row_of[lv], flat[lv], new, near)
    return entry, [m.astype(np.int32) for m in members], flat


def search_graph(x: np.ndarray, entry: int, members: list[np.ndarray], flat: list[np.ndarray], queries: np.ndarray, k: int, breadth: int = BREADTH) -> np.ndarray:
    """Numbers of the k nodes nearest to each query that the search finds, best first; -1 where there are fewer."""
    x32, out = x.astype(np.float32), []
    row_of = []
    for m in members:
        rows = np.full(len(x), -1, np.int64)
        rows[m] = np.arange(len(m))
        row_of.append(rows)
    for lo in range(0, len(queries), BATCH):
        q = queries[lo : lo + BATCH].astype(np.float32)
        at = np.full(len(q), entry, np.int64)
        for lv in range(len(flat) - 1, 0, -1):
            at = walk(x32, flat[lv], row_of[lv], q, at, 1, 1)[0][:, 0]
        out.append(walk(x32, flat[0], row_of[0], q, at, max(breadth, k))[0][:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, candidates: int = BUILD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a shard: dim, shard, ids and vectors of its nodes, entry, and members and neighbours of each level as flat arrays."""
    classes = keyed(vectors, id_col, vector_col).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("dim", F.size("vector")), "vector-nodes")
    shards = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("n"))
    dealt = classes.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.col("n")).cast("int"))
    kind, vector_kind = classes.schema["id"].dataType.simpleString(), classes.schema["vector"].dataType.elementType.simpleString()

    def build(key, group):
        group = group.sort_by("id")
        x = matrix(group.column("vector"))
        entry, members, flat = build_graph(x.astype(np.float64), links, candidates)
        one = lambda values, t: pa.array([values], t)
        return pa.table({"dim": one(key[0].as_py(), pa.int32()), "shard": one(key[1].as_py(), pa.int32()), "ids": one(group.column("id").to_pylist(), pa.list_(group.schema.field("id").type)),
                         "vectors": one(x.ravel(), pa.list_(group.schema.field("vector").type.value_type)), "entry": one(entry, pa.int32()),
                         "members": one([m.tolist() for m in members], pa.list_(pa.list_(pa.int32()))), "neighbours": one([f.ravel().tolist() for f in flat], pa.list_(pa.list_(pa.int32())))})

    schema = f"dim int, shard int, ids array<{kind}>, vectors array<{vector_kind}>, entry int, members array<array<int>>, neighbours array<array<int>>"
    return dealt.select("dim", "shard", "id", "vector").groupBy("dim", "shard").applyInArrow(build, schema)


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, breadth: int = BREADTH, query_rows: int = QUERY_ROWS,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each distinct row of queries its k nearest of vectors, its own id left out."""
    index = stored(index, "hnsw-index")
    asked = keyed(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.size("vector").alias("dim"), "vector").distinct()
    asked = stored(asked, "hnsw-queries")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    asked = asked.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a row for each length, a number for each shard
    asked = asked.join(shards, "dim").withColumn("shard", F.explode("shards")).select("dim", "shard", "block", "query_id", "vector")
    graphs = index.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    kind = asked.schema["query_id"].dataType.simpleString()

    def find(key, rows, graph):
        if not graph.num_rows or not rows.num_rows:
            return pa.table({"query_id": rows.column("query_id").slice(0, 0), "rep": rows.column("query_id").slice(0, 0), "score": pa.array([], pa.float64())})
        dim = key[0].as_py()
        g = {c: graph.column(c)[0] for c in ("ids", "vectors", "entry", "members", "neighbours")}
        ids, x = g["ids"].values.to_numpy(), g["vectors"].values.to_numpy().reshape(-1, dim)
        members = [m.values.to_numpy() for m in g["members"]]
        flat = [f.values.to_numpy().reshape(len(m), -1) for m, f in zip(members, g["neighbours"])]
        q = matrix(rows.column("vector"))
        found = search_graph(x, g["entry"].as_py(), members, flat, q, k + 1, breadth)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = np.einsum("ij,ij->i", q[row].astype(np.float64), x[node].astype(np.float64))
        return pa.table({"query_id": rows.column("query_id").combine_chunks().take(pa.array(row)), "rep": ids[node], "score": score})

    found = asked.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("dim", "shard", "block")).applyInArrow(
        find, f"query_id {kind}, rep {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rep")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    # Members of a node: its k + 1 smallest ids are all that a query can need.
    rows = keyed(vectors, id_col, vector_col).select("h1", "h2", "id").distinct()
    smallest = Window.partitionBy("h1", "h2").orderBy("id")
    members = rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    members = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids")).select("rep", "ids")
    each = found.join(members, "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search(build_index(vectors), vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")
