"""Text quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed to 2^bits: of 1 to 3 bytes (digits as one), and of 1 to 3 words' shapes
(capitals, digits, symbols, length, closing mark, equality with the word before). Log-count ratios of the two classes,
over all labelled training texts, scale the indicators; each text's vector is brought to length 1. A linear hinge-loss
model is fitted to them by dual coordinate descent on at most fit_rows texts, half of each class where there are
enough, taken by a hash of their ids (of rows that share an id the smallest text), in one task. A logistic curve over labelled texts that neither step has seen makes the margin a probability.

Defined results: a null or empty text has no features and the score of margin 0 without them; repeated rows are scored
each, and count as often in training; rows without a label, or whose id is null, train nothing; with labels of one
kind or none the score is constant; an empty table gives no rows. Only doc_id and text are read, so extra columns
cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.calibration import bin_of, fit_logistic, labelled, probability
from helixlake.llm.common import held_out, table
from helixlake.llm.textvec import raw as raw_bytes
from helixlake.llm.textvec import slices, words

BITS = 16
#: The most texts that the hinge-loss model is fitted to.
FIT_ROWS = 6_000
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 30

_BYTE = np.arange(256, dtype=np.uint32)
_BYTE[48:58] = 48
_CODE = np.array([[b < 128 and not chr(b).isalnum() and chr(b) not in " \t\n\x0b\x0c\r.,;:'-", chr(b).isdigit() and b < 128, 97 <= b <= 122 or b >= 128, chr(b) in ".,;:!?"] for b in range(256)])


class Model(NamedTuple):
    ratio: np.ndarray
    weight: np.ndarray
    offset: float
    curve: tuple[float, float]


def _hashed(code: np.ndarray, kind: int) -> np.ndarray:
    code = (code + np.uint32(kind * 0x1000003)) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return code >> np.uint32(32 - BITS)


def shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An 8-bit shape for each word, and each text's range of words."""
    w = words(texts, lower=False)
    if not len(w.hash):
        return np.zeros(0, np.uint32), w.first
    marks = np.zeros((len(w.data) + 1, 3), np.int32)
    np.cumsum(_CODE[w.data, :3], axis=0, out=marks[1:])
    symbol, digit, small = (marks[w.end] - marks[w.start]).T > 0
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    size = np.searchsorted([3, 6, 10, 16, 40, 200], w.end - w.start).astype(np.uint32)
    closed = _CODE[w.data[w.end - 1], 3]
    out = size | (symbol.astype(np.uint32) << 3) | (digit.astype(np.uint32) << 4) | (small.astype(np.uint32) << 5) | (same.astype(np.uint32) << 6) | (closed.astype(np.uint32) << 7)
    return out, w.first


def features(batch: pa.RecordBatch):
    """For each text the sorted ids of its n-grams."""
    flags = np.zeros(1 << BITS, np.uint8)
    for part in slices(batch, "text"):
        data, offsets = raw_bytes(part.column("text"))
        one = _BYTE[data]
        shape, first = shapes(part.column("text"))
        grams = []
        for kind, (code, bounds, base) in enumerate(((one, offsets, 257), (shape, first, 263))):
            rolled = code.copy()
            for n in range(1, 4):
                if n > 1:
                    if len(rolled) < 2:
                        break
                    rolled = rolled[:-1] * np.uint32(base) + code[n - 1 :]
                grams.append((_hashed(rolled, 3 * kind + n), bounds, n))
        for k in range(part.num_rows):
            flags[:] = 0
            for ids, bounds, n in grams:
                flags[ids[bounds[k] : max(bounds[k], bounds[k + 1] - n + 1)]] = 1
            yield np.flatnonzero(flags)


def margin(ids: np.ndarray, ratio: np.ndarray, weight: np.ndarray, offset: float) -> float:
    r = ratio[ids]
    size = np.sqrt((r * r).sum())
    return float((weight[ids] * r).sum() / size + offset) if size > 0 else float(offset)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear hinge-loss model; y is -1 or 1, the offset a feature of value 1 in every row."""
    weight, offset, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (weight[rows[i]] @ values[i] + offset) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[rows[i]] += step * values[i]
                offset += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight, offset


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the rows of labels whose ids keep(id) admits; a quarter of them, by a hash of the id, only calibrate."""
    spark, dims = docs.sparkSession, 1 << BITS
    part = lambda i: F.pmod(F.xxhash64(F.lit(11), i), F.lit(4)) == 0
    train = labelled(docs, labels, label, lambda i: keep(i) & ~part(i))

    def counts(batches):
        seen, rows = np.zeros(2 * dims, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for ids, y in zip(features(batch), batch.column("y").to_pylist()):
                seen[ids + dims * y] += 1
                rows[y] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]]), pa.int64()), pa.array(np.concatenate([seen[at], rows]), pa.int64())], names=["at", "n"])

    found = train.mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * 2^BITS + 2 rows
    n_of = dict(zip(found["at"], found["n"]))
    n0, n1 = n_of.pop(-1, 0), n_of.pop(-2, 0)
    if not n0 or not n1:
        return Model(np.zeros(dims), np.zeros(dims), 0.0, (0.0, float(np.log((n1 + 1) / (n0 + 1)))))
    seen = np.zeros(2 * dims)
    seen[np.fromiter(n_of, np.int64)] = np.fromiter(n_of.values(), float)
    p, q = seen[dims:] + SMOOTHING, seen[:dims] + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[seen[:dims] + seen[dims:] == 0] = 0

    ids = labels.where(keep(F.col("doc_id")) & ~part(F.col("doc_id")) & F.col(label).isNotNull()).select("doc_id", label).distinct()
    half = [ids.where((F.col(label) > 0) == positive).orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(fit_rows // 2) for positive in (True, False)]
    sample = labelled(docs, half[0].unionByName(half[1]), label, lambda i: F.lit(True)).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def listed(batches):
        for batch in batches:
            lists = [ids.astype(np.int32) for ids in features(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "y", "ids"])

    def descend(group):
        """The one group of at most fit_rows texts."""
        group = group.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
        rows, values = [], []
        for v in group.column("ids"):
            rows.append(v.values.to_numpy())
            r = ratios.value[rows[-1]]
            values.append(r / max(1e-12, np.sqrt((r * r).sum())))
        y = 2.0 * group.column("y").to_numpy() - 1
        each = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1.0, 1.0)}
        weight, offset = dual_coordinate_descent(rows, values, y, dims, COST * np.array([each[s] for s in y]))
        return pa.table({"weight": pa.array([weight], pa.list_(pa.float64())), "offset": pa.array([offset], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    ratios = spark.sparkContext.broadcast(ratio)
    taken = sample.mapInArrow(listed, f"doc_id {kind}, y int, ids array<int>").withColumn("one", F.lit(1))
    fitted = taken.groupBy("one").applyInArrow(descend, "weight array<double>, offset double").toArrow()
    weight, offset = (fitted.column("weight")[0].values.to_numpy(), fitted.column("offset")[0].as_py()) if fitted.num_rows else (np.zeros(dims), 0.0)

    shared = spark.sparkContext.broadcast((ratio, weight, offset))

    def binned(batches):
        for batch in batches:
            raw = np.array([10 * margin(ids, *shared.value) for ids in features(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(bin_of(raw), pa.int32())], names=["y", "bin"])

    rest = labelled(docs, labels, label, lambda i: keep(i) & part(i))
    bins = rest.mapInArrow(binned, "y int, bin int").groupBy("bin").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).toPandas()
    curve = fit_logistic(*(bins[c].to_numpy(float) for c in ("bin", "n0", "n1"))) if len(bins) else (1.0, 0.0)
    return Model(ratio, weight, offset, curve)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and score, the probability of label 1; replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def scored(batches):
        for batch in batches:
            m = shared.value
            raw = np.array([10 * margin(ids, m.ratio, m.weight, m.offset) for ids in features(batch)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(raw, m.curve), pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op6_quality_nbsvm(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, lambda i: ~held_out(i, 5, 0))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
