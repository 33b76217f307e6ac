"""Labels for training, and probabilities from raw scores by a logistic curve over a histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import broadcast_if_small

#: Raw scores are rounded to 1/STEPS and held within -REACH..REACH: at most 2 * REACH * STEPS + 1 bins.
STEPS, REACH = 20, 100.0


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep) -> DataFrame:
    """id, text, y of the documents whose ids keep(id) admits and that have a label; the largest where an id has several."""
    ids = labels.where(keep(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    ids = ids.select(F.col("doc_id").alias("_id"), "y")
    return docs.select("doc_id", "text").join(broadcast_if_small(ids), F.col("doc_id") == F.col("_id")).drop("_id")


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(raw, -REACH, REACH) * STEPS).astype(np.int32)


def fit_logistic(bins: np.ndarray, negative: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with Platt's smoothed targets; slope is not negative."""
    n0, n1 = float(negative.sum()), float(positive.sum())
    if n0 == 0 or n1 == 0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.concatenate([bins, bins]) / STEPS
    weight = np.concatenate([negative, positive]).astype(float)
    target = np.concatenate([np.full(len(bins), 1 / (n0 + 2)), np.full(len(bins), (n1 + 1) / (n1 + 2))])
    centre, scale = np.average(x, weights=weight), max(1e-6, np.sqrt(np.cov(x, aweights=weight)))
    z = (x - centre) / scale
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * z).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        size = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = max(0.0, a - size * step[0]), b - size * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b - a * centre / scale


def probability(raw: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * np.clip(raw, -REACH, REACH) + curve[1], -50, 50)))
