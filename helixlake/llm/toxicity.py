"""Toxic passages by maximum-scoring segment search.

Tokens are words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) and, where a word itself says nothing,
its first 5 or 4 bytes. The number of toxic and of other labelled texts that hold a token gives its log-odds under an
informative Dirichlet prior; those below LEAST_Z standard errors count as zero. The model is the table of all others. Up to MODEL_TOKENS of them are
broadcast; beyond, the table stays a table, and each distinct text gets the odds of its own tokens by a join, with the same scores. All are shifted down by drift, so that the score of ordinary text falls with its
length. A linear scan (Ruzzo and Tompa) then finds every maximal segment of positive score. As for local alignments, the
number of segments of score S or more in n ordinary words is K n exp(-lambda S): lambda solves E[exp(lambda score)] = 1
over the words of the texts that are not toxic, K comes from their best segments. A text's evidence is
lambda S - ln(K n) of its best segment plus that of every other significant one; a logistic curve over the labelled
texts makes it a probability.

Defined results: a null or empty text has no segment and the score that the curve gives to no evidence; repeated rows
are scored each, and count as often in training; rows without a label, or whose id is null, train nothing; with labels
of one kind or none the score is constant; an empty table gives no rows. Only doc_id and text are read, so extra
columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.calibration import bin_of, fit_logistic, labelled, probability
from helixlake.llm.common import held_out, stored, table
from helixlake.llm.textvec import Words, mix, raw, slices, words

MODEL_TOKENS, PRIOR_TEXTS, LEAST_Z, DRIFT, SIGNIFICANT_E = 1 << 22, 50.0, 3.0, 1.5, 0.01
#: Bytes of a token: of whole words, then of their beginnings.
PREFIXES = (0, 5, 4)


class Model(NamedTuple):
    key: np.ndarray  # sorted token hashes
    odds: np.ndarray
    rate: float  # lambda
    count: float  # K
    curve: tuple[float, float]
    table: DataFrame | None = None  # token and odds, where they are too many to broadcast; key and odds are empty then


def tokens(w: Words) -> list[np.ndarray]:
    """For each kind of token the hashes of all words."""
    out = [w.hash]
    for size in PREFIXES[1:]:
        code = np.zeros(len(w.hash), np.uint64)
        for k in range(size):
            at = w.start + k
            code = code * np.uint64(257) + np.where(at < w.end, w.data[np.minimum(at, len(w.data) - 1)] + np.uint64(1), np.uint64(0))
        out.append(mix(code + np.uint64(size << 56)))
    return out


def word_scores(w: Words, key: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log-odds of each word's first kind of token that the model knows, shifted down."""
    out = np.zeros(len(w.hash))
    if len(key) and len(out):
        for hashes in reversed(tokens(w)):
            at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            out = np.where(key[at] == hashes, odds[at], out)
    return out - DRIFT


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, last, score): in one pass over the positive scores and their running sums."""
    sums = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    left, right, first, last, before = [], [], [], [], []
    for i in np.flatnonzero(score > 0).tolist():
        l, r, begin = sums[i], sums[i + 1], i
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = before[j]
            if j < 0 or right[j] >= r:
                break
            l, begin = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], before[j:]
            j -= 1
        left.append(l), right.append(r), first.append(begin), last.append(i), before.append(j)
    return [(a, b, float(r - l)) for a, b, l, r in zip(first, last, left, right)]


def rate_of(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1; scores are negative on average."""
    p = weight / max(1.0, weight.sum())
    lo, hi = 0.0, 20.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * score, 500))).sum() < 1 else (lo, mid)
    return (lo + hi) / 2


def with_own_odds(docs: DataFrame, table: DataFrame | None) -> DataFrame:
    """docs (with the column text) with own, the tokens of each text that the table has, and their odds; without a table docs as they are.

    Distinct tokens of distinct texts meet the table by token, where a frequent one is split by the adaptive join, and come back by text.
    """
    if table is None:
        return docs

    def distinct(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                w = words(part.column("text"), "not_alnum")
                text = np.repeat(np.arange(part.num_rows), np.diff(w.first))
                pairs = [np.unique(np.stack([text.astype(np.uint64), h]), axis=1) for h in tokens(w)] if len(text) else []
                if pairs:
                    at, h = np.concatenate(pairs, axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("own_key").take(pa.array(at.astype(np.int64))), pa.array(h.view(np.int64))], names=["own_key", "token"])

    keyed = docs.withColumn("own_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    pairs = keyed.select("own_key", "text").mapInArrow(distinct, "own_key string, token long").distinct()
    own = pairs.join(table, "token").groupBy("own_key").agg(F.collect_list(F.struct("token", "odds")).alias("own"))
    return keyed.join(own, "own_key", "left").select(*docs.columns, "own")


def _known(part: pa.RecordBatch, key: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and odds for a batch: the model's, or those that its texts bring along."""
    if "own" not in part.schema.names:
        return key, odds
    own = part.column("own").flatten()
    key, at = np.unique(np.asarray(own.field("token"), np.int64).view(np.uint64), return_index=True)
    return key, np.asarray(own.field("odds"), np.float64)[at]


def _scan(batch: pa.RecordBatch, key: np.ndarray, odds: np.ndarray):
    """For each text: its words' scores, its segments, its words' byte ranges within it."""
    for part in slices(batch, "text"):
        _, offsets = raw(part.column("text"))
        w = words(part.column("text"), "not_alnum")
        s = word_scores(w, *_known(part, key, odds))
        positive = np.concatenate([[0], np.cumsum(s > 0)])
        for k, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:])):
            found = maximal_segments(s[lo:hi]) if positive[hi] > positive[lo] else []
            yield s[lo:hi], found, w.start[lo:hi] - offsets[k], w.end[lo:hi] - offsets[k]


def evidence(n: int, scores: list[float], rate: float, count: float) -> float:
    base = float(np.log(count * max(n, 1)))
    each = sorted((rate * s - base for s in scores), reverse=True)
    return each[0] + sum(x for x in each[1:] if x > -np.log(SIGNIFICANT_E)) if each else min(0.0, -base)


def learn_tokens(train: DataFrame, model_tokens: int = MODEL_TOKENS) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Sorted hashes and log-odds of the tokens that tell toxic (y = 1) from other texts; of more than model_tokens the table, and empty arrays."""
    def counts(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                w = words(part.column("text"), "not_alnum")
                text = np.repeat(np.arange(part.num_rows), np.diff(w.first)).astype(np.uint64)
                y = part.column("y").to_numpy(zero_copy_only=False)
                for hashes in tokens(w):
                    once = np.lexsort((text, hashes))
                    h, t = hashes[once], text[once]
                    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
                    h, toxic = h[new], y[t[new].astype(np.int64)]
                    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                    if len(begin):
                        n1 = np.add.reduceat(toxic.astype(np.int64), begin)
                        n = np.diff(np.append(begin, len(h)))
                        yield pa.RecordBatch.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(n - n1), pa.array(n1)], names=["token", "n0", "n1"])

    totals = train.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    n0, n1 = float(totals[0] or 0), float(totals[1] or 0)
    if not n0 or not n1:
        return np.zeros(0, np.uint64), np.zeros(0), None
    seen = train.mapInArrow(counts, "token long, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    prior = PRIOR_TEXTS * (F.col("n0") + F.col("n1")) / (n0 + n1) + 0.5
    a, b = F.col("n1") + prior, F.col("n0") + prior
    delta = F.log(a / (n1 + PRIOR_TEXTS + 1 - F.col("n1"))) - F.log(b / (n0 + PRIOR_TEXTS + 1 - F.col("n0")))
    rows = seen.select("token", delta.alias("odds"), (F.abs(delta) / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.col("z") >= LEAST_Z)
    rows = stored(rows.select("token", "odds"), "toxic-tokens")
    if rows.count() > model_tokens:
        return np.zeros(0, np.uint64), np.zeros(0), rows
    rows = rows.toArrow()
    key = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], rows.column("odds").to_numpy()[order], None


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", model_tokens: int = MODEL_TOKENS) -> Model:
    """Learn from the rows of labels whose ids keep(id) admits."""
    spark = docs.sparkSession
    train = labelled(docs, labels, label, keep)
    key, odds, known = learn_tokens(train, model_tokens)
    shared = spark.sparkContext.broadcast((key, odds))

    def scanned(batches):
        """A row for each text, and for the scores of the words of those that are not toxic a row for each tenth (y -1)."""
        for batch in batches:
            rows = []
            tenths: dict[int, int] = {}
            for y, (s, found, _, _) in zip(batch.column("y").to_pylist(), _scan(batch, *shared.value)):
                rows.append((y, len(s), [x for _, _, x in found]))
                if not y:
                    for t, n in zip(*(x.tolist() for x in np.unique(np.rint(s * 10).astype(np.int64), return_counts=True))):
                        tenths[t] = tenths.get(t, 0) + n
            rows += [(-1, n, [t / 10]) for t, n in tenths.items()]
            y, n, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["y", "n", "scores"])

    seen = stored(with_own_odds(train, known).mapInArrow(scanned, "y int, n long, scores array<double>"), "toxic-segments")
    words_ = seen.where("y = -1").groupBy(F.col("scores")[0].alias("s")).agg(F.sum("n").alias("n")).toPandas()  # a row for each tenth
    rate = rate_of(words_["s"].to_numpy(float), words_["n"].to_numpy(float))
    # K n exp(-rate S) segments of at least S are expected: count those of the texts that are not toxic at the least score of a token.
    lowest = known.where(F.col("odds") > DRIFT).agg(F.min("odds")).first()[0] if known is not None else odds[odds > DRIFT].min() if (odds > DRIFT).any() else None
    least = 1.0 if lowest is None else max(0.1, float(lowest) - DRIFT)
    clean = seen.where("y = 0").agg(F.sum(F.coalesce(F.array_max("scores") >= least, F.lit(False)).cast("long")), F.sum("n")).first()
    count = max(1.0, float(clean[0] or 0)) / (max(1.0, float(clean[1] or 0)) * float(np.exp(-rate * least)))

    def binned(batches):
        for batch in batches:
            found = [evidence(n, s, rate, count) for n, s in zip(batch.column("n").to_pylist(), batch.column("scores").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(bin_of(np.array(found, float)), pa.int32())], names=["y", "bin"])

    bins = seen.where("y >= 0").mapInArrow(binned, "y int, bin int").groupBy("bin").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).toPandas()
    curve = fit_logistic(*(bins[c].to_numpy(float) for c in ("bin", "n0", "n1"))) if len(bins) else (0.0, 0.0)
    return Model(key, odds, rate, count, curve, known)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and passages: the UTF-8 byte ranges, scores and E-values of all significant segments."""
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(table=None))
    kind = docs.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def scored(batches):
        for batch in batches:
            m = shared.value
            found_, passages = [], []
            for s, found, start, end in _scan(batch, m.key, m.odds):
                found_.append(evidence(len(s), [x for _, _, x in found], m.rate, m.count))
                each = [{"start": int(start[a]), "end": int(end[b]), "score": x, "e_value": float(m.count * len(s) * np.exp(-m.rate * x))} for a, b, x in found]
                passages.append([x for x in each if x["e_value"] <= SIGNIFICANT_E])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(np.array(found_, float), m.curve), pa.float64()), pa.array(passages, passage)], names=["doc_id", "score", "passages"])

    return with_own_odds(docs.select("doc_id", "text"), model.table).mapInArrow(scored, f"doc_id {kind}, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>")


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, lambda i: ~held_out(i, 5, 0))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                                              F.size("passages").alias("n_passages"))
