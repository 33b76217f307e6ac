"""Scores of texts under a unigram baseline and a causal self-attention model.

Tokens of the baseline are words (runs without ASCII white space, A-Z lower-cased) and one end a text. Their counts
over all training texts are a distributed table. Words of more than one token in 2^20, no more than 2^20 words, are
broadcast; all others meet their counts in a join on the word's hash.

The model reads and scores every subword id of a public byte-level BPE: of each word, with a space before it, all its
ids, and an end after the last word. Ids are grouped into classes by k-means on what stands beside them, those that
begin a word apart from those that go on with one, so that the classes of a text tell where its words begin, and

    p(word | before) = product over its ids of p(class of the id | before) * (c + 1) / (N + V + 1),

where c is the word's count, and N and V are the tokens and distinct words that have its sequence of classes: these
words share the probability of their sequence as those of the baseline share the whole, and one more share is left for
unseen words (all of it for a sequence that no training word has). So the first factor carries all that the text before
tells. It is a causal self-attention layer over classes with position embeddings, where a query also knows the class before
its own, written in numpy, which starts as the classes' shares: as the baseline, so to speak. The sequences' sizes are a distributed table too, read as the words' is.

Training is rounds of local steps (Adam) on groups of about GROUP_IDS ids, whose parameters are averaged. All training
texts take part, each in one round. Which group a text belongs to, its place there, and the sums of the averages depend on ids and texts alone, not on how the
table is split. Texts are cut into pieces of PIECE ids, and these into blocks of BLOCK. A window is a block and the one
before it; it scores each id of its block once, all windows in batches with one mask. A word belongs to the piece in which it begins.

Defined results: a null text is the empty text, which has its end alone; repeated rows are scored each, and count as
often in training; a null id is never held out; without training texts every count is 0 and the classes share evenly;
an empty table gives no rows; only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.bpe import encoder, vocabulary
from helixlake.llm.common import held_out, stored, table
from helixlake.llm.textvec import Words, mix, powers, slices, words

CLASSES, NEIGHBOURS, DIM, BLOCK, PIECE = 59, 48, 24, 32, 1 << 16
#: Classes of the output: those of seen ids, unseen ids that begin a word or go on with one, the end. Inputs also have the text's start and padding.
UNSEEN, UNSEEN_INNER, END, START, PAD = range(CLASSES, CLASSES + 5)
OUTPUTS, INPUTS = CLASSES + 3, CLASSES + 5
HEAD_SHARE = 1 << 20
#: Steps of each round are SLOWER times those of the one before.
ROUNDS, GROUP_IDS, BATCH, STEP, SLOWER = 3, 1 << 20, 16, 0.02, 0.3
#: Parameters are averaged as whole multiples of 1/FINE, so that the order of the sum does not matter.
FINE = 1e6
LN10 = float(np.log(10))
END_HASH = np.uint64(0xE0D0_0001_7E87_0001)


class Model(NamedTuple):
    class_of: np.ndarray  # of an id; then of the end and of the start
    begins: np.ndarray  # whether an id, or the end, begins a word
    parameters: dict[str, np.ndarray]


# --- the attention layer ---------------------------------------------------------------------------------------------


def new_parameters(shares: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    return {"embed": draw(INPUTS, DIM), "prior": np.zeros((INPUTS, DIM), np.float32), "place": draw(2 * BLOCK, DIM) / 3, "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM),
            "out": np.zeros((DIM, OUTPUTS), np.float32), "bias": np.log(np.maximum(shares, 1e-9)).astype(np.float32)}


#: Upper limits of what goes into exp: 40, and for ids after the query a value whose exp is 0.
_LIMIT = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK, 2 * BLOCK)[:, None], 40, -1000).astype(np.float32)
#: Sums over the last axis are products with ones, which is faster than a reduction.
_ONES, _ONES_OUT, _ONE_HOT = np.ones((DIM, 1), np.float32), np.ones((OUTPUTS, 1), np.float32), np.eye(INPUTS, dtype=np.float32)


class Keys(NamedTuple):
    """Keys and values of classes and of places, once for each of these, not for each id of a text: those of an id are the sums of its two."""

    base: np.ndarray  # embed and place
    kv: np.ndarray
    classes: np.ndarray  # key, value, 1; padding has no value and no 1, so it adds nothing to any sum
    places: np.ndarray


def keys_of(p: dict[str, np.ndarray]) -> Keys:
    base, kv = np.concatenate([p["embed"], p["place"]]), np.concatenate([p["k"], p["v"]], axis=1)
    both = np.ones((len(base), 2 * DIM + 1), base.dtype)
    both[:, :-1] = base @ kv
    both[INPUTS:, -1] = both[PAD, DIM:] = 0
    return Keys(base, kv, both[:INPUTS], both[INPUTS:])


def forward(p: dict[str, np.ndarray], x: np.ndarray, made: Keys | None = None) -> tuple:
    """x: windows of 2 * BLOCK input classes. Logits of the class after each of the last BLOCK (a row each), and what the gradients need."""
    made, n, x = made or keys_of(p), len(x), x.astype(np.intp)
    padding = np.flatnonzero(x == PAD)
    keys = made.classes.take(x, axis=0)
    keys += made.places
    keys.reshape(-1, 2 * DIM + 1)[padding, DIM:] = 0
    tail = p["embed"].take(x[:, BLOCK:], axis=0)
    tail += p["prior"].take(x[:, BLOCK - 1 : -1], axis=0)
    tail += p["place"][BLOCK:]
    q = (tail.reshape(-1, DIM) @ (p["q"] / np.float32(np.sqrt(DIM)))).reshape(n, BLOCK, DIM)
    a = np.matmul(q, keys[..., :DIM].transpose(0, 2, 1))
    np.minimum(a, _LIMIT, out=a)
    np.exp(a, out=a)
    h = np.matmul(a, keys[..., DIM:])  # the last column is the sum of the weights
    share = 1 / np.maximum(h[..., DIM:], 1e-30)
    told = h[..., :DIM] * share
    h = (told + tail).reshape(-1, DIM)
    logit = h @ p["out"]
    logit += p["bias"]
    if logit.max(initial=0) > 60:
        np.minimum(logit, 60, out=logit)
    return logit, (made, x, padding, keys, tail.reshape(-1, DIM), q, a, share, told, h)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood of targets y (BLOCK a window, PAD where there is none)."""
    d, (made, x, padding, keys, tail, q, a, share, told, h) = forward(p, x)
    n, real = len(x), y.reshape(-1, 1) != PAD
    np.exp(d, out=d)
    total = d @ _ONES_OUT
    # What follows is for d * weight; the weight goes to the smaller factors.
    d.reshape(-1)[np.arange(0, d.size, OUTPUTS) + np.minimum(y.ravel(), OUTPUTS - 1)] -= total[:, 0]
    weight = real / (total * max(1, np.count_nonzero(real)))
    weight = weight.astype(d.dtype, copy=False)
    g = {"out": (h * weight).T @ d, "bias": (weight.T @ d)[0]}
    dh = d @ p["out"].T
    dh *= weight
    d_told = np.empty((n, BLOCK, DIM + 1), d.dtype)
    own = np.multiply(dh.reshape(told.shape), share)
    d_told[..., :DIM] = own
    told *= own
    d_told[..., DIM:] = (told.reshape(-1, DIM) @ -_ONES).reshape(n, BLOCK, 1)
    ds = np.matmul(d_told, keys[..., DIM:].transpose(0, 2, 1))
    ds *= a
    dq = np.matmul(ds, keys[..., :DIM]).reshape(-1, DIM)
    d_keys = np.empty((n, 2 * BLOCK, 2 * DIM), d.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=d_keys[..., :DIM])
    np.matmul(a.transpose(0, 2, 1), own, out=d_keys[..., DIM:])
    d_keys.reshape(-1, 2 * DIM)[padding, DIM:] = 0
    scale = np.float32(np.sqrt(DIM))
    g["q"] = tail.T @ dq / scale
    dh += dq @ (p["q"].T / scale)
    by_class = lambda at, rows: _ONE_HOT.take(at.ravel(), axis=0).T @ rows
    sums = np.concatenate([by_class(x, d_keys.reshape(-1, 2 * DIM)), d_keys.sum(axis=0)])
    d_kv, d_base = made.base.T @ sums, sums @ made.kv.T
    g["k"], g["v"] = d_kv[:, :DIM], d_kv[:, DIM:]
    g["embed"], g["place"] = d_base[:INPUTS] + by_class(x[:, BLOCK:], dh), d_base[INPUTS:]
    g["prior"] = by_class(x[:, BLOCK - 1 : -1], dh)
    g["place"][BLOCK:] += dh.reshape(n, BLOCK, DIM).sum(axis=0)
    return g


def local_steps(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, round_: int) -> dict[str, np.ndarray]:
    """Adam once over all windows in the round's order and step, from a copy of p."""
    step, at = STEP * SLOWER**round_, np.cumsum([0, *(v.size for v in p.values())]).tolist()
    now = np.concatenate([v.ravel() for v in p.values()])
    p = {c: now[lo:hi].reshape(v.shape) for (c, v), lo, hi in zip(p.items(), at, at[1:])}
    m, s = np.zeros_like(now), np.zeros_like(now)
    order = np.random.default_rng(round_).permutation(len(x))
    x, y = x[order], y[order]
    for t, lo in enumerate(range(0, len(x), BATCH), 1):
        of = gradients(p, x[lo : lo + BATCH], y[lo : lo + BATCH])
        g = np.concatenate([of[c].ravel() for c in p])
        m *= 0.9
        m += 0.1 * g
        g *= g
        s *= 0.99
        s += 0.01 * g
        now -= step / (1 - 0.9**t) * m / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    return p


def score_windows(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, at_once: int = 2 * BATCH) -> np.ndarray:
    """log10 p(target's class) for each target; 0 where there is none."""
    out, made = np.zeros(y.shape), keys_of(p)
    for lo in range(0, len(x), at_once):
        logit, _ = forward(p, x[lo : lo + at_once], made)
        target = np.minimum(y[lo : lo + at_once], OUTPUTS - 1).ravel()
        got = logit.reshape(-1)[np.arange(0, logit.size, OUTPUTS) + target]
        np.exp(logit, out=logit)
        out[lo : lo + at_once] = (got - np.log(logit @ _ONES_OUT)[:, 0]).reshape(-1, BLOCK)
    out[y == PAD] = 0
    return out / LN10


# --- texts to ids and windows ----------------------------------------------------------------------------------------


class Subwords:
    """All ids of each word: of frequent words from a table, of others encoded as long as the cache holds them."""

    def __init__(self, path: str, ids: np.ndarray, size: np.ndarray, most: int = 300_000, most_ids: int = 1 << 22):
        """ids, size: those of the table's words, one behind the other, and how many each has."""
        self.encode, self.most, self.most_ids = encoder(path)[0].encode_ordinary, most, most_ids
        self.table = ids, np.cumsum(size) - size, size
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.starts, self.sizes = {}, array("H"), array("q"), array("q")
        self.end = len(self.table[0])

    def of(self, w: Words, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one behind the other, and where each word's begin, with the last one's end; at, found: place of each word in the table, and whether it is there."""
        ids, starts, sizes = self.table
        if len(self.known) > self.most or self.end - len(ids) > self.most_ids:
            self.forget()
        rest = np.flatnonzero(~found)
        values, first, which = np.unique(w.hash[rest], return_index=True, return_inverse=True)
        data, rows = w.data.tobytes() if len(values) else b"", []
        for h, k in zip(values.tolist(), rest[first].tolist()):
            row = self.known.get(h)
            if row is None:
                row = self.known[h] = len(self.starts)
                new = self.encode(" " + data[w.start[k] : w.end[k]].decode("utf-8", "replace"))
                self.ids.extend(new), self.starts.append(self.end), self.sizes.append(len(new))
                self.end += len(new)
            rows.append(row)
        start, size = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.int64)
        start[found], size[found] = starts[at[found]], sizes[at[found]]
        if rows:
            rows = np.array(rows)[which]
            start[rest], size[rest] = np.array(self.starts)[rows], np.array(self.sizes)[rows]
            ids = np.concatenate([ids, np.array(self.ids)])
        edge = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])], edge


def begins_word(path: str) -> np.ndarray:
    """Of each id, and of the end: the one space of an encoded word is in its first id."""
    return np.array([*(b" " in part for part in encoder(path)[1]), True])


_CLASS_HASH = mix(np.arange(1, INPUTS + 1, dtype=np.uint64))


def sequences(classes: list[np.ndarray], begins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's sequence of classes, and the part it is in; ids before the first that begins a word belong to none."""
    size = np.array([len(c) for c in classes], np.int64)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat, begin = np.concatenate(classes), np.concatenate(begins)
    edge = begin.copy()
    edge[(np.cumsum(size) - size)[size > 0]] = True
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(flat)))
    place = np.arange(len(flat)) - np.repeat(start, length)
    h = mix(np.add.reduceat(_CLASS_HASH[flat] * powers(int(length.max()))[place], start))
    own = begin[start]
    return h[own].view(np.int64), np.repeat(np.arange(len(size)), size)[start[own]]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in the order in which they first stand, and which of them each is; a table of hashes takes less time than a sort."""
    coded = pa.array(hashes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def find(hashes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the sorted key, and whether it is there; each distinct hash is searched once."""
    if not len(key) or not len(hashes):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    values, which = distinct(hashes)
    at = np.minimum(np.searchsorted(key, values), len(key) - 1)
    return at[which], (key[at] == values)[which]


def pieces_of(ids: np.ndarray, piece: int) -> list[np.ndarray]:
    """A text's ids cut into pieces, of a multiple of BLOCK ids; those after the first have the BLOCK + 1 ids before them in front."""
    return [ids[max(0, lo - BLOCK - 1) : lo + piece] for lo in range(0, len(ids), piece)]


def windows(classes: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input windows, targets' classes, and the piece of each window, for pieces of classes; first: whether a piece begins its text."""
    start = np.array([START], np.int64)
    inputs = [np.concatenate([start, c[:-1]]) if f else c[:-1] for c, f in zip(classes, first)]
    targets = [c if f else np.concatenate([np.full(BLOCK, PAD), c[BLOCK + 1 :]]) for c, f in zip(classes, first)]
    size = np.array([len(i) for i in inputs], np.int64)
    blocks = -(-size // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    offsets = np.concatenate([[0], np.cumsum(size)])
    piece = np.repeat(np.arange(len(size)), size)
    at = np.arange(offsets[-1]) + (base[:-1] * BLOCK - offsets[:-1])[piece]
    x, y = np.full(base[-1] * BLOCK, PAD, np.uint8), np.full(base[-1] * BLOCK, PAD, np.uint8)
    if len(at):
        x[at], y[at] = np.concatenate(inputs), np.concatenate(targets)
    x, y = x.reshape(-1, BLOCK), y.reshape(-1, BLOCK)
    before = np.full_like(x, PAD)
    before[1:] = x[:-1]
    before[base[:-1][blocks > 0]] = PAD
    real = (y != PAD).any(axis=1)
    return np.hstack([before, x])[real], y[real], np.repeat(np.arange(len(size)), blocks)[real]


def _read(batch, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of stored pieces (columns ids, no)."""
    first = batch.column("no").to_numpy() == 0
    return windows([class_of[np.frombuffer(b.as_buffer(), np.uint16)] for b in batch.column("ids")], first)


def _read_sequences(batch, class_of: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of the words that begin in stored pieces (columns ids, more, no)."""
    ids = [np.frombuffer(b.as_buffer(), np.uint16)[BLOCK + 1 if no else 0 :] for b, no in zip(batch.column("ids"), batch.column("no").to_pylist())]
    ids = [np.append(i, np.frombuffer(m.as_buffer(), np.uint16)) for i, m in zip(ids, batch.column("more"))]
    return sequences([class_of[i] for i in ids], [begins[i] for i in ids])


# --- learning on Spark -----------------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """word (hash), spelt, c: over all training texts; the end, whose spelling is null, counts once a text."""
    def counts(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                w = words(part.column("text"))
                values, which = distinct(w.hash)
                at = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))  # where each stands first
                n, data = np.bincount(which, minlength=len(values)), w.data.tobytes()
                spelt = [data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(values, END_HASH).view(np.int64)), pa.array([*spelt, None], pa.binary()).cast(pa.string()), pa.array(np.append(n, part.num_rows).astype(np.int64))],
                                                 names=["word", "spelt", "n"])

    return train.select("text").mapInArrow(counts, "word long, spelt string, n long").groupBy("word", "spelt").agg(F.sum("n").alias("c"))


def with_ids(counts: DataFrame, path: str) -> DataFrame:
    """word, c, ids: every distinct word encoded once; the end has the id after the last one."""
    def encoded(batches):
        encode, parts, _ = encoder(path)
        for batch in batches:
            ids = [[len(parts)] if s is None else encode.encode_ordinary(" " + s) for s in batch.column("spelt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "c", "ids"])

    return stored(counts.mapInArrow(encoded, "word long, c long, ids array<int>"), "lm-counts")


def id_tokens(counts: DataFrame, ids: int) -> np.ndarray:
    """How often each id stands in the training texts; the end is the last one."""
    rows = counts.select("c", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # a row for each id of the vocabulary at most
    tokens = np.zeros(ids + 1)
    tokens[rows.column("id").to_numpy()] = rows.column("c").to_numpy()
    return tokens


def sequence_sizes(counts: DataFrame, model: Model) -> DataFrame:
    """seq, size: N + V + 1 of each sequence of classes that a training word has."""
    shared = counts.sparkSession.sparkContext.broadcast((model.class_of, model.begins))

    def hashed(batches):
        class_of, begins = shared.value
        for batch in batches:
            ids = [np.array(i, np.int64) for i in batch.column("ids").to_pylist()]
            # Only the first id of a word begins one, so each row has one sequence.
            seq, _ = sequences([class_of[i] for i in ids], [begins[i] for i in ids])
            yield pa.RecordBatch.from_arrays([pa.array(seq), batch.column("c")], names=["seq", "c"])

    sums = counts.select("ids", "c").mapInArrow(hashed, "seq long, c long").groupBy("seq").agg((F.sum(F.col("c") + 1) + 1).alias("size"))
    return stored(sums, "lm-sequences")


def encoded_pieces(docs: DataFrame, held: Column, counts: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """A row for each piece of each text: doc_id, th, held_out, no, ids (two bytes each), n (words that begin in it), more (the ids of the last of these
    that stand after the piece), and what its frequent words give (known, base: sum of log10(c + 1)); tail: the hashes of the other words."""
    spark = docs.sparkSession
    total = counts.agg(F.sum("c")).first()[0] or 0
    head = counts.where(F.col("c") * HEAD_SHARE > total).toArrow()  # at most HEAD_SHARE words
    key, lists = head.column("word").to_numpy(), head.column("ids").combine_chunks()
    order = np.argsort(key.view(np.uint64))
    lists = lists.take(pa.array(order))
    shared = spark.sparkContext.broadcast((key.view(np.uint64)[order], np.log10(head.column("c").to_numpy()[order] + 1.0),
                                           lists.flatten().to_numpy().astype(np.uint16), lists.value_lengths().to_numpy().astype(np.int64)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        key, value, ids, size = shared.value
        subwords, end = Subwords(path, ids, size), np.uint16(len(encoder(path)[1]))
        end_at, end_found = find(np.array([END_HASH]), key)
        ends = float(value[end_at[0]]) if end_found[0] else 0.0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                at, found = find(w.hash, key)
                ids, edge = subwords.of(w, at, found)
                weight = np.where(found, value[at] if len(value) else 0.0, 0.0)
                rows = {c: [] for c in ("row", "no", "n", "ids", "more", "known", "base", "tail")}
                for k, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    own, begin = np.append(ids[edge[lo] : edge[hi]], end), edge[lo : hi + 1] - edge[lo]  # the end is where the last word ends
                    for no, cut in enumerate(pieces_of(own, piece)):
                        upto = min(len(own), (no + 1) * piece)
                        a, b = np.searchsorted(begin, [no * piece, upto]).tolist()
                        closes, b = b > hi - lo, min(b, hi - lo)  # whether the end is in this piece
                        after = begin[b] if b > a and not closes else upto
                        a, b = a + lo, b + lo
                        tail = w.hash[a:b][~found[a:b]].view(np.int64)
                        if closes and not end_found[0]:
                            tail = np.append(tail, np.array([END_HASH]).view(np.int64))
                        rows["row"].append(k), rows["no"].append(no), rows["n"].append(b - a + closes)
                        rows["ids"].append(cut.tobytes()), rows["more"].append(own[upto:after].tobytes())
                        rows["known"].append(int(found[a:b].sum()) + int(closes and end_found[0])), rows["base"].append(float(weight[a:b].sum()) + closes * ends), rows["tail"].append(tail)
                row = pa.array(rows["row"], pa.int64())
                flat = np.concatenate(rows["tail"]) if rows["tail"] else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in rows["tail"]])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c).take(row) for c in ("doc_id", "th", "held_out")), pa.array(rows["no"], pa.int32()), pa.array(rows["n"], pa.int64()), pa.array(rows["ids"], pa.binary()), pa.array(rows["more"], pa.binary()),
                    pa.array(rows["known"], pa.int64()), pa.array(rows["base"], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "th", "held_out", "no", "n", "ids", "more", "known", "base", "tail"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), held.alias("held_out"), "text")
    return stored(keyed.mapInArrow(encode, f"doc_id {kind}, th long, held_out boolean, no int, n long, ids binary, more binary, known long, base double, tail array<long>"), "lm-ids")


def learn_classes(train: DataFrame, tokens: np.ndarray, begins: np.ndarray, seed: int = 2) -> np.ndarray:
    """Class of each id, by the frequent ids before and after it in all training texts; ids that begin words have classes of their own."""
    end = len(tokens) - 1
    seen = np.flatnonzero(tokens[:end] > 0)
    class_of = np.append(np.where(begins[:end], UNSEEN, UNSEEN_INNER), [END, START])
    if len(seen):
        frequent = seen[np.argsort(-tokens[seen], kind="stable")][: NEIGHBOURS - 2]
        column = np.full(end + 2, NEIGHBOURS - 1, np.int64)  # of all others; the text's ends have one of their own
        column[frequent] = np.arange(len(frequent))
        column[[end, end + 1]] = NEIGHBOURS - 2

        def beside(batches):
            count = np.zeros((end + 1) * 2 * NEIGHBOURS, np.int64)
            for batch in batches:
                for no, value in zip(batch.column("no").to_pylist(), batch.column("ids")):
                    ids = np.frombuffer(value.as_buffer(), np.uint16).astype(np.int64)
                    lead = BLOCK + 1 if no else 0
                    own, before = ids[lead:], ids[lead - 1 : -1] if no else np.append(end + 1, ids[:-1])
                    for at in (own * 2 * NEIGHBOURS + column[before], ids[:-1] * 2 * NEIGHBOURS + NEIGHBOURS + column[ids[1:]] if not no else ids[lead - 1 : -1] * 2 * NEIGHBOURS + NEIGHBOURS + column[own]):
                        np.add.at(count, at, 1)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["at", "n"])

        rows = train.select("no", "ids").mapInArrow(beside, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * NEIGHBOURS for each id
        count = np.zeros((end + 1, 2 * NEIGHBOURS))
        count.reshape(-1)[rows.column("at").to_numpy()] = rows.column("n").to_numpy()

        def profile(side: np.ndarray) -> np.ndarray:
            v = np.sqrt(side[seen] + 2 * side.sum(axis=0) / max(1.0, side.sum()))
            return v / np.maximum(1e-12, np.sqrt((v * v).sum(axis=1, keepdims=True)))

        v = np.hstack([profile(count[:, :NEIGHBOURS]), profile(count[:, NEIGHBOURS:])]) / np.sqrt(2)
        inner = ~begins[seen]
        # As many classes for each kind as its share of all ids asks for, one at least.
        k = int(np.clip(round(CLASSES * tokens[seen][inner].sum() / tokens[seen].sum()), int(inner.any()), CLASSES - int((~inner).any())))
        for rows, many, base in ((np.flatnonzero(~inner), CLASSES - k, 0), (np.flatnonzero(inner), k, CLASSES - k)):
            if len(rows):
                class_of[seen[rows]] = base + k_means(v[rows], tokens[seen[rows]], many, seed)
    return class_of


def k_means(v: np.ndarray, some: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Nearest of at most k centres by cosine, for unit rows v of weights some."""
    rng = np.random.default_rng(seed)
    centre = v[rng.choice(len(v), min(k, len(v)), replace=False, p=some / some.sum())]
    for _ in range(rounds):
        own = (v @ centre.T).argmax(axis=1)
        mean = np.zeros_like(centre)
        np.add.at(mean, own, v * np.sqrt(some)[:, None])
        length = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        centre = np.where(length > 0, mean / np.maximum(length, 1e-12), centre)
    return (v @ centre.T).argmax(axis=1)


def learn_attention(train: DataFrame, class_of: np.ndarray, shares: np.ndarray) -> dict[str, np.ndarray]:
    spark = train.sparkSession
    total = (train.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 2
    groups = max(1, -(-total // (ROUNDS * GROUP_IDS)))
    place = lambda k: F.xxhash64(F.lit(k), "doc_id", "th", "no")
    dealt = train.select("th", "no", "ids", place(3).alias("place"), F.pmod(place(1), F.lit(ROUNDS)).alias("round"), F.pmod(place(2), F.lit(groups)).alias("group"))
    parameters = new_parameters(shares)
    names = list(parameters)

    def steps(now, round_):
        def learn(group):
            classes, p = now.value
            group = group.sort_by([("place", "ascending"), ("th", "ascending"), ("no", "ascending")]).combine_chunks()
            x, y, _ = _read(group, classes)
            new = local_steps(p, x, y, round_)
            n = int((y != PAD).sum())
            fine = np.rint(np.concatenate([new[c].ravel() for c in names]).astype(np.float64) * FINE).astype(np.int64) * n
            return pa.table({"n": pa.array([n], pa.int64()), "p": pa.array([fine], pa.list_(pa.int64()))})

        return learn

    for round_ in range(ROUNDS):
        now = spark.sparkContext.broadcast((class_of, parameters))
        got = dealt.where(F.col("round") == round_).groupBy("group").applyInArrow(steps(now, round_), "n long, p array<long>")
        got = got.select("n", F.posexplode("p").alias("at", "p")).groupBy("at").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p"), F.sum("n").alias("n"))
        rows = got.select("at", (F.col("p").cast("double") / F.col("n")).alias("p")).toPandas().sort_values("at")  # a row for each parameter
        now.unpersist()
        if len(rows):
            cuts = np.cumsum([parameters[c].size for c in names])[:-1]
            parameters = {c: (v / FINE).reshape(parameters[c].shape).astype(np.float32) for c, v in zip(names, np.split(rows["p"].to_numpy(), cuts))}
    return parameters


def fit(pieces: DataFrame, counts: DataFrame, path: str) -> Model:
    """From the tables of encoded_pieces and with_ids."""
    tokens, begins = id_tokens(counts, len(encoder(path)[1])), begins_word(path)
    train = pieces.where("not held_out")
    class_of = learn_classes(train, tokens, begins)
    shares = np.bincount(class_of[:-1], weights=tokens, minlength=OUTPUTS) + 1
    return Model(class_of, begins, learn_attention(train, class_of, shares / shares.sum()))


def score_texts(docs: DataFrame, held: Column, path: str | None = None, model: Model | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; model: one fitted before."""
    spark, path = docs.sparkSession, vocabulary(path)
    if len(encoder(path)[1]) + 2 > 1 << 16:
        raise ValueError("ids are stored in two bytes: the vocabulary is too large")
    counts = with_ids(word_counts(docs.where(~held)), path)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = encoded_pieces(docs, held, counts, path, piece)
    model = model or fit(pieces, counts, path)
    sizes = sequence_sizes(counts, model)
    frequent = F.col("size") * HEAD_SHARE > n + v
    head = sizes.where(frequent).toArrow()  # at most 3 * HEAD_SHARE sequences, as their sizes come to 3 (n + v) at most
    order = np.argsort(head.column("seq").to_numpy())
    shared = spark.sparkContext.broadcast((model, head.column("seq").to_numpy()[order], np.log10(head.column("size").to_numpy()[order])))
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = ["doc_id", "th", "held_out", "no", "n", "known", "base"]

    def scored(batches):
        m, key, log_size = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y, piece = _read(part, m.class_of)
                sums = np.bincount(piece, weights=score_windows(m.parameters, x, y).sum(axis=1), minlength=part.num_rows)
                seq, piece = _read_sequences(part, m.class_of, m.begins)
                at, found = find(seq, key)
                sums -= np.bincount(piece[found], weights=log_size[at[found]], minlength=part.num_rows)
                edges = np.searchsorted(piece[~found], np.arange(part.num_rows + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(edges), pa.array(seq[~found]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in facts), pa.array(sums, pa.float64()), rare], names=[*facts, "told", "rare"])

    told = stored(pieces.select(*facts, "ids", "more").mapInArrow(scored, f"doc_id {kind}, th long, held_out boolean, no int, n long, known long, base double, told double, rare array<long>"), "lm-told")
    # Equal rows come as one, with their number.
    copies = F.count_if(F.col("no") == 0)
    texts = told.groupBy("doc_id", "th", "held_out").agg(copies.alias("copies"), *[(F.sum(c) / copies).alias(c) for c in ("n", "known", "base", "told")])
    rare = pieces.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.explode("tail").alias("word"))
    rare = rare.join(counts.where(F.col("c") * HEAD_SHARE <= n).select("word", "c"), "word").groupBy("_id", "_th").agg(
        F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more_base"))
    of_rare = told.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.explode("rare").alias("seq"))
    of_rare = of_rare.join(sizes.where(~frequent), "seq").groupBy("_id", "_th").agg((-F.sum(F.log10("size"))).alias("more_told"))
    out = texts
    for more, id_, th in ((rare, "_id", "_th"), (of_rare, "_id2", "_th2")):
        more = more.withColumnsRenamed({"_id": id_, "_th": th})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("th") == F.col(th)), "left")
    both = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}") / F.col("copies"), F.lit(0.0))
    tokens = F.round("n").cast("long")
    out = out.select("doc_id", "held_out", tokens.alias("n_tokens"), F.round(both("known")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
                     (both("base") - tokens * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (both("base") + both("told")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.drop("_copy")


def op10_attention_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, held_out(F.col("doc_id"), 7, 2))
