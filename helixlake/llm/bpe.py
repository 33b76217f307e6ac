"""Byte-level BPE encoding and decoding of whole texts.

Texts of up to chunk_chars characters are encoded where they are. A longer text is cut into chunks of chunk_chars
characters, each with overlap characters of the next one. Chunks are pre-tokenised in parallel, each from its own
start, where the first pre-tokens may be wrong. The pattern looks only ahead, so from the first place where the
boundaries of two neighbouring chunks agree, both go on alike: there the one hands over to the next. The pieces
between those places are encoded in parallel, and a text's ids are put together in order. A text in which two
neighbours find no common boundary within the overlap (a run of one kind of character longer than it) is encoded
whole, which gives the same ids. Decoding concatenates the raw bytes of the ids.

Defined results: a null text is the empty text, which has no ids; repeated rows are encoded each; an empty table gives
no rows; all columns of the input stay, and the added ones (tokens, n_tokens, ...) replace any of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import column, table, unused

CHUNK_CHARS, OVERLAP = 32_768, 2_048


def vocabulary(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder, the ids' bytes and the ids' decimal texts, loaded once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    parts = [b""] * (max(ranks.values()) + 1)
    for part, k in ranks.items():
        parts[k] = part
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), parts, [str(k) for k in range(len(parts))]


@lru_cache(maxsize=1)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def tokens_udf(path: str):
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        enc = encoder(path)[0]
        return pd.Series([np.asarray(enc.encode_ordinary(t or ""), np.int32) for t in texts], dtype=object)

    return encode


def _digests(ids: list[int], path: str) -> tuple[int, str, str]:
    _, parts, names = encoder(path)
    line, data = ",".join([names[k] for k in ids]), b"".join([parts[k] for k in ids])
    return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(data).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def text_digests_udf(path: str):
    """Encode whole texts and decode the ids again: their number and both digests."""
    @F.pandas_udf(DIGESTS)
    def digest(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(path)[0]
        return pd.DataFrame([_digests(enc.encode_ordinary(t or ""), path) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def token_digests_udf(path: str):
    @F.pandas_udf(DIGESTS)
    def digest(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digests(list(ids), path) for ids in tokens], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("head", "tail")]))
def boundaries(chunk: pd.Series, at: pd.Series, size: pd.Series, overlap: pd.Series, final: pd.Series) -> pd.DataFrame:
    """Starts of pre-tokens, as positions in the text: those in the first overlap characters (head) and those after size (tail).

    A start within two characters of the end of a chunk that is not the last could differ in the whole text.
    """
    head, tail = [], []
    for text, begin, chars, more, last in zip(chunk, at, size, overlap, final):
        starts = np.fromiter((m.start() for m in pattern().finditer(text)), np.int64)
        if not last:
            starts = starts[starts < len(text) - 2]
        head.append((starts[starts < more] + begin).astype(np.int32))
        tail.append((starts[starts >= chars] + begin).astype(np.int32))
    return pd.DataFrame({"head": head, "tail": tail})


def _pieces(long: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """From (_key, _text): rows (_key, _no, _piece) of each distinct text; a null piece where neighbours found no common boundary.

    Chunks are shuffled once; what decides on the pieces are short lists of boundaries.
    """
    n = F.ceil(F.length("_text") / chunk_chars).cast("int")
    rows = long.select("_key", "_text", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_no")).withColumn("_at", F.col("_no") * chunk_chars)
    rows = rows.withColumn("_chunk", F.expr(f"substring(_text, _at + 1, {chunk_chars + overlap})")).drop("_text")
    rows = rows.repartition("_key", "_no").dropDuplicates(["_key", "_no"])
    final = F.col("_no") == F.col("_n") - 1
    found = rows.select("_key", "_no", "_n", "_at", F.length("_chunk").alias("_size"), boundaries("_chunk", "_at", F.lit(chunk_chars), F.lit(overlap), final).alias("_b"))
    order = Window.partitionBy("_key").orderBy("_no")
    found = found.withColumn("_over", F.array_min(F.array_intersect("_b.tail", F.lead("_b.head").over(order))))
    found = found.withColumn("_from", F.when(F.col("_no") == 0, 0).otherwise(F.lag("_over").over(order)))
    found = found.select("_key", "_no", "_from", F.when(final, F.col("_at") + F.col("_size")).otherwise(F.col("_over")).alias("_upto"))
    return rows.join(found, ["_key", "_no"]).select("_key", "_no", F.expr("substring(_chunk, _from - _at + 1, _upto - _from)").alias("_piece"))


def _encoded(docs: DataFrame, whole, pieces, finish, chunk_chars: int, overlap: int, text_col: str, made: str) -> DataFrame:
    """docs with the struct made: whole makes it of a text, finish of the ids of a long text's pieces, which pieces encodes."""
    size = F.coalesce(F.length(text_col), F.lit(0))
    key = unused(docs, "key")
    columns = [*map(column, docs.columns), F.col(made)]
    short = docs.where(size <= chunk_chars).withColumn(made, whole(F.coalesce(text_col, F.lit(""))))
    long = docs.where(size > chunk_chars).withColumn(key, F.md5(F.col(text_col).cast("binary")))
    cut = _pieces(long.select(F.col(key).alias("_key"), F.col(text_col).alias("_text")), chunk_chars, overlap).withColumn("_ids", pieces(F.coalesce("_piece", F.lit(""))))
    per = cut.groupBy(F.col("_key").alias(key)).agg(F.bool_and(F.col("_piece").isNotNull()).alias("_whole"), F.array_sort(F.collect_list(F.struct("_no", "_ids"))).alias("_list"))
    done = per.where("_whole").select(key, finish(F.flatten(F.transform("_list", lambda p: p["_ids"]))).alias(made))
    left = long.join(per.where("not _whole").select(key), key, "left_semi").withColumn(made, whole(text_col))
    return short.select(*columns).unionByName(long.join(done, key).select(*columns)).unionByName(left.select(*columns))


def encode(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """docs with the column tokens, the ids of the whole text."""
    docs, ids = docs.drop("tokens"), tokens_udf(vocabulary(path))
    made = unused(docs, "made")
    out = _encoded(docs, lambda t: F.struct(ids(t).alias("tokens")), ids, lambda k: F.struct(k.alias("tokens")), chunk_chars, overlap, text_col, made)
    return out.select(*map(column, docs.columns), f"{made}.tokens")


def decode(encoded: DataFrame, path: str | None = None, tokens_col: str = "tokens") -> DataFrame:
    """Add decoded: the ids' bytes, concatenated; null ids give null."""
    path = vocabulary(path)

    @F.pandas_udf("binary")
    def raw(tokens: pd.Series) -> pd.Series:
        parts = encoder(path)[1]
        return pd.Series([None if ids is None else b"".join([parts[k] for k in ids]) for ids in tokens], dtype=object)

    return encoded.withColumn("decoded", raw(tokens_col))


def encode_digests(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the bytes decoded from them."""
    docs, path = docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), vocabulary(path)
    made = unused(docs, "made")
    out = _encoded(docs, text_digests_udf(path), tokens_udf(path), token_digests_udf(path), chunk_chars, overlap, text_col, made)
    return out.select(*map(column, docs.columns), *[F.col(made)[c].alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


def op8_byte_bpe(spark, sf_dir):
    out = encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
