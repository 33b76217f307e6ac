"""Words of whole Arrow text columns as numpy arrays: one pass over the bytes, no Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a slice by itself.
SLICE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Words of more bytes are hashed one by one.
_LONG = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

SEPARATORS = {"white": _WHITE, "not_alnum": _NOT_ALNUM}


class Words(NamedTuple):
    """Words of n texts: byte ranges in data, 64-bit hashes, and for each text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1 offsets into the words


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _PRIME, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time for all words at once, longer words by a digest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _PRIME
    rows = np.flatnonzero(size <= _LONG) if size.max(initial=0) > _LONG else slice(None)
    at, left, h = start[rows], size[rows], out[rows]
    while True:
        h = (h ^ (eights[at] & _MASK[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        more = left > 8
        if not more.any():
            break
        out[rows] = h
        rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
        at, left, h = at[more] + 8, left[more] - 8, h[more]
    out[rows] = h
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; null counts as empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about most bytes of text."""
    _, offsets = raw(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(texts: pa.Array, separators: str = "white", lower: bool = True) -> Words:
    """Split texts at separator bytes; A-Z lower-cased where lower is set."""
    data, offsets = raw(texts)
    n, size = len(texts), len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
    inside = ~SEPARATORS[separators][data]
    begins = np.zeros(size + 1, dtype=bool)
    begins[offsets] = True
    starts = inside & begins[:size]
    starts[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & begins[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    ends[-1] = inside[-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    folded = _FOLD[data] if lower else data
    hashes = _word_hashes(folded, start, end) if len(start) else np.zeros(0, np.uint64)
    return Words(folded, start, end, hashes, np.searchsorted(start, offsets))


def shingles(w: Words, width: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; fewer words than width: the whole sequence as one."""
    out, n = [], len(w.hash)
    factor = powers(width)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled += w.hash[k : n - width + 1 + k] * factor[k]
        rolled = mix(rolled)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.array([(w.hash[lo:hi] * factor[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
