"""Fill-in-middle transformation of whole texts, and back.

A text is a rope: a balanced tree whose leaves hold runs of whole units (a word with the white space before it, or white space at the
end) and cache how many units and code points they have. Two splits at unit ranks cut it into prefix, middle and
suffix; a split walks down one path and tokenises one leaf again. The output concatenates the subtrees in their new order with
sentinels between them. The way back builds a rope of the output, splits it at the code-point ranks of the sentinels, leaves these out
and concatenates the rest. A text that holds a sentinel stays plain, so the first of each sentinel in an output is the one put there.

Each text is a row's own work: no shuffle. Defined results: a null text is the empty text, which is plain; a null id hashes as the
empty string; repeated rows are transformed alike; an empty table gives no rows; other columns stay, and the added ones
replace any of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import SPACES, column, replacing, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LEAF_UNITS, UNITS, POINTS = 256, 0, 1

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def unit_ends(data: bytes) -> np.ndarray:
    """Byte offsets at which the units of data end."""
    if not data:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(data)) if space[-1] else ends


def point_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which the code points of UTF-8 data begin."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


class Leaf:
    __slots__ = ("data", "size")

    def __init__(self, data: bytes, units: int, points: int):
        self.data, self.size = data, (units, points)

    def split(self, rank: int, by: int) -> tuple[Leaf, Leaf]:
        """At rank units or code points, which lie within; of the half units that a cut between code points may leave, the left leaf counts its own."""
        at = int(unit_ends(self.data)[rank - 1]) if by == UNITS else int(point_starts(self.data)[rank])
        left, right = self.data[:at], self.data[at:]
        units = rank if by == UNITS else len(unit_ends(left))
        points = rank if by == POINTS else len(point_starts(left))
        return Leaf(left, units, points), Leaf(right, max(self.size[UNITS] - units, 0), self.size[POINTS] - points)

    def leaves(self):
        yield self


class Node:
    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, (left.size[0] + right.size[0], left.size[1] + right.size[1])

    def leaves(self):
        todo = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Leaf):
                yield node
            else:
                todo += [node.right, node.left]


EMPTY = Leaf(b"", 0, 0)


def rope(data: bytes, leaf_units: int = LEAF_UNITS):
    """A balanced tree over data."""
    ends = unit_ends(data)
    cuts = np.append(ends[leaf_units - 1 : -1 : leaf_units], len(data)) if len(ends) else np.zeros(1, np.int64)
    starts = point_starts(data)
    level, begin, points = [], 0, 0
    for k, cut in enumerate(cuts.tolist()):
        upto = int(np.searchsorted(starts, cut))
        level.append(Leaf(data[begin:cut], min(leaf_units, len(ends) - k * leaf_units), upto - points))
        begin, points = cut, upto
    while len(level) > 1:
        level = [Node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def concat(*parts):
    out = EMPTY
    for part in parts:
        out = part if not out.size[POINTS] else out if not part.size[POINTS] else Node(out, part)
    return out


def split(node, rank: int, by: int):
    """The first rank units (or code points) of a rope, and the rest."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.size[by]:
        return node, EMPTY
    if isinstance(node, Leaf):
        return node.split(rank, by)
    if rank < node.left.size[by]:
        a, b = split(node.left, rank, by)
        return a, concat(b, node.right)
    a, b = split(node.right, rank - node.left.size[by], by)
    return concat(node.left, a), b


def _mark(sentinel: bytes) -> Leaf:
    return Leaf(sentinel, 0, len(sentinel))


def numbers(key: str) -> tuple[int, ...]:
    """The first four groups of eight digits of the key's SHA-256."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def transform(text: str, key: str, percent: int = 50, spm_percent: int = 80, leaf_units: int = LEAF_UNITS) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, number of units, and the code points of prefix and middle (None if plain)."""
    h1, h2, h3, h4 = numbers(key)
    data = text.encode()
    tree = rope(data, leaf_units)
    n = tree.size[UNITS]
    if not data or h3 % 100 >= percent or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return data, "plain", n, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(tree, low, UNITS)
    middle, suffix = split(rest, high - low, UNITS)
    if h4 % 100 < spm_percent:
        form, out = "spm", concat(_mark(SUFFIX), suffix, _mark(PREFIX), prefix, _mark(MIDDLE), middle)
    else:
        form, out = "psm", concat(_mark(PREFIX), prefix, _mark(SUFFIX), suffix, _mark(MIDDLE), middle)
    return b"".join(leaf.data for leaf in out.leaves()), form, n, prefix.size[POINTS], middle.size[POINTS]


def restore(output: bytes, form: str, leaf_units: int = LEAF_UNITS) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    order = [SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]
    at, starts = 0, point_starts(output)
    tree, parts, done = rope(output, leaf_units), {}, 0
    for k, sentinel in enumerate(order):
        at = output.index(sentinel, at)
        rank = int(np.searchsorted(starts, at))
        if k:
            parts[order[k - 1]], tree = split(tree, rank - done, POINTS)
        _, tree = split(tree, len(sentinel) + (0 if k else rank), POINTS)
        at, done = at + len(sentinel), rank + len(sentinel)
    parts[MIDDLE] = tree
    return b"".join(leaf.data for leaf in concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]).leaves())


FIELDS = "output string, form string, n long, prefix_chars long, middle_chars long"
DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _key(seed: int, id_col: str):
    return F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("")))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with output, form, n (units), prefix_chars and middle_chars; percent of the texts are transformed, spm_percent of those put the suffix first."""
    @F.pandas_udf(FIELDS)
    def made(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [transform(t or "", k, percent, spm_percent) for t, k in zip(texts, keys)]
        out = pd.DataFrame([(o.decode(), *r) for o, *r in rows], columns=["output", "form", "n", "prefix_chars", "middle_chars"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return replacing(docs, made(column(text_col), _key(seed, id_col)), ["output", "form", "n", "prefix_chars", "middle_chars"])


def restore_texts(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """rows with restored, the text before the transformation; null for a null output."""
    @F.pandas_udf("restored string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"restored": pd.Series([None if o is None else restore(o.encode(), f).decode() for o, f in zip(outputs, forms)], dtype=object)})

    return replacing(rows, back(column(output_col), column(form_col)), ["restored"])


def fill_in_middle_digests(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fill_in_middle, with the SHA-256 of output and of the text restored from it in place of the output, which stays in the Python worker."""
    @F.pandas_udf(DIGESTS)
    def made(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(texts, keys):
            output, form, n, prefix, middle = transform(t or "", k, percent, spm_percent)
            rows.append((n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return replacing(docs, made(column(text_col), _key(seed, id_col)), ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])


def op12_fill_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle_digests(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS prefix, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS middle,
  coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS suffix FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
