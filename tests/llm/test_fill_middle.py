"""Fill-in-middle against regular expressions and slices of lists."""

import hashlib
import re

import pytest

from helixlake.llm import fill_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "a", " a", "a ", "one two  three\n\nfour\t", "é日本 語😀 x", "<P> here", "so <S", "S> M> <M", "w " * 3000, "x" * 5000, "\n" * 700, "ends with <", "<M> in it", "    y", "a\x00b c\x1fd"]
SCHEMA = "doc_id long, text string, Output string, form int, made string, `a.b` string"


def plain(doc_id, text, percent, spm):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return text, "plain", len(units), None, None
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (f"<S>{s}<P>{p}<M>{m}", "spm") if h[3] % 100 < spm else (f"<P>{p}<S>{s}<M>{m}", "psm"), len(units), len(p), len(m)


def flat(x):
    return (*x[0], *x[1:]) if isinstance(x[0], tuple) else x


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "mine", 5, "m", "ab") for k, t in enumerate(TEXTS * 12)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id at all", None, None, None, None), (None, None, None, None, None, None)], SCHEMA)


@pytest.mark.parametrize("percent,spm", [(50, 80), (100, 50), (0, 80)])
def test_outputs_and_the_way_back(docs, percent, spm):
    made = fim.fill_in_middle(docs, percent=percent, spm_percent=spm)
    assert sorted(made.columns) == sorted(["doc_id", "text", "made", "a.b", "output", "form", "n", "prefix_chars", "middle_chars"])
    rows = fim.restore_texts(made).collect()
    got = sorted(repr((r.doc_id, r.text, r.output, r.form, r.n, r.prefix_chars, r.middle_chars)) for r in rows)
    assert got == sorted(repr((r.doc_id, r.text, *flat(plain(r.doc_id, r.text, percent, spm)))) for r in docs.collect())
    assert all(r.restored == (r.text or "") for r in rows)
    assert percent != 100 or {r.form for r in rows} == {"plain", "spm", "psm"}


def test_digests(docs):
    for r in fim.fill_in_middle_digests(docs).collect():
        want = flat(plain(r.doc_id, r.text, 50, 80))
        assert (r.form, r.n, r.prefix_chars, r.middle_chars) == want[1:]
        assert r.output_sha256 == hashlib.sha256(want[0].encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle_digests(docs).collect() == [] and fim.restore_texts(fim.fill_in_middle(docs)).collect() == []


@pytest.mark.parametrize("leaf", [1, 2, 7])
def test_ropes_cut_as_lists_do(leaf):
    text = " ".join(f"w{k}é" for k in range(40)) + " \n"
    data, units = text.encode(), UNIT.findall(text)
    tree = fim.rope(data, leaf)
    assert tree.size == (len(units), len(text)) and all(x.size == (len(UNIT.findall(x.data.decode())), len(x.data.decode())) for x in tree.leaves())
    whole = lambda node: b"".join(x.data for x in node.leaves()).decode()
    for rank in range(len(units) + 1):
        left, right = fim.split(tree, rank, fim.UNITS)
        assert (whole(left), whole(right)) == ("".join(units[:rank]), "".join(units[rank:]))
        again, rest = fim.split(fim.concat(right, left), len(units) - rank, fim.UNITS)
        assert whole(again) + "|" + whole(rest) == whole(right) + "|" + whole(left)
    for rank in range(0, len(text) + 1, 3):
        left, right = fim.split(tree, rank, fim.POINTS)
        assert (whole(left), whole(right)) == (text[:rank], text[rank:])
    for seed in range(60):
        out, form, *_ = fim.transform(text, f"{seed}:x", 100, 50, leaf)
        assert fim.restore(out, form, leaf) == data
