"""The license scan against a plain scan with Python's regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helixlake.llm import license_scan as ls
from helixlake.llm.license_rules import BASE, CONFIDENCE, SPAN, rules

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, made string, R int, Labels string, `a.b` string"
TEXTS = [
    "", None, "...", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU Lesser General Public License, version 2.1 or later.", "SPDX-License-Identifier: GPL-3.0-only",
    "cc by cc by-sa 4.0; CC BY! All rights reserved all rights RESERVED", "general public license", "generaL public licence", "gpl " * 700, "All All rights reserved", "É cc by É", "ccby", "ccİ by", "Kpl GPL",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. The software is provided \"as is\", without warranty of any kind, express or implied", "released under the Foo Bar license", "released under the MIT license (MIT)",
    "neither the name of the Foo nor the names of its contributors", "https://creativecommons.org/licenses/by-nc-sa/4.0/", "x" * 4000 + " gpl " + "y " * 3000, "gnu general public license version", "public domain dedication and license",
]


def brute(text, known):
    words = WORD.findall((text or "").translate(FOLD))
    found = []
    for k in range(len(words)):
        ahead = " ".join(words[k : k + SPAN])
        for r in known:
            m = re.match(f"({r['pattern']})(?: |$)", ahead) if words[k] == r["key"] else None
            if m and m[1]:
                found.append((k, k + len(m[1].split(" ")), r["priority"], r["place"], r["label"]))

    def beaten(x, o):
        if x[:2] == o[:2]:
            return o[2:4] < x[2:4]
        return (o[0] <= x[0] and o[1] >= x[1] and o[2] <= x[2]) or (o[0] >= x[0] and o[1] <= x[1] and o[2] < x[2])

    near = {}
    for o in found:
        near.setdefault(o[0], []).append(o)
    stands = [x for x in found if not any(beaten(x, o) for k in range(x[0] - SPAN, x[0] + SPAN) for o in near.get(k, []) if o is not x)]
    base = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    sure = {}
    for label, c in [(x[4], CONFIDENCE[x[2]]) for x in stands] + [(label, CONFIDENCE[-1]) for _, label in base]:
        sure[label] = max(c, sure.get(label, 0))
    rest = 1.0
    for label in sorted(sure):
        rest *= 1.0 - sure[label]
    at = [k for k, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(sure)), 1.0 - rest, sorted(stands)


def mixed_texts(n=150, seed=5):
    rng = random.Random(seed)
    bits = [w for r in rules() for w in re.sub(r"\(\?:|[()?]|\[[^]]*\]\+?|\{[^}]*\}", " ", r["pattern"]).replace("|", " ").split()]
    lines = [re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", "", r["pattern"]).replace("[cs]", "c") for r in rules()]
    return [" ".join(rng.choice([rng.choice(bits), rng.choice(lines), rng.choice(list(BASE)), "filler,", "Ünd"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "m", 3, "mine", "ab") for k, t in enumerate(TEXTS + mixed_texts())]
    return spark.createDataFrame([*rows, rows[6], (None, "no id; gpl", None, None, None, None), (None, None, None, None, None, None)], SCHEMA)


def test_scan(docs):
    known = rules()
    out = ls.scan_licenses(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "made", "R", "a.b", *ls.FIELDS])
    rows = out.collect()
    assert len(rows) == docs.count() and {r.R for r in rows} == {3, None}
    for r in rows:
        want = brute(r.text, known)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], r.text
        assert r.score == pytest.approx(want[6], abs=1e-12) and 0 <= r.score <= 1
        assert sorted(tuple(f) for f in r.findings) == want[7], r.text


def test_empty_table(spark):
    assert ls.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def most_spaces(parsed):
    n = 0
    for op, av in parsed:
        name = str(op)
        if name == "LITERAL":
            n += av == 32
        elif name == "SUBPATTERN":
            n += most_spaces(av[3])
        elif name == "BRANCH":
            n += max(map(most_spaces, av[1]))
        elif name == "MAX_REPEAT":
            inner = most_spaces(av[2])
            n += inner and inner * int(av[1])
    return n


def test_rules_are_many_and_gated():
    known = rules()
    assert len(known) > 500 and len({r["place"] for r in known}) == len(known)
    for r in known:
        assert re.fullmatch(r"\w+", r["key"]) and re.match(re.escape(r["key"]) + r"(?= |$|\(\?: )", r["pattern"])
        assert most_spaces(re._parser.parse(r["pattern"])) < SPAN


def test_priority_and_containment(spark):
    known = [{"key": k, "pattern": p, "label": label, "priority": q, "place": n} for n, (k, p, label, q) in enumerate(
        [("a", "a b c", "long", 2), ("b", "b", "better", 1), ("c", "c", "worse", 3), ("d", "d e", "first", 2), ("d", "d e", "second", 2), ("e", "e f", "overlaps", 2)])]
    out = ls.scan_licenses(spark.createDataFrame([("a b c d e f",), ("a c",), ("x b c",)], "text string"), known)
    assert [[(f.begin, f.stop, f.label) for f in r.findings] for r in out.select("findings").collect()] == [[(1, 2, "better"), (3, 5, "first"), (4, 6, "overlaps")], [(1, 2, "worse")], [(1, 2, "better"), (2, 3, "worse")]]


def test_plan_has_no_python(docs):
    plan = ls.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert ls.scan_licenses(docs.select("doc_id", "text")).select(F.sum("n_base")).first()[0] > 0
