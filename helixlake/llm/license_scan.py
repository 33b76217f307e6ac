"""License scan of whole texts by ordered signature rules, in built-in functions alone.

A text becomes a list of words. One expression over the whole text is the first gate: a text without any keyword is done. The second gate is
the word: only where a rule's keyword stands are the rules of that keyword read, each against the words from there on.
A finding is an interval of words with a rule's priority and place in the order. Of findings of one interval that of best priority stays, then
that of the first rule; a finding within another one of the same priority or a better one goes, and so does one that holds another of a
better priority. Rules take SPAN words at most, so only the findings of the SPAN - 1 places before and after can decide, and the work is
linear in the text. All of it happens within a row: no shuffle, and a hot key is no matter.

Base phrases are counted wherever they stand, whatever suppresses them, and their labels are always among the labels. The score is the chance that
one of the labels is right, taking each at the best of its findings' confidences and all as independent.

Defined results: a null text is the empty text (no words, no labels, score 0); repeated rows are scanned each; an empty table gives no rows; other
columns stay, and the added ones replace any of the same name.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import LOWER, UPPER, ascii_lower, column, replacing, table
from helixlake.llm.license_rules import BASE, CONFIDENCE, SPAN, rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "pattern: string, label: string, priority: int, place: int"
FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "findings"]


def folded(text: Column) -> Column:
    """A-Z to a-z. Texts of ASCII alone take the built-in that is fast for them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def _keywords(table_of_rules: list[dict]) -> str:
    """One expression for all keywords, those of one first letter together."""
    by_letter: dict[str, list[str]] = {}
    for key in sorted({r["key"] for r in table_of_rules}):
        by_letter.setdefault(key[0], []).append(re.escape(key[1:]))
    return "(?:" + "|".join(f"{re.escape(letter)}(?:{'|'.join(rest)})" for letter, rest in by_letter.items()) + ")"


def _rule_map(table_of_rules: list[dict]) -> Column:
    """Rules by keyword, as one constant."""
    by_key: dict[str, list[dict]] = {}
    for r in table_of_rules:
        by_key.setdefault(r["key"], []).append({"pattern": f"^({r['pattern']})(?: |$)", "label": r["label"], "priority": r["priority"], "place": r["place"]})
    return F.from_json(F.lit(json.dumps(by_key)), f"map<string, array<struct<{RULE}>>>")


def _bind(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _places(words: Column, known: list[dict]) -> Column:
    """For each place of a keyword where rules hold: an array of their findings (begin, stop, priority, place, label)."""
    starts = F.filter(F.transform(words, lambda w, k: F.when(w.rlike(f"^{_keywords(known)}$"), k)), lambda k: k.isNotNull())
    own = _rule_map(known)

    def at(k: Column) -> Column:
        def read(window: Column) -> Column:
            found = F.transform(F.try_element_at(own, F.get(words, k)), lambda r: F.struct(F.call_function("regexp_extract", window, r["pattern"], F.lit(1)).alias("m"), r.alias("r")))
            size = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
            return F.transform(F.filter(found, lambda f: f["m"] != ""), lambda f: F.struct(
                k.alias("begin"), (k + size(f["m"])).alias("stop"), f["r"]["priority"].alias("priority"), f["r"]["place"].alias("place"), f["r"]["label"].alias("label")))

        return _bind(F.array_join(F.slice(words, k + 1, SPAN), " "), read)

    return F.filter(F.transform(starts, at), lambda found: F.size(found) > 0)


def _standing(places: Column) -> Column:
    """The findings that no other one suppresses, in order."""
    def beaten(x: Column, o: Column) -> Column:
        same = (o["begin"] == x["begin"]) & (o["stop"] == x["stop"])
        earlier = (o["priority"] < x["priority"]) | ((o["priority"] == x["priority"]) & (o["place"] < x["place"]))
        around = (o["begin"] <= x["begin"]) & (o["stop"] >= x["stop"]) & (o["priority"] <= x["priority"])
        within = (o["begin"] >= x["begin"]) & (o["stop"] <= x["stop"]) & (o["priority"] < x["priority"])
        return F.when(same, earlier).otherwise(around | within)

    def kept(found: Column, n: Column) -> Column:
        near = F.flatten(F.slice(places, F.greatest(n - SPAN + 2, F.lit(1)), 2 * SPAN))
        return _bind(near, lambda others: F.filter(found, lambda x: ~F.exists(others, lambda o: beaten(x, o))))

    return F.flatten(F.transform(places, kept))


def _base_starts(words: Column) -> Column:
    """The places of base phrases, as structs (begin, label)."""
    phrases = [(p.split(" "), label) for p, label in BASE.items()]
    stands = lambda w, k, p: F.when(w == p[0], F.array_join(F.slice(words, k + 1, len(p)), " ") == " ".join(p))

    def label(w: Column, k: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, name in phrases:
            out = F.when(F.coalesce(stands(w, k, p), F.lit(False)), name).otherwise(out)
        return F.struct(k.alias("begin"), out.alias("label"))

    return F.filter(F.transform(words, label), lambda x: x["label"].isNotNull())


def _score(findings: Column, labels: Column) -> Column:
    sure = F.array(*map(F.lit, CONFIDENCE))
    best = F.transform(labels, lambda name: F.array_max(F.transform(F.filter(findings, lambda f: f["label"] == name), lambda f: F.get(sure, f["priority"]))))
    return 1.0 - F.aggregate(best, F.lit(1.0), lambda rest, c: rest * (1.0 - F.coalesce(c, F.lit(0.0))))


def scan_licenses(docs: DataFrame, known: list[dict] | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and findings: the intervals that stand, with label, priority and rule."""
    known = rules() if known is None else known
    text = F.coalesce(column(text_col), F.lit(""))
    gate = f"(?<![0-9a-z\\x{{80}}-\\x{{10FFFF}}]){_keywords(known + [{'key': p.split(' ')[0]} for p in BASE])}(?![0-9a-z\\x{{80}}-\\x{{10FFFF}}])"
    nothing = F.struct(F.lit(0).cast("long").alias("n_base"), *[F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")],
                       *[F.lit("").alias(c) for c in ("base_labels", "labels")], F.lit(0.0).alias("score"), F.array().cast("array<struct<begin: int, stop: int, priority: int, place: int, label: string>>").alias("findings"))

    def report(base: Column, findings: Column) -> Column:
        at = F.transform(base, lambda b: b["begin"])
        base_labels = F.array_distinct(F.transform(base, lambda b: b["label"]))
        names = F.array_distinct(F.transform(findings, lambda f: f["label"]))
        join = lambda xs: F.array_join(F.array_sort(xs), ",")
        own = F.concat(findings, F.transform(base, lambda b: F.struct(b["begin"].alias("begin"), b["begin"].alias("stop"), F.lit(len(CONFIDENCE) - 1).alias("priority"), F.lit(-1).alias("place"), b["label"].alias("label"))))
        return F.struct(F.size(base).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
                        join(base_labels).alias("base_labels"), join(F.array_union(base_labels, names)).alias("labels"), _score(own, F.array_sort(F.array_union(base_labels, names))).alias("score"), findings.alias("findings"))

    def scan(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))
        found = lambda w: _bind(_base_starts(w), lambda base: _bind(_places(w, known), lambda places: _bind(_standing(places), lambda f: report(base, f))))
        r = F.when(low.rlike(gate), _bind(words, found)).otherwise(nothing)
        n = F.regexp_count(low, F.lit(WORD)).cast("long")
        return _bind(r, lambda r: F.struct(n.alias("n_words"), *[r[c].alias(c) for c in FIELDS[1:]]))

    return replacing(docs, _bind(folded(text), scan), FIELDS)


def op13_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *FIELDS[:-1])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(known: list[dict]) -> str:
    listed = ",\n".join(f"({_quoted(r['key'])}, {_quoted('^(' + r['pattern'] + ')(?: |$)')}, {_quoted(r['label'])}, {r['priority']}, {r['place']})" for r in known)
    base = ", ".join(f"({_quoted(p)}, {_quoted(label)}, {len(p.split(' '))})" for p, label in BASE.items())
    return rf"""
WITH rules(key, pattern, label, priority, place) AS (VALUES {listed}),
phrases(phrase, label, size) AS (VALUES {base}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM docs),
near AS MATERIALIZED (SELECT doc_id, word, k - 1 AS k, array_to_string(words[k:k + {SPAN - 1}], ' ') AS ahead FROM spots WHERE word IN (SELECT key FROM rules UNION SELECT string_split(phrase, ' ')[1] FROM phrases)),
base AS (SELECT doc_id, k, label FROM near JOIN phrases ON ahead = phrase OR starts_with(ahead, phrase || ' ')),
met AS MATERIALIZED (SELECT doc_id, k, label, priority, place, regexp_extract(ahead, pattern, 1) AS m FROM near JOIN rules ON word = key),
found AS MATERIALIZED (SELECT doc_id, k AS lo, k + len(string_split(m, ' ')) AS hi, label, priority, place FROM met WHERE m <> ''),
stands AS (SELECT * FROM found AS x WHERE NOT EXISTS (SELECT 1 FROM found AS o WHERE o.doc_id = x.doc_id AND CASE WHEN o.lo = x.lo AND o.hi = x.hi THEN o.priority < x.priority OR (o.priority = x.priority AND o.place < x.place)
  ELSE (o.lo <= x.lo AND o.hi >= x.hi AND o.priority <= x.priority) OR (o.lo >= x.lo AND o.hi <= x.hi AND o.priority < x.priority) END)),
sure AS (SELECT doc_id, label, max(CAST({[float(c) for c in CONFIDENCE]}[priority + 1] AS DOUBLE)) AS c FROM (SELECT doc_id, label, priority FROM stands UNION ALL SELECT doc_id, label, {len(CONFIDENCE) - 1} FROM base) AS u GROUP BY doc_id, label),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, 1 - list_reduce(list_prepend(CAST(1 AS DOUBLE), list(c ORDER BY label)), lambda a, c: a * (1 - c)) AS score FROM sure GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_base, CAST(c.a AS BIGINT) AS first_word, CAST(c.b AS BIGINT) AS last_word, coalesce(c.labels, '') AS base_labels,
  coalesce(n.labels, '') AS labels, coalesce(n.score, CAST(0 AS DOUBLE)) AS score FROM docs AS d LEFT JOIN counted AS c ON c.doc_id = d.doc_id LEFT JOIN named AS n ON n.doc_id = d.doc_id
"""


OP13_SQL = oracle(rules())
