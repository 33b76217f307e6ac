"""Genotype text: rule tables, and random files against a plain Python model of the rules."""

import random
import re

import pytest

from helixlake.sources import files, genotype_text
from helixlake.sources.genotype_text import ALIASES, DEFAULT_HEADER


def parse(spark, tmp_path, texts):
    paths = []
    for k, text in enumerate(texts):
        p = tmp_path / f"f{k:04d}.txt"
        p.write_bytes(text.encode())
        paths.append(str(p))
    rows = genotype_text.read_genotypes(spark, paths).orderBy("file_path", "line_no").collect()
    return [[r for r in rows if r.file_path.endswith(f"f{k:04d}.txt")] for k in range(len(texts))]


T = "\t".join
CASES = [
    (T(["# rsid", "chromosome", "position", "genotype", "gs", "baf", "lrr"]) + "\n" + T(["rs7537756", "1", "918870", "AA", "0.8847", "0", "-0.1875"]), 1, 0),
    ('rsid,chromosome,position,allele1,allele2\n"rs1","1","100","A","G"', 1, 0),
    ("rs1 1 100 AG\nrs2 X 5 CC", 2, 0),
    (T(["rs1", "1", "100"]) + "\n" + T(["rs2", "1", "200", "AA"]), 0, 2),
    ("rsid\tchromosome\tposition\tgenotype\n\t1\t5\tAA\nrs2\t\t5\tAA\nrs3\t1\tx\tAA\nrs4\t1\t5\t\nrs5\t1\t+5\tAA\nrs6\t1\t99999999999999999999\tAA", 1, 5),
    ("id\trsid\tchr\tpos\tgt\ni1\trs1\t1\t5\tAA\n\trs2\t1\t6\tAA", 2, 0),
    ("rsid\tchromosome\tposition\tgenotype\nrs1\t1\t5\tAA // note\nrs2\t1\t6\t#gone", 1, 1),
    ("rsid\tchromosome\tposition\tgenotype\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t5\tAA", 1, 1),
    ("## rsid\tchr\tpos\tcode\n// marker\tchrom\tposition\tresult\nrs1\t1\t5\tAA", 1, 0),
    ("rsid\tchromosome\tposition\tgenotype\tgenotype\nrs1\t1\t5\tAA\t", 0, 1),
    ("RS-ID\tChr_\tBase Pair Position\tYour Code\r\nrs1\t1\t5\tAA\r\n", 1, 0),
    ('rsid,chromosome,position,genotype\nab"c,d"e,1,5,AA\n"x""y",1,6,AA', 2, 0),
    ("# only\n\n// comments\n", 0, 0),
]


def test_rule_table(spark, tmp_path):
    got = parse(spark, tmp_path, [c[0] for c in CASES])
    assert [(sum(r.outcome == "parsed" for r in rows), sum(r.outcome == "skipped" for r in rows)) for rows in got] == [c[1:] for c in CASES]
    assert [r.rsid for r in got[5]] == ["i1", "rs2"]
    assert [r.rsid for r in got[11]] == ["abc,de", 'x"y']
    assert (got[1][0].allele1, got[1][0].allele2, got[6][0].genotype, got[4][4].position) == ("A", "G", "AA", 5)


def model(text):
    """The rules in Python: outcome, rsid, position, genotype of each data line."""
    def quoted(line):
        out, now, inside, k = [], "", False, 0
        while k < len(line):
            c = line[k]
            if c == '"':
                if inside and line[k + 1 : k + 2] == '"':
                    now, k = now + '"', k + 1
                else:
                    inside = not inside
            elif c == "," and not inside:
                out.append(now)
                now = ""
            else:
                now += c
            k += 1
        return [x.strip() for x in [*out, now]]

    fields = lambda line, d: [x.strip() for x in line.split("\t")] if d == "T" else quoted(line) if d == "C" else line.split()
    name = lambda x: re.sub(r"[ \t_-]", "", x).lower()
    head_like = lambda f: bool(f) and name(f[0]) in ALIASES["rsid"]
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    data = lambda x: x.strip() and not x.strip().startswith(("#", "//"))
    d = next((k for x in lines[:2048] if data(x) for k in ["T" if "\t" in x else "C" if "," in x else "S" if len(x.split()) > 1 else None] if k), "T")
    header, comment, out = None, None, []
    for x in lines:
        t = x.strip()
        if not t:
            continue
        if not data(x):
            mark = "#" if t.startswith("#") else "//"
            while t.startswith(mark):
                t = t[len(mark) :]
            if header is None and head_like(f := fields(t.strip(), d)):
                comment = f
            continue
        f = fields(x, d)
        if header is None:
            if head_like(f):
                header = [name(h) for h in f]
                continue
            header = [name(h) for h in comment] if comment else DEFAULT_HEADER[: len(f)]
        strip = lambda v: v.strip().split("#")[0].split("//")[0].strip()
        row = {h: strip(v) for h, v in zip(header, f)}
        get = lambda c: next((row[a] for a in ALIASES[c] if row.get(a)), None)
        pos = get("position")
        pos = int(pos) if pos and re.fullmatch(r"[+-]?[0-9]+", pos) and -(2**63) <= int(pos) < 2**63 else None
        ok = get("rsid") and get("chromosome") and pos is not None and (get("genotype") or get("allele1") or get("allele2"))
        out.append(("parsed" if ok else "skipped", get("rsid"), pos, get("genotype")))
    return out


def test_random_files(spark, tmp_path):
    rng = random.Random(5)
    names = ["rsid", "id", "chr", "Chromosome", "pos", "position", "genotype", "call", "allele1", "Allele2 - Top", "junk", "genotype"]
    values = ["rs1", "1", "22", "5", "+7", "x", "AA", "", " ", "A # c", "G//", '"q, r"', '"a""b"', "99999999999999999999"]
    texts = []
    for _ in range(250):
        mark = rng.choice(["\t", ",", " ", "\t"])
        head = mark.join(rng.choice(names) if k else rng.choice(["rsid", "RS ID", "snp", "name", "foo"]) for k in range(rng.randint(3, 7)))
        lines = [rng.choice(["", "# note", "// x", head, "# " + head, "## " + head])] if rng.random() < 0.8 else []
        for _ in range(rng.randint(0, 7)):
            lines.append(rng.choice(["", "# z", "# " + head, head]) if rng.random() < 0.15 else mark.join(rng.choice(values) for _ in range(rng.randint(1, 7))))
        texts.append(rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"]))
    texts = [t or "\n" for t in texts]
    got = parse(spark, tmp_path, texts)
    for text, rows in zip(texts, got):
        assert [(r.outcome, r.rsid, r.position, r.genotype) for r in rows] == model(text), text


def test_line_numbers_over_splits(spark, tmp_path):
    p = tmp_path / "long.txt"
    p.write_text("".join(f"rs{k}\t1\t{k}\tAA\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        lines = genotype_text.read_lines(spark, [str(p)])
        assert lines.where("value <> concat('rs', line_no, '\t1\t', line_no, '\tAA')").count() == 0 and lines.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_discovery(spark, tmp_path):
    for n in ("a.txt", "B.TSV", "c.csv", "noext", "_h.txt", ".d.txt", "e.gz"):
        (tmp_path / n).write_text("x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "z.txt").write_text("x")
    found = [p.split("/")[-1] for p in files.discover(spark, [tmp_path, tmp_path / "a.txt"])]
    assert sorted(found) == sorted(["a.txt", "B.TSV", "c.csv", "noext", "_h.txt", ".d.txt", "z.txt"])
    (tmp_path / "deep" / "er").mkdir()
    (tmp_path / "deep" / "er" / "y").write_text("x")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    assert sorted(p.split("/")[-1] for p in files.discover(spark, [tmp_path])) == sorted([*found, "y"]) and files.discover(spark, [f"file://{tmp_path}/deep"])[0] == str(tmp_path / "deep" / "er" / "y")
    assert files.discover(spark, [tmp_path / "e.gz"]) and len(files.discover(spark, [tmp_path], 2)) == 2
    for bad in ([], [tmp_path / "none"]):
        with pytest.raises((ValueError, FileNotFoundError)):
            files.discover(spark, bad)


def test_hidden_and_empty_files(spark, tmp_path):
    (tmp_path / "_h.txt").write_text("rs1 1 5 AA\n")
    (tmp_path / "a.txt").write_text("rs2 1 5 AA\n")
    (tmp_path / "empty.txt").write_text("")
    good, failures = files.split_failures(spark, files.discover(spark, [tmp_path]))
    assert [r.file_path.split("/")[-1] for r in failures.collect()] == ["empty.txt"]
    rows = genotype_text.read_genotypes(spark, good).collect()
    assert sorted((r.file_path.split("/")[-1], r.rsid) for r in rows) == [("_h.txt", "rs1"), ("a.txt", "rs2")]


def test_heads_are_short_and_enough(spark, tmp_path):
    """What is read of each file's beginning gives the rows that all lines give."""
    texts = {
        "tab.txt": "# rsid\tchr\tpos\tgenotype\n" + "".join(f"rs{k}\t1\t{k}\tAA\n" for k in range(30_000)), "a b é.txt": "rs1,1,5,AA\n", "_hidden.txt": "## id\tchrom\tposition\tcall\n\nrs1\t1\t7\tAG\n", "none.txt": "\n \n# x\n",
        "late.txt": "\n" * 5000 + "// marker\tchrom\tpos\tgt\nrs1\t1\t5\tAA\n", "bare.txt": "one\n" * 3000 + "rs1\t1\t5\tAA\n", "edge.txt": "x\n" * 2047 + "rs1,1,5,AA\n", "over.txt": "x\n" * 2048 + "rs1,1,5,AA\n",
        "thin.txt": "\u2003\n\u2003rs1\u20031 5 AA\u2003\n", "last.txt": "rs1\t1\t5\tAA", "empty.txt": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / name) for name in texts]
    heads = genotype_text.read_heads(spark, paths)
    sizes = {r.file_path.rsplit("/", 1)[1]: r["count"] for r in heads.groupBy("file_path").count().collect()}
    assert sizes["tab.txt"] == 2 and sizes["late.txt"] == 5002 and sizes["bare.txt"] == 2048 and sizes["edge.txt"] == 2048 and sizes["over.txt"] == 2048 and "empty.txt" not in sizes
    shown = [p for p in paths if "_hidden" not in p]
    lines = genotype_text.read_lines(spark, shown)
    named = heads.join(lines, ["file_path", "line_no"]).select(heads["value"].alias("a"), lines["value"].alias("b"))
    assert named.count() == sum(n for f, n in sizes.items() if f != "_hidden.txt") and named.where("a <> b").isEmpty()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(genotype_text.parse_lines(lines, genotype_text.read_heads(spark, shown))) == rows(genotype_text.parse_lines(lines))
    whole = genotype_text.read_genotypes(spark, paths)
    assert {r.position for r in whole.where("file_path like '%_hidden.txt'").collect()} == {7} and whole.where("outcome = 'parsed'").count() == 30_005
    plan = genotype_text.parse_lines(genotype_text.read_lines(spark, shown), genotype_text.read_heads(spark, shown))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2 and "Python" not in plan and "MapInArrow" not in plan


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    text = "".join(f"line {k} " + "x" * (k % 50) + "\n" for k in range(4000))
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = genotype_text.read_lines(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")])
        assert lines.select("file_path", "line_no").distinct().count() == 8000
        assert lines.where("value not like concat('line ', line_no, ' %')").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
