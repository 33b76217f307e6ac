"""Conversation repair against a search that goes forward and keeps the best edits of every state."""

import hashlib
import random
import re
import zlib

import pytest

from helixlake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, copies string, part int, rows string, shut string, `a.b` string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if x == 1:
            text = ""
        if x == 2:
            text = re.sub("[.!?]", "", text)
        out += [] if x == 0 else [(conv, turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(r[3].encode()).hexdigest()))


def brute(rows):
    """All but the id of one conversation's row; rows are damaged and in order."""
    n, seen, before = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), set(), None
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, turns) in list(out.items()):
                for letter, to in moves[state].items():
                    if letter != "s":
                        new = (cost + 5, audit + "I", (*turns, "user:" if letter == "u" else "assistant:"))
                        out[to] = min(out.get(to, (9**9, "", ())), new)
        return out

    for _, _, role, text in rows:
        n["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        body = text.strip(SPACE)
        forced = not body or (role, text) in seen
        n["blank"] += not body
        n["duplicate"] += bool(body) and forced
        seen.add((role, text))
        broken = not forced and body[-1] not in ".!?"
        n["truncated"] += broken
        new = {}
        for state, (cost, audit, turns) in inserted(best).items():
            found = [(state, (cost + 2, audit + "D", turns))]
            if not forced:
                for letter, to in moves[state].items():
                    if letter == role[:1]:
                        found.append((to, (cost + 5 * broken, audit + "K", (*turns, f"{role}:{text}"))))
                    if letter != "s":
                        found.append((to, (cost + 1 + 5 * broken, audit + "R", (*turns, f"{'user' if letter == 'u' else 'assistant'}:{text}"))))
            for to, way in found:
                new[to] = min(new.get(to, (9**9, "", ())), way)
        best = new
    cost, audit, turns = min(way for state, way in inserted(best).items() if state in ("", "a"))
    known = [t for _, t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def conversations(seed, many=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ugly"]
    texts = ["Yes.", "no", "Why?", "", " \t", None, "ok!  ", "Done.\n", "é…", "日本。", "x" * 70 + ".", "x" * 70 + "!", "maybe", "Fine. And"]
    rows = [(c, rng.choice([t, t, t, None, t + 3]), rng.choice(roles[:2] if rng.random() < 0.6 else roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}{rng.choice('.?! ')}") for c in range(many) for t in range(rng.randint(1, 9))]
    rows += [(None, t % 40, roles[t % 2], rng.choice(texts)) for t in range(90)]  # no id, and larger than a piece
    rows += [(1000, t, roles[t % 5], texts[t % 14] if t % 3 else f"line {t}.") for t in range(400)]
    rows += [(1001, 5, "user", "the same.")] * 300 + [(1002, None, "assistant", f"t {k}?") for k in range(30)]
    # An id of which every row is dropped.
    gone = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return rows + [(gone, 1, "user", "Gone.")]


def wanted(rows):
    return {c: brute(damaged([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("seed,piece_rows,piece_chars", [(1, 1024, 1 << 20), (2, 3, 1 << 20), (3, 1000, 40), (4, 1, 1)])
def test_repair(spark, seed, piece_rows, piece_chars):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, "c", 1, "r", "s", "ab") for r in rows], SCHEMA)
    pieces = cr.repair(cr.damage(table), piece_rows, piece_chars)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_report(pieces).collect()}
    want = wanted(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    turns = cr.repaired_turns(pieces).orderBy("part", "no", "place").collect()
    for c in want:
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns if t.conv_id == c).encode()).hexdigest() == want[c][-1]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(t.role[:1] for t in turns if t.conv_id == c))
    # A large conversation is many pieces.
    assert piece_rows > 3 or pieces.where("conv_id = 1000").count() > 100


def test_empty_table(spark):
    assert cr.repair_report(cr.repair(cr.damage(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_costs_of_pieces_compose():
    rng = random.Random(9)
    for _ in range(200):
        steps = [(rng.random() < 0.8, rng.choice("suax"), rng.random() < 0.3, 0) for _ in range(rng.randint(0, 8))]
        cut = rng.randint(0, len(steps))
        whole, end = cr.backward(steps, cr.END)[0], cr.END
        for part in (steps[cut:], steps[:cut]):
            m = cr.matrix(part)
            end = [min(m[4 * s + t] + end[t] for t in range(4)) for s in range(4)]
        assert end == whole


@pytest.mark.parametrize("rows,audit", [
    ([("user", "a."), ("assistant", "b.")], "KK"), ([("system", "x."), ("user", "a."), ("assistant", "b.")], "KKK"), ([("assistant", "b.")], "D"), ([("user", "a."), ("user", "b.")], "KR"), ([("user", "a"), ("assistant", "b.")], "DD"),
    ([("user", "a."), ("assistant", " "), ("user", "c."), ("assistant", "d.")], "DDKK"), ([("system", "s.")], "D"), ([], ""),
])
def test_by_hand(rows, audit):
    rows = [(k, role, text, 1) for k, (role, text) in enumerate(rows)]
    steps, _ = cr.counted(rows, set())
    turns, _, _ = cr.forward(rows, steps, cr.backward(steps, cr.END), 0, True)
    assert "".join(t[0] for t in turns) == audit
