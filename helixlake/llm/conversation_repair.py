"""Repair of conversations whose turns lack, repeat, break off or come in a wrong order of roles.

Each turn is kept, given the other role, or deleted, and turns are inserted, at the least cost after which the initials of the roles read
(s?(ua)+)?. The grammar has four states: nothing yet, after s, after u, after a. A backward pass gives the cost to go from every row and
state; a forward walk then takes, among the edits that keep to that cost, the one whose initial comes first. A state and an edit's initial
leave one next state only, so this is the first of all cheapest edit strings.

Equal rows of a conversation are counted before the shuffle, so copies do not pile up. Rows are range-partitioned by conversation and place and
sorted; a stream over each partition cuts them into pieces of at most PIECE_ROWS rows or PIECE_CHARS characters. A conversation that begins and ends
within a partition and fits one piece is repaired there. Of the others, those at partition borders and the huge ones, pieces are worked
on in parallel: which turns came before (a first piece for each text's digest), then a matrix of costs from state to state for each
piece, a backward stream over the matrices, a map of states for each piece, a forward stream over those, and the edits at last. Both streams,
and the digest of a whole conversation, which is a chain by its nature, hold one piece at a time; their rows are pieces.

Defined results: null roles and texts are one space, and so are null ids and turns where damage is drawn; a null id is a conversation; turns
in order, null turns first; equal turns by role, then by the first 64 characters of the text, then by its MD5; a role without letters has no
initial that the grammar knows; repeated rows count each; an empty table gives no rows; only the four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixlake.llm.common import SPACES, shuffle_partitions, table, written

PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20
NEVER = 1 << 60
#: The state after an inserted turn, and after a kept one with this initial; the roles that insertions and new roles have.
INSERTED, KEPT = (2, 2, 3, 2), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}

ROW = [("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "long")]
COUNTERS = ["least", "most", "turns_seen", "blank", "duplicate", "truncated", "illegal", "cost", "first_turn", "last_turn"]
TURNS = "array<struct<edit: string, role: string, text: string>>"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: the row is dropped, 2: it comes twice) after the faults that the hash of id and turn draws."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(drawn == 1, "").when(drawn == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(drawn == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"),
                                F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).cast("long").alias("copies"))


# --- one piece --------------------------------------------------------------------------------------------------------


def relaxed(costs: list[int]) -> list[int]:
    """Costs to go where turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[INSERTED[s]]) for s, c in enumerate(costs)]
    return costs


#: The costs to go at the end of a conversation.
END = relaxed([0, NEVER, NEVER, 0])


def digest(role: str, text: str) -> str:
    return hashlib.md5(f"{role}\0{text}".encode()).hexdigest()


def counted(rows: list[tuple], seen: set[str]) -> tuple[list[tuple], dict]:
    """For each row (turn, role, text, copies): (stays open to choice, initial, truncated, forced deletions); and the counters but cost. seen: digests of earlier turns, which grows."""
    steps, last, turn = [], None, None
    n = dict.fromkeys(COUNTERS)
    n |= dict.fromkeys(("turns_seen", "blank", "duplicate", "truncated", "illegal"), 0) | {"first_role": None, "last_role": None}
    for at, role, text, copies in rows:
        if not copies:
            steps.append((False, "", False, 0))
            continue
        initial = role[:1]
        n["illegal"] += copies - 1 + (last is not None and last + initial not in LEGAL)
        n["first_role"], last = initial if last is None else n["first_role"], initial
        if at is not None and (n["turns_seen"] == 0 or at != turn):
            n["turns_seen"], turn = n["turns_seen"] + 1, at
            n["least"], n["most"] = at if n["least"] is None else n["least"], at
        body = text.rstrip(SPACES)
        key = digest(role, text)
        if not body:
            n["blank"] += copies
            steps.append((False, "", False, copies))
        elif key in seen:
            n["duplicate"] += copies
            steps.append((False, "", False, copies))
        else:
            seen.add(key)
            broken = body[-1] not in ".!?"
            n["truncated"] += broken
            n["duplicate"] += copies - 1
            steps.append((True, initial, broken, copies - 1))
    n["first_turn"], n["last_turn"], n["last_role"] = n["least"], n["most"], last
    return steps, n


def backward(steps: list[tuple], end: list[int]) -> list[list[int]]:
    """Costs to go before each row, without forced deletions, and at the end."""
    out = [end]
    for free, initial, broken, _ in reversed(steps):
        then = out[-1]
        if free:
            more = BROKEN * broken
            costs = [min(DELETE + then[s], more + REROLE + then[INSERTED[s]]) for s in range(4)]
            for (s, letter), to in KEPT.items():
                if letter == initial:
                    costs[s] = min(costs[s], more + KEEP + then[to])
            then = relaxed(costs)
        out.append(then)
    return out[::-1]


def forward(rows: list[tuple], steps: list[tuple], costs: list[list[int]], state: int, last: bool) -> tuple[list[tuple], int, int]:
    """Edited turns (edit, role, text), cost, and the state at the end; role and text of a deleted turn are null."""
    turns, total = [], 0

    def insert() -> None:
        nonlocal state, total
        turns.append(("I", GIVEN[state], ""))
        state, total = INSERTED[state], total + INSERT

    for (_, role, text, _), (free, initial, broken, forced), here, then in zip(rows, steps, costs, costs[1:]):
        while free:
            more = BROKEN * broken
            if DELETE + then[state] == here[state]:
                turns.append(("D", None, None))
                total += DELETE
            elif INSERT + here[INSERTED[state]] == here[state]:
                insert()
                continue
            elif (state, initial) in KEPT and more + KEEP + then[KEPT[state, initial]] == here[state]:
                turns.append(("K", role, text))
                state, total = KEPT[state, initial], total + more + KEEP
            else:
                turns.append(("R", GIVEN[state], text))
                state, total = INSERTED[state], total + more + REROLE
            break
        turns += [("D", None, None)] * forced
        total += DELETE * forced
    while last and state in (1, 2):
        insert()
    return turns, total, state


def matrix(steps: list[tuple]) -> list[int]:
    """Least costs from each state before the rows to each state behind them, row by row."""
    columns = [backward(steps, [0 if s == t else NEVER for s in range(4)])[0] for t in range(4)]
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


# --- streams ----------------------------------------------------------------------------------------------------------


def _piece_schema(id_type: pa.DataType) -> pa.Schema:
    row = pa.list_(pa.struct([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in ROW]))
    turns = pa.list_(pa.struct([(n, pa.string()) for n in ("edit", "role", "text")]))
    return pa.schema([("conv_id", id_type), ("part", pa.int32()), ("no", pa.int64()), ("rows", row), *[(c, pa.int64()) for c in COUNTERS], ("first_role", pa.string()), ("last_role", pa.string()), ("turns", turns)])


def _spark_schema(id_name: str) -> str:
    rows = ", ".join(f"{n}: {t}" for n, t in ROW)
    return f"conv_id {id_name}, part int, no long, rows array<struct<{rows}>>, {', '.join(f'{c} long' for c in COUNTERS)}, first_role string, last_role string, turns {TURNS}"


def _batches(rows, schema: pa.Schema, size: int = 256, most: int = 1 << 23):
    """Dictionaries as record batches of bounded size; each comes with its own weight."""
    held, weight = [], 0
    for row, w in rows:
        held.append(row)
        weight += w
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _named(turns: list[tuple]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in turns]


def _cut(id_type: pa.DataType, piece_rows: int, piece_chars: int):
    """For mapInArrow over sorted rows: repaired conversations, and the pieces of those that this partition does not see whole."""
    schema = _piece_schema(id_type)

    def pieces(batches):
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        held, chars, name, first, cut = [], 0, None, True, False

        def flush(whole: bool):
            nonlocal held, chars, no, cut
            if held:
                piece = {"conv_id": name, "part": part, "no": no}
                if whole:
                    steps, n = counted(held, set())
                    turns, cost, _ = forward(held, steps, backward(steps, END), 0, True)
                    piece |= n | {"cost": cost, "turns": _named(turns)}
                else:
                    piece["rows"] = [dict(zip(("turn", "role", "text", "copies"), r)) for r in held]
                yield piece, chars
            held, chars, no = [], 0, no + 1

        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if held and conv != name:
                    yield from flush(not first and not cut)
                    first, cut = False, False
                elif held and (len(held) >= piece_rows or chars >= piece_chars):
                    cut = True
                    yield from flush(False)
                name = conv
                held.append(tuple(row))
                chars += len(row[2] or "")
        yield from flush(False)

    return lambda batches: _batches(pieces(batches), schema)


def _rows(piece: dict) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"], r["copies"]) for r in piece["rows"]]


def _each(batches, columns: list[str]):
    """Pieces as dictionaries, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in columns}


def _matrices(batches):
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("costs", pa.list_(pa.int64()))])
    found = (({"part": p["part"], "no": p["no"], "costs": matrix(counted(_rows(p), set(p["seen"] or []))[0])}, 0) for p in _each(batches, ["part", "no", "rows", "seen"]))
    return _batches(found, schema)


def _ends(batches):
    """Over matrices from the last piece of a conversation to the first: the costs to go at the end of each piece."""
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("goal", pa.list_(pa.int64())), ("last", pa.bool_())])

    def found():
        name, end = object(), END
        for p in _each(batches, ["conv_id", "part", "no", "costs"]):
            last = p["conv_id"] != name
            name, end = p["conv_id"], END if last else end
            yield {"part": p["part"], "no": p["no"], "goal": end, "last": last}, 0
            end = [min(p["costs"][4 * s + t] + end[t] for t in range(4)) for s in range(4)]

    return _batches(found(), schema)


def _walked(piece: dict, state: int) -> tuple[list[tuple], int, int, dict]:
    rows = _rows(piece)
    steps, n = counted(rows, set(piece["seen"] or []))
    return *forward(rows, steps, backward(steps, piece["goal"]), state, piece["last"]), n


def _exits(batches):
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("leads", pa.list_(pa.int32()))])
    columns = ["part", "no", "rows", "seen", "goal", "last"]
    return _batches((({"part": p["part"], "no": p["no"], "leads": [_walked(p, s)[2] for s in range(4)]}, 0) for p in _each(batches, columns)), schema)


def _entries(batches):
    """Over the state maps of a conversation's pieces in order: the state in which each begins."""
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("state", pa.int32())])

    def found():
        name, state = object(), 0
        for p in _each(batches, ["conv_id", "part", "no", "leads"]):
            state = 0 if p["conv_id"] != name else state
            name = p["conv_id"]
            yield {"part": p["part"], "no": p["no"], "state": state}, 0
            state = p["leads"][state]

    return _batches(found(), schema)


def _edited(id_type: pa.DataType):
    schema = _piece_schema(id_type)

    def found(batches):
        for p in _each(batches, ["conv_id", "part", "no", "rows", "seen", "goal", "last", "state"]):
            turns, cost, _, n = _walked(p, p["state"])
            yield {"conv_id": p["conv_id"], "part": p["part"], "no": p["no"], "turns": _named(turns)} | n | {"cost": cost}, sum(len(t[2] or "") for t in turns)

    return lambda batches: _batches(found(batches), schema)


# --- the operator -----------------------------------------------------------------------------------------------------


def _by_conversation(pieces: DataFrame, descending: bool = False) -> DataFrame:
    place = [F.col(c).desc() if descending else F.col(c) for c in ("part", "no")]
    return pieces.repartition(shuffle_partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", *place)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """From conv_id, turn, role, text, copies: the repaired pieces of all conversations, in the order of part and no.

    A piece has turns (edit K, R, D or I, role, text; null role and text: deleted), its counters, and shut: the conversation has no other piece.
    """
    spark = rows.sparkSession
    real = lambda c: F.when(F.col("copies") > 0, F.col(c))
    # A dropped row leaves a mark, so that its conversation is known: it comes first and has no copies.
    marked = rows.select("conv_id", *[real(c).alias(c) for c in ("turn", "role", "text")], "copies")
    once = marked.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keys = ["conv_id", F.col("copies") > 0, "turn", "role", F.left("text", F.lit(64)), F.md5(F.col("text").cast("binary"))]
    placed = once.select("*", *[k.alias(f"k{n}") for n, k in enumerate(keys) if not isinstance(k, str)])
    order = [k if isinstance(k, str) else f"k{n}" for n, k in enumerate(keys)]
    dealt = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    id_type = rows.schema["conv_id"].dataType
    arrow, schema = to_arrow_type(id_type), _spark_schema(id_type.simpleString())
    pieces, _ = written(dealt.mapInArrow(_cut(arrow, piece_rows, piece_chars), schema), "conversation-pieces")
    shut = pieces.where("rows is null").withColumn("shut", F.lit(True))

    loose = pieces.where("rows is not null").select("conv_id", "part", "no", "rows")
    digests = F.transform(F.filter("rows", lambda r: r["copies"] > 0), lambda r: F.md5(F.concat(r["role"], F.lit("\0"), r["text"]).cast("binary")))
    texts = loose.select("conv_id", "part", "no", F.explode(F.array_distinct(digests)).alias("d"))
    again = texts.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "d").orderBy("part", "no"))).where("n > 1")
    loose, _ = written(loose.join(again.groupBy("part", "no").agg(F.collect_list("d").alias("seen")), ["part", "no"], "left"), "conversation-open")
    names = loose.select("part", "no", "conv_id")
    at = ["part", "no"]
    costs = loose.select("part", "no", "rows", "seen").mapInArrow(_matrices, "part int, no long, costs array<long>").join(names, at)
    goals, _ = written(_by_conversation(costs, descending=True).mapInArrow(_ends, "part int, no long, goal array<long>, last boolean"), "conversation-goals")
    leads = loose.join(goals, at).mapInArrow(_exits, "part int, no long, leads array<int>").join(names, at)
    states, _ = written(_by_conversation(leads).mapInArrow(_entries, "part int, no long, state int"), "conversation-states")
    mended = loose.join(goals, at).join(states, at).mapInArrow(_edited(arrow), schema).withColumn("shut", F.lit(False))
    return shut.unionByName(mended).drop("rows")


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """The turns that the conversations have then: conv_id, part, no, place (their order), edit, role, text."""
    turns = pieces.select("conv_id", "part", "no", F.posexplode("turns").alias("place", "t"))
    return turns.where("t.role is not null").select("conv_id", "part", "no", "place", "t.edit", "t.role", "t.text")


def _joined(id_type: pa.DataType):
    """Over pieces in order: one row a conversation."""
    schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in REPORT], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def found(batches):
        name, out = object(), None

        def done():
            gaps = 0 if out["least"] is None else out["most"] - out["least"] + 1 - out["turns_seen"]
            return {"conv_id": name, "gaps": gaps, "audit": "".join(out["audit"]), "repaired_sha256": out["hash"].hexdigest()} | {c: out[c] for c in REPORT[1:]}, 0

        for p in _each(batches, ["conv_id", "part", "no", *COUNTERS, "first_role", "last_role", "audit", "lines"]):
            if out is None or p["conv_id"] != name:
                if out is not None:
                    yield done()
                name, out = p["conv_id"], dict.fromkeys(("turns_seen", *REPORT[1:]), 0) | {"least": None, "most": None, "last_role": None, "audit": [], "hash": hashlib.sha256(), "begun": False}
            for c in ("turns_seen", *REPORT[1:]):
                out[c] += p[c]
            if p["first_role"] is not None:
                out["illegal"] += out["last_role"] is not None and out["last_role"] + p["first_role"] not in LEGAL
                out["last_role"] = p["last_role"]
            if p["least"] is not None:
                out["turns_seen"] -= out["most"] is not None and out["most"] == p["first_turn"]
                out["least"], out["most"] = p["least"] if out["least"] is None else out["least"], p["most"]
            out["audit"].append(p["audit"])
            if p["lines"] is not None:
                out["hash"].update((("\n" if out["begun"] else "") + p["lines"]).encode())
                out["begun"] = True
        if out is not None:
            yield done()

    return lambda batches: _batches(found(batches), schema)


def repair_report(pieces: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    stay = F.filter("turns", lambda t: t["role"].isNotNull())
    lines = F.when(F.size(stay) > 0, F.array_join(F.transform(stay, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    told = pieces.withColumn("audit", F.array_join(F.transform("turns", lambda t: t["edit"]), "")).withColumn("lines", lines)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns_seen"), F.lit(0).cast("long"))
    whole = told.where("shut").select("conv_id", gaps.alias("gaps"), *REPORT[1:], "audit", F.sha2(F.coalesce("lines", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
    id_type = pieces.schema["conv_id"].dataType
    rest = _by_conversation(told.where("not shut").drop("turns", "shut")).mapInArrow(_joined(to_arrow_type(id_type)), f"conv_id {id_type.simpleString()}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")
    return whole.unionByName(rest)


def op11_conversation_repair(spark, sf_dir):
    return repair_report(repair(damage(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c // 256, t[1 + (xor(c, b) & 255)]))) % 20 AS x FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE x WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE x <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS k FROM hurt),
seen AS (SELECT *, left(role, 1) AS letter, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS broken,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS letter_before FROM placed),
faults AS MATERIALIZED (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND broken AS truncated FROM seen),
inserts(a, b, edits, cost, turns) AS (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (3, 2, 'I', 5, ['user:']),
  (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 2, 'II', 10, ['assistant:', 'user:']), (3, 3, 'II', 10, ['user:', 'assistant:'])),
edits(a, b, edit, letter, cost, role) AS (VALUES (0, 0, 'D', NULL, 2, NULL), (1, 1, 'D', NULL, 2, NULL), (2, 2, 'D', NULL, 2, NULL), (3, 3, 'D', NULL, 2, NULL), (0, 1, 'K', 's', 0, NULL), (0, 2, 'K', 'u', 0, NULL), (1, 2, 'K', 'u', 0, NULL), (2, 3, 'K', 'a', 0, NULL),
  (3, 2, 'K', 'u', 0, NULL), (0, 2, 'R', NULL, 1, 'user'), (1, 2, 'R', NULL, 1, 'user'), (2, 3, 'R', NULL, 1, 'assistant'), (3, 2, 'R', NULL, 1, 'user')),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM conversations
  UNION ALL
  SELECT conv_id, k, state, cost, audit, turns FROM (
    SELECT f.conv_id, f.k, e.b AS state, w.cost + i.cost + e.cost + CASE WHEN f.truncated AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || i.edits || e.edit AS audit,
      list_concat(w.turns, list_concat(i.turns, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END)) AS turns
    FROM walk AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1 JOIN inserts AS i ON i.a = w.state JOIN edits AS e ON e.a = i.b AND (e.letter IS NULL OR e.letter = f.letter) AND (e.edit = 'D' OR NOT (f.blank OR f.duplicate))) AS s
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
last AS (SELECT conv_id, max(k) AS k FROM walk GROUP BY conv_id),
ended AS (SELECT w.conv_id, w.cost + i.cost AS cost, w.audit || i.edits AS audit, list_concat(w.turns, i.turns) AS turns FROM walk AS w JOIN last AS l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.k = w.k JOIN inserts AS i ON i.a = w.state AND i.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.audit || i.edits) = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
  count(*) FILTER (WHERE letter_before IS NOT NULL AND letter_before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256 FROM ended AS e LEFT JOIN sums AS s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
