"""Repair of conversation structure: the cheapest edits, by divide and conquer over four-state cost vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.plans.session import cut

# What edits cost, legal neighbours, white space, and the ends of whole sentences.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
BLANK = " \t\n\x0b\x0c\r"
FULL = ".!?"
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. Turns that may follow.
STATES, START = 4, 0
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {2: "user", 3: "assistant"}
#: What the end of a conversation costs in a state, and the inserted turns that it takes.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
FAULTS = ("", "blank", "duplicate", "truncated")

Vector = tuple[int, ...]
#: A row in short: the initial of its role and its first fault.
Kind = tuple[str, int]


@lru_cache(maxsize=None)
def _edits(kind: Kind) -> tuple[tuple[tuple[int, str], ...], ...]:
    """From every state to every state, the cheapest edits of one row and of turns inserted before it, least first.

    No edits of the same number of rows are a prefix of others: all end with the row's own.
    """
    initial, fault = kind
    late = TRUNCATED if FAULTS[fault] == "truncated" else 0
    table = [[(NEVER, "")] * STATES for _ in range(STATES)]
    for first in range(STATES):
        state = first
        for inserted in range(3):
            ways = [(DELETE, "D", state)]
            if FAULTS[fault] not in ("blank", "duplicate"):
                ways += [(late, "K", t) for i, t in NEXT[state].items() if i == initial]
                ways += [(REROLE + late, "R", t) for i, t in NEXT[state].items() if i != "s"]
            for cost, letter, t in ways:
                table[first][t] = min(table[first][t], (cost + INSERT * inserted, "I" * inserted + letter))
            state = NEXT[state].get("u", NEXT[state].get("a"))
    return tuple(map(tuple, table))


@lru_cache(maxsize=1 << 16)
def _forward(cost: Vector, rank: Vector, kind: Kind) -> tuple[int, Vector, Vector]:
    """Costs (above the first number returned) and the order of the least edits, one row further."""
    edits = _edits(kind)
    best = []
    for t in range(STATES):
        best.append(min((cost[p] + edits[p][t][0], rank[p], edits[p][t][1]) for p in range(STATES)))
    low = min(b[0] for b in best)
    order = {key: i for i, key in enumerate(sorted({b[1:] for b in best if b[0] < NEVER}))}
    return low, tuple(min(b[0] - low, NEVER) for b in best), tuple(order.get(b[1:], STATES) for b in best)


@lru_cache(maxsize=1 << 16)
def _backward(cost: Vector, kind: Kind) -> tuple[int, Vector]:
    edits = _edits(kind)
    best = [min(edits[p][t][0] + cost[t] for t in range(STATES)) for p in range(STATES)]
    low = min(best)
    return low, tuple(min(b - low, NEVER) for b in best)


def _only(state: int) -> Vector:
    return tuple(0 if p == state else NEVER for p in range(STATES))


def forward(kinds: list[Kind], lo: int, hi: int, state: int) -> tuple[int, Vector, Vector]:
    """What it costs to be in each state after the rows ``lo .. hi`` (above a base), and the order of the least edits."""
    base, cost, rank = 0, _only(state), (0,) * STATES
    for i in range(lo, hi):
        more, cost, rank = _forward(cost, rank, kinds[i])
        base += more
    return base, cost, rank


def backward(kinds: list[Kind], lo: int, hi: int, cost: Vector) -> tuple[int, Vector]:
    """What the rows ``lo .. hi`` and the rest cost from each state (above a base), if the rest costs ``cost``."""
    base = 0
    for i in range(hi - 1, lo - 1, -1):
        more, cost = _backward(cost, kinds[i])
        base += more
    return base, cost


def trace(kinds: list[Kind], lo: int, hi: int, state: int, last: int, out: list[str]) -> None:
    """Append the least of the cheapest edits that lead from ``state`` over the rows ``lo .. hi`` to ``last``.

    Forward and backward costs meet in the middle; of the states in which the whole is cheapest, the one with the
    least edits before it is crossed, and both halves are solved anew. Space is linear in the rows.
    """
    if hi - lo <= 1:
        out.extend(_edits(kinds[i])[state][last][1] for i in range(lo, hi))
        return
    mid = (lo + hi) // 2
    _, there, rank = forward(kinds, lo, mid, state)
    _, back = backward(kinds, mid, hi, _only(last))
    crossing = min(range(STATES), key=lambda s: (there[s] + back[s], rank[s]))
    trace(kinds, lo, mid, state, crossing, out)
    trace(kinds, mid, hi, crossing, last, out)


def solve(kinds: list[Kind]) -> tuple[int, list[str], str]:
    """The cost, the edits of every row, and the inserts at the end."""
    base, cost, rank = forward(kinds, 0, len(kinds), START)
    last = min(range(STATES), key=lambda s: (cost[s] + END[s], rank[s]))
    edits: list[str] = []
    trace(kinds, 0, len(kinds), START, last, edits)
    return base + cost[last] + END[last], edits, "I" * (END[last] // INSERT)


def written(rows: list[tuple[str, str]], edits: list[str], tail: str, state: int) -> list[str]:
    """The repaired turns as ``role:text``."""
    out = []
    for (role, text), letters in zip(rows, edits):
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                state = NEXT[state][role[:1]]
                out.append(f"{role}:{text}")
                continue
            state = NEXT[state].get("u", NEXT[state].get("a"))
            out.append(f"{NAMES[state]}:{text if letter == 'R' else ''}")
    for _ in tail:
        state = NEXT[state].get("u", NEXT[state].get("a"))
        out.append(f"{NAMES[state]}:")
    return out


def _kind(role: str, text: str, seen: bool) -> Kind:
    last = text.rstrip(BLANK)[-1:]
    return role[:1], 1 if not last else 2 if seen else 0 if last in FULL else 3


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def _whole(rows: list[tuple]) -> tuple:
    """The result for one conversation, from its rows ``(turn, role, text)`` in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        kinds.append(_kind(role, text, (role, text) in seen))
        seen.add((role, text))
    cost, edits, tail = solve(kinds)
    faults = [k[1] for k in kinds]
    lines = written([r[1:] for r in rows], edits, tail, START)
    counts = (faults.count(1), faults.count(2), faults.count(3), _illegal([k[0] for k in kinds]))
    return _gaps([r[0] for r in rows]), *counts, cost, "".join(edits) + tail, "\n".join(lines)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """Results of the conversations that lie inside one sorted partition, and the rows of all others, in place.

    A partition's first and last conversation may go on in other partitions, whatever their size; their rows are
    passed on one by one. The others are held one at a time.
    """
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType)])
    for name in NUMBERS:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired", "string").add("part", "integer").add("at", "long")
    schema = T.StructType([*schema.fields, *(T.StructField(c, rows.schema[c].dataType) for c in ("turn", "role", "text", "there"))])
    arrow = pa.schema([pa.field(n, pa.int64()) for n in NUMBERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, conv, first, held = TaskContext.get().partitionId(), 0, None, True, []
        types = None

        def done(found: list[tuple]) -> pa.RecordBatch:
            n = len(found)
            columns = list(zip(*found)) or [()] * (3 + len(NUMBERS))
            arrays = [pa.array(columns[0], types["conv"])]
            arrays += [pa.array(c, f.type) for c, f in zip(columns[1:7], arrow)]
            arrays += [pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())]
            arrays += [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), types["turn"], types["role"], types["text"], types["there"])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def passed(conv, some: list[tuple]) -> pa.RecordBatch:
            nonlocal at
            n = len(some)
            turns, roles, texts, there = zip(*some)
            arrays = [pa.array([conv] * n, types["conv"]), *[pa.nulls(n, pa.int64())] * len(NUMBERS), *[pa.nulls(n, pa.string())] * 2]
            arrays += [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
            arrays += [pa.array(turns, types["turn"]), pa.array(roles, types["role"]), pa.array(texts, types["text"]), pa.array(there, types["there"])]
            at += n
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        started = False
        for batch in batches:
            types = {n: batch.schema.field(n).type for n in ("conv", "turn", "role", "text", "there")}
            found = []
            for c, *row in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "there"))):
                if not started or c != conv:
                    if started and held:
                        if first:
                            yield passed(conv, held)
                        else:
                            found.append((conv, *_whole([r[:3] for r in held if r[3]])))
                    first, held = not started, []
                    started, conv = True, c
                held.append(tuple(row))
            if found:
                yield done(found)
            if first and held:
                yield passed(conv, held)
                held = []
        if held:
            yield passed(conv, held)

    return rows.mapInArrow(run, schema)


def _flagged(rows: DataFrame) -> DataFrame:
    """The rows that count, with ``seen``: whether the conversation has the same role and text before."""
    rows = rows.where("there").withColumn("same", F.md5(F.col("text")))
    keys = ["conv", "role", "same"]
    firsts = rows.groupBy(*keys).agg(F.min(F.struct("part", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = cut(firsts.select(*[F.col(k).alias(f"f_{k}") for k in keys], "first"), "first-of-many")
    on = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("same") == F.col("f_same"))
    seen = F.coalesce(F.struct("part", "at") > F.col("first"), F.lit(False))
    return rows.join(firsts, on, "left").select("conv", "part", "at", "turn", "role", "text", seen.alias("seen"))


def _ordered(table: pa.Table) -> tuple[list[tuple[str, str]], list[Kind]]:
    columns = table.sort_by("at").select(["role", "text", "seen"]).to_pydict().values()
    rows = list(zip(*columns))
    return [r[:2] for r in rows], [_kind(*r) for r in rows]


def _summaries(rows: DataFrame) -> DataFrame:
    """Per conversation and partition: costs and order of the least edits between all states, and counts."""
    schema = T.StructType([rows.schema["conv"], rows.schema["part"]])
    schema = schema.add("cost", T.ArrayType(T.LongType())).add("rank", T.ArrayType(T.LongType())).add("first", "string").add("last", "string")
    for name in NUMBERS[1:5]:
        schema = schema.add(name, "long")

    def run(table: pa.Table) -> pa.Table:
        _, kinds = _ordered(table)
        cost, rank = [], []
        for state in range(STATES):
            base, above, order = forward(kinds, 0, len(kinds), state)
            cost += [min(base + c, NEVER) for c in above]
            rank += order
        faults, initials = [k[1] for k in kinds], [k[0] for k in kinds]
        numbers = (*(faults.count(i) for i in (1, 2, 3)), _illegal(initials))
        values = (cost, rank, initials[0], initials[-1], *numbers)
        kinds_of = (pa.list_(pa.int64()),) * 2 + (pa.string(),) * 2 + (pa.int64(),) * 4
        arrays = [table.column(n).combine_chunks().slice(0, 1) for n in ("conv", "part")]
        return pa.table([*arrays, *(pa.array([v], k) for v, k in zip(values, kinds_of))], names=schema.names)

    return rows.groupBy("conv", "part").applyInArrow(run, schema)


def _crossings(summaries: DataFrame) -> DataFrame:
    """Per conversation and partition, the states at both ends on the best way, and the conversation's numbers.

    A conversation has at most one row per partition here, however many turns it has.
    """
    schema = T.StructType([*summaries.schema.fields[:2]]).add("state", "integer").add("last_state", "integer").add("tail", "integer")
    for name in NUMBERS[1:]:
        schema = schema.add(name, "long")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        rest = [END]
        for cost in reversed(rows["cost"].tolist()):
            step = [min(cost[STATES * p + t] + rest[-1][t] for t in range(STATES)) for p in range(STATES)]
            rest.append(tuple(min(int(c), NEVER) for c in step))
        rest.reverse()
        ends, state = [], START
        for cost, rank, after in zip(rows["cost"], rows["rank"], rest[1:]):
            t = min(range(STATES), key=lambda t: (cost[STATES * state + t] + after[t], rank[STATES * state + t]))
            ends.append((state, t))
            state = t
        out = rows[["conv", "part"]].copy()
        out["state"], out["last_state"] = zip(*ends)
        out["tail"] = [0] * (len(rows) - 1) + [END[state] // INSERT]
        for name in NUMBERS[1:4]:
            out[name] = int(rows[name].sum())
        joints = [a + b not in LEGAL for a, b in zip(rows["last"].tolist(), rows["first"].tolist()[1:])]
        out["illegal"], out["cost"] = int(rows["illegal"].sum()) + sum(joints), rest[0][START]
        return out

    return summaries.groupBy("conv").applyInPandas(run, schema)


def _pieces(rows: DataFrame) -> DataFrame:
    """The edits and repaired turns of each part of a conversation between the given states."""
    schema = T.StructType([rows.schema["conv"], rows.schema["part"]]).add("audit", "string").add("repaired", "string")

    def run(table: pa.Table) -> pa.Table:
        turns, kinds = _ordered(table)
        state, last, tail = (table.column(n)[0].as_py() for n in ("state", "last_state", "tail"))
        edits: list[str] = []
        trace(kinds, 0, len(kinds), state, last, edits)
        lines = written(turns, edits, "I" * tail, state)
        values = ("".join(edits) + "I" * tail, "\n".join(lines) if lines else None)
        arrays = [table.column(n).combine_chunks().slice(0, 1) for n in ("conv", "part")]
        return pa.table([*arrays, *(pa.array([v], pa.string()) for v in values)], names=schema.names)

    return rows.groupBy("conv", "part").applyInArrow(run, schema)


def _in_parts(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows lie in several partitions, or might."""
    flagged = cut(_flagged(rows), "flagged-turns")
    ways = cut(_crossings(_summaries(flagged)), "crossings")
    named = ways.select(F.col("conv").alias("w_conv"), F.col("part").alias("w_part"), "state", "last_state", "tail")
    on = F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("part") == F.col("w_part"))
    pieces = _pieces(flagged.join(named, on).select("conv", "part", "at", "role", "text", "seen", "state", "last_state", "tail"))

    def joined(name: str, mark: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("part", name)))
        return F.array_join(F.transform(ordered, lambda x: x[name]), mark).alias(name)

    whole = pieces.groupBy("conv").agg(joined("audit", ""), joined("repaired", "\n"))
    span = (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long")
    turns = flagged.groupBy("conv").agg(F.coalesce(span, F.lit(0).cast("long")).alias("gaps"))
    numbers = ways.groupBy("conv").agg(*[F.first(n).alias(n) for n in NUMBERS[1:]])
    out = rows.select("conv").distinct()
    for i, table in enumerate((turns, numbers, whole)):
        table = table.withColumnRenamed("conv", f"c{i}")
        out = out.join(table, F.col("conv").eqNullSafe(F.col(f"c{i}")), "left").drop(f"c{i}")
    return out.fillna(0, list(NUMBERS)).fillna("", ["audit", "repaired"])


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults put in by a rule, ``there`` being false for those that are dropped.

    CRC-32 of ``conversation:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 removes the ends of
    sentences, 3 repeats the row, 4 makes it the user's. A NULL is one space in the rule, as a role and as a text.
    """
    space = F.lit(" ")
    named = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"))
    rule = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    named = named.withColumn("rule", F.crc32(rule.cast("binary")) % 20)
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("rule") == 3, 2).otherwise(1))
    out = named.withColumn("text", text).withColumn("role", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")))
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col),
        (F.col("rule") != 0).alias("there"), F.explode(times).alias("copy"),
    ).drop("copy")


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there: str | None = None,
) -> DataFrame:
    """``(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)``, one row per conversation.

    Turns are taken in order, NULL first; rows of one turn by role and text. A row is blank, or a duplicate of an
    earlier one, or cut off before the end of a sentence; only the first of these counts. Edits keep a row (0), give
    it to the user or the assistant (2), delete it (3; blank rows and duplicates must go) or insert an empty turn
    of one of them (2); cut off rows that stay cost 1. The cheapest edits that leave an optional system turn
    and then user and assistant by turns, or nothing, repair the conversation; of equally cheap ones, those whose
    initials in order (``audit``) come first. ``repaired`` has the turns as ``role:text``, joined by line feeds.

    Rows are sorted once over all conversations. Conversations inside one partition are solved there. Others are
    solved in their partitions, from every state to every state; the costs of the parts meet at the bounds, where the
    best crossing with the least edits is chosen, and each part is traced between its crossings. So no task
    holds a long conversation, but its repaired text is one cell (2 GB at most).

    ``there`` names a boolean column: rows where it is not true do not count, but their conversation has its row. One
    without rows that count has zeros and empty strings. NULL roles and texts are one space, NULL ids are one
    conversation. Repeated rows are duplicates. Other columns are not read; an empty table gives no rows.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"),
        (F.coalesce(F.col(there), F.lit(False)) if there else F.lit(True)).alias("there"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "role", "text", "row"]
    runs = cut(_sorted_runs(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")), "conversations")
    columns = ["conv", *NUMBERS, "audit", "repaired"]
    inside = runs.where("part IS NULL").select(*columns)
    others = runs.where("part IS NOT NULL").select("conv", "part", "at", "turn", "role", "text", "there")
    out = inside.unionByName(_in_parts(others).select(*columns))
    return out.withColumnRenamed("conv", conv_col)
