import hashlib
import itertools
import random
import re
import zlib

import pytest

from samplemill.llm import conversations as c

BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """The cheapest edits and, of those, the least: a search over every string of edits by cost, in order."""
    found = faults(rows)
    best = None
    stack = [(0, "", 0, "", ())]  # place, edits, cost, role initials, turns
    while stack:
        at, audit, cost, path, out = stack.pop()
        if best is not None and cost > best[0]:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", path):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if not re.fullmatch("s?(ua)*u?", path):
            continue
        more = [("I", 2, w[0], f"{w}:", at) for w in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            late = 1 if found[at] == "truncated" else 0
            more.append(("D", 3, "", None, at + 1))
            if found[at] not in ("blank", "duplicate"):
                more.append(("K", late, role[:1] or "?", f"{role}:{text}", at + 1))
                more += [("R", 2 + late, w[0], f"{w}:{text}", at + 1) for w in ("user", "assistant")]
        for letter, price, initial, line, to in more:
            if cost + price <= (best[0] if best else 3 * len(rows)):
                stack.append((to, audit + letter, cost + price, path + initial, out if line is None else (*out, line)))
    return best


def expected(rows):
    """What one conversation gives, rows being ``(turn, role, text)``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    found = faults([r[1:] for r in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = brute([r[1:] for r in rows])
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(out)


def some_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    texts = ["One.", "Two!", "Three", " ", "", "Four? \n", "One."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_edits_are_the_least_of_the_cheapest():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5, 6):
        for _ in range(60):
            rows = some_rows(rng, n)
            kinds, seen = [], set()
            for r in rows:
                kinds.append(c._kind(*r, r in seen))
                seen.add(r)
            cost, edits, tail = c.solve(kinds)
            assert (cost, "".join(edits) + tail, tuple(c.written(rows, edits, tail, 0))) == brute(rows), rows


def made(spark, rows):
    full = [(*r, "x", 1, 2, True) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, audit string, part int, at int, there boolean")


def result(df):
    assert df.columns == ["conv_id", *c.NUMBERS, "audit", "repaired"]
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_conversations_in_any_number_of_partitions(spark, partitions):
    """With more partitions than conversations, most are solved part by part."""
    rng = random.Random(partitions)
    rows = [(i if i else None, rng.choice([None, *range(8)]), *r) for i in range(12) for r in some_rows(rng, rng.randint(1, 6))]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(c.repair(made(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_id = {k: [r[1:] for r in v] for k, v in itertools.groupby(sorted(rows, key=lambda r: r[0] or 0), key=lambda r: r[0])}
    assert got == {k: expected(v) for k, v in by_id.items()}


def test_one_long_conversation_in_parts_as_in_one(spark):
    rng = random.Random(3)
    rows = [(7, i // 2, *r) for i, r in enumerate(some_rows(rng, 3000))]
    whole = c._whole(sorted((r[1:] for r in rows), key=lambda r: (r[0], r[1].encode(), r[2].encode())))
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(c.repair(made(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {7: whole}


def damaged(rows):
    """The rule of the faults, row by row."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        role = "user" if rule == 4 else role
        yield from [(conv, turn, role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)


def test_damage_and_edge_cases(spark):
    rng = random.Random(9)
    rows = [(i % 20 or None, rng.choice([None, *range(6)]), *r) for i in range(90) for r in some_rows(rng, 1)]
    rows += [(50, 1, None, None), (50, 1, None, None), (51, None, "user", "y" * 100_000 + "."), (52, 3, "user", "a."), (52, 3, "user", "a.")]
    rows += [(i, 0, "user", "Hi.") for i in range(100, 160)]
    df = made(spark, rows).drop("there")
    got = result(c.repair(c.damage(df), there="there"))
    kept = list(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", "")
    want = {conv: [r[1:] for r in kept if r[0] == conv] for conv in {r[0] for r in rows}}
    assert got == {k: expected(v) if v else nothing for k, v in want.items()}
    assert nothing in got.values()
    assert result(c.repair(c.damage(df.limit(0)), there="there")) == {}


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
