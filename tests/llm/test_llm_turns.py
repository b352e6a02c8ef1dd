"""Repair of conversations against all edits of short ones."""

import hashlib
import itertools
import random
import re
import time

import pytest

from pelagica.llm import turns
from pelagica.llm.common import ready

SCHEMA = "conv_id long, turn long, role string, text string, place string, audit string, key string"
SHAPE = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits of a conversation of (role, text), from all of them up to the cost of making everything anew."""
    bad = faults(rows)
    best = (4 * len(rows), "D" * len(rows), [])

    def go(at, cost, audit, made):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in made)):
            return
        if at == len(rows):
            if SHAPE.fullmatch("".join(r[:1] for r, _ in made)):
                best = min(best, (cost, audit, made))
        else:
            role, text = rows[at]
            go(at + 1, cost + 4, audit + "D", made)
            if bad[at] in (None, "truncated"):
                more = 3 if bad[at] else 0
                go(at + 1, cost + more, audit + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, cost + 3 + more, audit + "R", [*made, (new, text)])
        for new in ("user", "assistant"):
            go(at, cost + 3, audit + "I", [*made, (new, "")])

    go(0, 0, "", [])
    return best


def report(rows):
    """Expected row of one conversation of (turn, role, text), None for nulls."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    known = [t for t, *_ in rows if t is not None]
    body = [(r, x) for _, r, x in rows]
    cost, audit, made = brute(body)
    found = faults(body)
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(body)),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest(),
    )


def conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "user", "tool", "", None]
    texts = ["One.", "Two?", "open", "", " \t", "Three!\n", None, "é ", "."]
    return {
        c: [(rng.choice([None, 1, 2, 3, 4, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 6))]
        for c in [None, *range(150)]
    }


def test_report_equals_all_edits(spark):
    ready(spark)
    cases = conversations()
    rows = [(c, *r, "x", "y", "z") for c, rs in cases.items() for r in rs]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = spark.createDataFrame([(c,) for c in [*cases, 1000]], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(ids, frame).collect()}
    assert got.pop(1000) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: report(rs) for c, rs in cases.items()}


def test_repaired_rows_take_turns(spark):
    ready(spark)
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 3, "user", "R?"), (1, 4, "assistant", "A."), (2, 0, "user", " ")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = turns.repair(frame, turns.decide(frame)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in made] == [
        (1, 0, "K", "system", "S."), (1, 1, "K", "user", "Q?"), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "R?"), (1, 4, "K", "assistant", "A."),
    ]


def test_letters_settle_without_changing_the_result(monkeypatch):
    rng = random.Random(2)
    cases = [[(rng.choice("uuaast"), rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 60))] for _ in range(60)]

    def all_at(width):
        monkeypatch.setattr(turns, "WIDTH", width)
        out = []
        for rows in cases:
            decision = turns.Decision()
            for row in rows:
                decision.row(*row)
            out.append(decision.finish())
        return out

    assert all_at(8) == all_at(1024)


def test_a_long_conversation_stays_cheap():
    decision, start = turns.Decision(), time.time()
    for i in range(100_000):
        decision.row("usat"[i % 3 if i % 7 else 3], "truncated" if i % 11 == 0 else None)
    cost, audit = decision.finish()
    assert len(audit) >= 100_000 and cost > 0 and time.time() - start < 30


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, r, "A. b! c") for c in [None, *range(40)] for t in (None, 0, 1) for r in ("system", None)]
    got = turns.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "A b c"}.get(code, x)
        want += [(c, t, "user" if code == 4 else " " if r is None else r, text)] * {0: 0, 3: 2}.get(code, 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("rows", [[], [(1, 1, "user", "x" * 1_000_000 + "."), (1, 2, "assistant", "y" * 1_000_000)]])
def test_empty_tables_and_very_long_texts(spark, rows):
    ready(spark)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in turns.report(frame, frame).collect()]
    assert got == ([(1, *report([r[1:] for r in rows]))] if rows else [])
