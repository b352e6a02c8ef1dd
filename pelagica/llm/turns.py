"""Repair of conversations: the cheapest edits that make their roles take turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Costs, and the initials of the edits in ASCII order, whose digits are their places from 1.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
SPACE = " \t\n\x0b\x0c\r"
# What a conversation may be after some rows: nothing yet, a system row, a user row waiting for its answer, an answer.
START, SYSTEM, USER, ANSWER = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWER, (ANSWER, "u"): USER}
TAKE = (USER, USER, ANSWER, USER)  # where an inserted or reroled row leads
ROLE = ("user", "user", "assistant", "user")  # and its role
LEGAL = ("su", "ua", "au")
# Bits of a digit, and letters that fit a weight at first.
BITS, WIDTH = 3, 64


class Decision:
    """Cheapest edits of one conversation, fed row by row, as a shortest path over integers.

    The weight of a path has its cost in the high digits and the letters of its edits in low digits of fixed places, the
    first letter highest, zeros behind the last.  So the smaller integer is the cheaper path, of equally
    cheap ones the one with the ASCII-least letters, and a minimum at each state decides everything: two paths to one state
    after the same rows whose costs are equal are never prefixes of one another (only insertions could follow, and they
    cost), so letters added behind both can't change their order.

    Letters that all open paths share are moved out, so the integers stay short however long the conversation is.
    """

    def __init__(self) -> None:
        self.width = WIDTH
        self.settled: list[int] = []
        self.paths: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: weight, letters so far
        self._insert()

    def _weight(self, path: tuple[int, int], cost: int, digit: int) -> tuple[int, int]:
        weight, length = path
        return weight + (cost << BITS * self.width) + (digit << BITS * (self.width - 1 - length)), length + 1

    def _insert(self) -> None:
        for _ in range(2):  # no more than two rows can be missing at a place
            for state, path in list(self.paths.items()):
                new = self._weight(path, INSERT, I)
                self.paths[TAKE[state]] = min(new, self.paths.get(TAKE[state], new))

    def row(self, initial: str, fault: str | None) -> None:
        """Take the next row: the initial of its role and its first fault."""
        if max(length for _, length in self.paths.values()) + 3 > self.width:
            self._settle()
        new: dict[int, tuple[int, int]] = {}
        for state, path in self.paths.items():
            ways = [(state, DELETE, D)]
            if fault not in ("blank", "duplicate"):
                more = UNFINISHED if fault == "truncated" else 0
                ways.append((TAKE[state], REROLE + more, R))
                if (state, initial) in KEEP:
                    ways.append((KEEP[state, initial], more, K))
            for to, cost, digit in ways:
                way = self._weight(path, cost, digit)
                new[to] = min(way, new.get(to, way))
        self.paths = new
        self._insert()

    def _settle(self) -> None:
        low = BITS * self.width
        cost = {state: weight >> low for state, (weight, _) in self.paths.items()}
        # after an answer all goes on as from the start or a system row, but for one system row that could still be kept
        for state, gain in ((START, DELETE), (SYSTEM, 0)):
            if state in cost and cost[state] > cost.get(ANSWER, cost[state]) + gain:
                del self.paths[state]
        mask = (1 << low) - 1
        letters = [weight & mask for weight, _ in self.paths.values()]
        differ = 0
        for other in letters[1:]:
            differ |= letters[0] ^ other
        places = self.width - 1 - (differ.bit_length() - 1) // BITS if differ else self.width
        places = min(places, *(length for _, length in self.paths.values()))
        self.settled += _digits(letters[0], self.width, places)
        base = min(weight >> low for weight, _ in self.paths.values())
        self.cost = getattr(self, "cost", 0) + base
        width = self.width
        while max(length for _, length in self.paths.values()) - places + 3 > width // 2:
            width *= 2
        self.paths = {
            state: (
                ((weight >> low) - base << BITS * width) | (((weight & mask) << BITS * places & mask) << BITS * (width - self.width)),
                length - places,
            )
            for state, (weight, length) in self.paths.items()
        }
        self.width = width

    def finish(self) -> tuple[int, str]:
        """Cost and letters of the best path to a whole conversation."""
        weight, length = min(self.paths[s] for s in (START, ANSWER) if s in self.paths)
        digits = self.settled + _digits(weight & ((1 << BITS * self.width) - 1), self.width, length)
        return getattr(self, "cost", 0) + (weight >> BITS * self.width), "".join(LETTERS[d - 1] for d in digits)


def _digits(letters: int, width: int, count: int) -> list[int]:
    """The first ``count`` digits of letters of fixed places."""
    return [letters >> BITS * (width - 1 - i) & (1 << BITS) - 1 for i in range(count)]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one row in five damaged, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.  Nulls count as one space.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat_ws(":", *spaced[:2])) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced[2].alias("role"), spaced[3].alias("text"), code.alias("code"))
    text = F.expr("case code when 1 then '' when 2 then translate(text, '.!?', '') else text end")
    rows = rows.where("code <> 0").withColumn("copy", F.explode(F.expr("sequence(1, if(code = 3, 2, 1))")))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space, and a 128-bit digest of the text, which orders rows of one turn and role."""
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).withColumn("key", F.md5("text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]


def decide(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation of ``rows``.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored, whatever their names.  A conversation's rows count by turn, nulls first, rows of
    one turn by role and a digest of the text; repeated rows are duplicates.  The first fault of a row
    counts: blank (only white space), duplicate (role and text were there before), truncated (no sentence end at the end).
    ``audit`` has the initials of the cheapest edits.  A null role or text is one space, and rows with a null id form a
    conversation; an empty role fits no place.  An empty table gives no rows.

    Texts stay behind: only their flags and digests are shuffled.  Rows of a conversation pass through one task as a
    stream that holds one row and a few integers.
    """
    slim = _keyed(rows).withColumn("last", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)))
    slim = slim.select("conv_id", "turn", "role", "key", "last").repartition("conv_id")
    seen = F.expr("row_number() over (partition by conv_id, role, key order by turn nulls first) > 1")
    fault = F.expr("case when last = '' then 'blank' when seen then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end")
    slim = slim.withColumn("seen", seen).sortWithinPartitions("conv_id", *_order(), "seen")
    slim = slim.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = None
        now: object = run  # no conversation yet
        out: list[tuple] = []

        def end() -> None:
            if now is not run:
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
                cost, audit = decision.finish()
                out.append((now, gaps, *(faults[f] for f in ("blank", "duplicate", "truncated")), illegal, cost, audit))

        for batch in batches:
            shape = batch.schema.field(0).type
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is run or conv != now:
                    end()
                    now, decision, illegal, before = conv, Decision(), 0, None
                    turns = [0, 0, 0]  # least, greatest, distinct
                    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
                if turn is not None and (not turns[2] or turn != turns[1]):
                    turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                if fault:
                    faults[fault] += 1
                illegal += before is not None and before + initial not in LEGAL
                before = initial
                decision.row(initial, fault)
            yield _batch(out, names, shape)
            out = []
        end()
        if out:
            yield _batch(out, names, shape)

    return slim.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", audit string")


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type] + [pa.int64()] * (len(names) - 2) + [pa.string()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=names)


def repair(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired conversations, deleted rows left out.

    ``decisions`` is what ``decide`` gives for the same rows.  Texts are shuffled once; the rows of a conversation come out in their order, in one
    partition.  A conversation of which nothing stays has no rows.
    """
    keyed = _keyed(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = decisions.select("conv_id", F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "key")], "audit")
    both = heads.union(keyed).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    both = both.select("conv_id", "audit", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shape = None
        conv, audit, at, state, place = None, "", 0, START, 0

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", ROLE[state], ""))
                at, state, place = at + 1, TAKE[state], place + 1

        def send() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            types = [shape, pa.int64(), pa.string(), pa.string(), pa.string()]
            out.clear()
            return pa.record_batch([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=["conv_id", "place", "edit", "role", "text"])

        for batch in batches:
            shape = batch.schema.field(0).type
            for new, letters, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if letters is not None:
                    insert()  # the rows missing at the end of the conversation before
                    conv, audit, at, state, place = new, letters, 0, START, 0
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                out.append((conv, place, edit, role if edit == "K" else ROLE[state], text))
                state, place = KEEP[state, role[:1]] if edit == "K" else TAKE[state], place + 1
            yield send()
        insert()
        if out:
            yield send()

    return both.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of what ``repair`` gives: ``role:text`` of its rows in their order, joined by newlines."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        hashed = hashlib.sha256()
        shape = None
        for batch in batches:
            shape = batch.schema.field(0).type
            ids: list[object] = []
            sums: list[str] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if now is run or conv != now:
                    if now is not run:
                        ids.append(now)
                        sums.append(hashed.hexdigest())
                    now, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array(ids, type=shape), pa.array(sums, type=pa.string())], names=["conv_id", "repaired_sha256"])
        if now is not run:
            yield pa.record_batch([pa.array([now], type=shape), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """What ``decide`` says and the digest of what ``repair`` makes of ``rows``, for every id of ``conversations``.

    Ids without rows have zeros, an empty audit and the digest of nothing.
    """
    decisions = stored(decide(rows), "decisions")
    sums = digests(repair(rows, decisions))
    ids = conversations.select("conv_id").distinct()
    facts = decisions.select(F.col("conv_id").alias("d_id"), *[F.col(c) for c in decisions.columns[1:]])
    sums = sums.select(F.col("conv_id").alias("s_id"), "repaired_sha256")
    joined = ids.join(facts, F.col("conv_id").eqNullSafe(F.col("d_id")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("s_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in decisions.columns[1:-1]]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
