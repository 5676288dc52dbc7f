"""Conversation structure: damage, faults, and the cheapest repair by a run-length dynamic programme.

A row of a conversation is one symbol: its role's initial (``s``, ``u``, ``a``
or another) and its first fault. Symbols are put in order by one range
repartition, so a conversation of any length is spread over tasks, and leave it
as strings of one byte a row. Equal consecutive symbols are collapsed into
runs; the cost to go is carried over a run by the binary powers of the symbol's
min-plus transition, which are computed once per process. The choices are then
unrolled from the front: at each step the smallest letter that keeps the
cheapest cost. Texts are moved once, to be put in order with the choices and
hashed as they stream by; of a conversation only its symbols and its audit,
which is part of the result, are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clienttrace.llm.common import columns, written

#: What a text may end with and still be blank there, and what ends a sentence.
BLANKS = " \t\n\x0b\x0c\r"
END = "[.!?]"
DROP, EMPTY, UNENDED, REPEAT, USER = range(5)

KEEP, DELETE, INSERT, REROLE = 0, 3, 2, 2
TRUNCATED = 1
#: A symbol is 4 * initial + fault.
INITIALS = "sua"
FINE, CUT, BLANK, DUPLICATE = range(4)
#: 4 * initial + next initial of the pairs su, ua and au.
LEGAL = (4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1)
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; and where a turn to
#: ``user`` or ``assistant``, whichever may follow, leads.
NEXT = (2, 2, 3, 2)
#: Cost of ending in a state: only nothing and an assistant turn may end.
CLOSE = (0, 2 * INSERT, INSERT, 0)
FAR = float("inf")
Vector = tuple[float, ...]


def _turn(state: int) -> str:
    return "assistant" if state == 2 else "user"


def _steps(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may happen to a row; the letters in ASCII order."""
    initial, fault = (INITIALS + "?")[symbol >> 2], symbol & 3
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    extra = TRUNCATED if fault == CUT else 0
    if initial == "s" and state == 0:
        out.append(("K", KEEP + extra, 1))
    elif initial == _turn(state)[0]:
        out.append(("K", KEEP + extra, NEXT[state]))
    return [*out, ("R", REROLE + extra, NEXT[state])]


@lru_cache(maxsize=None)
def _power(symbol: int, exponent: int) -> tuple[Vector, ...]:
    """The min-plus matrix of ``2 ** exponent`` rows of a symbol: cost from one state to another."""
    if exponent:
        half = _power(symbol, exponent - 1)
        return tuple(tuple(min(half[x][z] + half[z][y] for z in range(4)) for y in range(4)) for x in range(4))
    matrix = [[FAR] * 4 for _ in range(4)]
    for x in range(4):
        state, paid = x, 0
        for _ in range(3):  # no, one or two turns put in; three end where one does
            for _, cost, y in _steps(symbol, state):
                matrix[x][y] = min(matrix[x][y], paid + cost)
            state, paid = NEXT[state], paid + INSERT
    return tuple(map(tuple, matrix))


def _before(symbol: int, count: int, after: Vector) -> Vector:
    """Cost to go before ``count`` equal rows."""
    exponent = 0
    while count:
        if count & 1:
            after = tuple(min(m + v for m, v in zip(row, after)) for row in _power(symbol, exponent))
        count >>= 1
        exponent += 1
    return after


def _runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def _unrolled(symbols: bytes, state: int, after: Vector) -> tuple[str, int]:
    """Letters of a stretch of rows entered in ``state``, and the state left in."""
    runs, audit = _runs(symbols), []
    togo = [after]
    for symbol, count in reversed(runs):
        togo.append(_before(symbol, count, togo[-1]))
    for (symbol, count), end in zip(runs, reversed(togo[:-1])):
        inside = [end]
        for _ in range(count):
            inside.append(_before(symbol, 1, inside[-1]))
        for left, after in zip(inside[:0:-1], inside[-2::-1]):
            letter = ""
            while letter in ("", "I"):
                options = [(step, y) for step, cost, y in _steps(symbol, state) if left[state] == cost + after[y]]
                if left[state] == INSERT + left[NEXT[state]]:
                    options.append(("I", NEXT[state]))
                letter, state = min(options)
                audit.append(letter)
    return "".join(audit), state


def repair(symbols: bytes, stretch: int = 1 << 14) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation's symbols, the ASCII-least of equal ones.

    The cost to go is kept between stretches of rows and made again inside them.
    """
    plain = bytes(BLANK if s & 3 in (BLANK, DUPLICATE) else s for s in symbols)
    parts = [plain[i:i + stretch] for i in range(0, len(plain), stretch)]
    togo: list[Vector] = [CLOSE]
    for part in reversed(parts):
        vector = togo[-1]
        for symbol, count in reversed(_runs(part)):
            vector = _before(symbol, count, vector)
        togo.append(vector)
    audit, state = [], 0
    for part, after in zip(parts, reversed(togo[:-1])):
        letters, state = _unrolled(part, state, after)
        audit.append(letters)
    while CLOSE[state]:
        audit.append("I")
        state = NEXT[state]
    return int(togo[-1][0]), "".join(audit)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage drawn by crc32 of ``conv_id:turn``.

    Nulls are one space in the drawn key, in role and in text; ids and turns keep theirs.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = columns(turns, "conv_id", "turn", "role", "text")
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    return rows.where(F.col("kind") != DROP).select(
        "conv_id", "turn", F.when(F.col("kind") == USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNENDED, F.regexp_replace("text", END, ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: ``conv_id, turn, role, digest`` and ``symbol``."""
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    light = rows.select(
        "conv_id", "turn", "role", F.md5(F.concat_ws(":", F.length("role"), "role", "text")).alias("digest"),
        (F.when((initial == 0) | (F.col("role") == ""), F.lit(3)).otherwise(initial - 1) * 4).alias("of_role"),
        F.when(F.rtrim("text", F.lit(BLANKS)) == "", BLANK)
        .when(F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).rlike(END), FINE)
        .otherwise(CUT).alias("fault"))
    # The earliest turn of a role and text that a conversation has more than once, combined map side.
    same = ["conv_id", "digest"]
    early = light.groupBy(*same).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("at"))).alias("first"),
        F.count(F.lit(1)).alias("copies")).where("copies > 1").select(
        F.col("conv_id").alias("c"), F.col("digest").alias("g"), "first")
    here = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("at"))
    return light.join(early, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left").select(
        "conv_id", "turn", "role", "digest", "of_role", "fault",
        F.col("first").isNotNull().alias("copied"), (here == F.col("first")).alias("earliest"))


PARTS = "conv_id {id}, part int, piece int, symbols binary, low long, high long, turns long"
ROWS = 1 << 16


def symbol_parts(light: DataFrame) -> DataFrame:
    """Symbols in order, in pieces of at most ``ROWS`` rows of a conversation, with the turns of each piece."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    rows = light.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, piece, symbols, low, high, turns, seen = None, -1, None, None, None, 0, None
        done: list[tuple] = []
        for batch in batches:
            for c, t, _, digest, of_role, fault, copied, earliest in zip(*(col.to_pylist() for col in batch.columns)):
                if symbols is None or c != conv or len(symbols) >= ROWS:
                    if symbols is not None:
                        done.append((conv, part, piece, bytes(symbols), low, high, turns))
                    if symbols is None or c != conv:
                        seen = None
                    conv, piece, symbols, low, high, turns = c, piece + 1, bytearray(), None, None, 0
                if t is not None and t != high:
                    low, high, turns = t if low is None else low, t, turns + 1
                # Equal rows of one turn lie next to each other, in one partition.
                if copied and fault != BLANK and (not earliest or seen == (t, digest)):
                    fault = DUPLICATE
                seen = (t, digest)
                symbols.append(of_role + fault)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*done), kinds)], names)
                done = []
        if symbols is not None:
            done.append((conv, part, piece, bytes(symbols), low, high, turns))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*done), kinds)], names)

    of_id = light.schema["conv_id"].dataType
    kinds = [to_arrow_type(of_id), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "part", "piece", "symbols", "low", "high", "turns"]
    return rows.mapInArrow(run, PARTS.format(id=of_id.simpleString()))


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _facts(symbols: bytes) -> tuple:
    codes = np.frombuffer(symbols, np.uint8)
    faults = np.bincount(codes & 3, minlength=4).tolist()
    pairs = np.bincount((codes[:-1] >> 2) * 4 + (codes[1:] >> 2), minlength=16).tolist()
    illegal = sum(n for pair, n in enumerate(pairs) if pair not in LEGAL)
    return (faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, *repair(symbols))

@lru_cache(maxsize=100_000)
def _facts_of_short(symbols: bytes) -> tuple:
    return _facts(symbols)


def judged(parts: DataFrame) -> DataFrame:
    """Faults, cost and audit per conversation, from its symbol pieces."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "piece", "symbols", "low", "high", "turns")))
    whole = parts.groupBy("conv_id").agg(pieces.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for list_of in batch.column(1).to_pylist():
                symbols = b"".join(p["symbols"] for p in list_of)
                known = [p for p in list_of if p["turns"]]
                gaps = 0
                if known:
                    twice = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
                    gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(p["turns"] for p in known) + twice
                found.append((gaps, *(_facts_of_short if len(symbols) <= 64 else _facts)(symbols)))
            made = list(zip(*found)) if found else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(m, pa.int64()) for m in made[:6]), pa.array(made[6], pa.string())],
                ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kind = parts.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {kind}, {FACTS}")


def repaired(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Conversations' facts with the digest of the repaired turns, hashed while they stream by in order."""
    of_id = rows.schema["conv_id"].dataType.simpleString()
    known = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit".split(", ")
    none = [F.lit(None).cast("long").alias(n) for n in known[1:-1]]
    texts = rows.select("conv_id", "turn", "role", "text", F.md5(F.concat_ws(":", F.length("role"), "role", "text")).alias("digest"),
                        F.lit(1).alias("kind"), *none, F.lit(None).cast("string").alias("audit"))
    heads = facts.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("text"), F.lit("").alias("digest"), F.lit(0).alias("kind"), *known[1:])
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "kind", "role", "text", *known[1:])

    class Digest:
        """The hash of the turns so far and the edits still to come."""

        def __init__(self, head: tuple) -> None:
            self.head, self.sha, self.any = head, hashlib.sha256(), False
            self.state, self.at, self.audit = 0, 0, head[-1]

        def put(self, role: str, text: str) -> None:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True

        def put_in(self) -> None:
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                self.put(_turn(self.state), "")
                self.state, self.at = NEXT[self.state], self.at + 1

        def row(self, role: str, text: str) -> None:
            self.put_in()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "D":
                return
            if letter == "R":
                role = _turn(self.state)
            self.put(role, text)
            self.state = 1 if letter == "K" and role[:1] == "s" else NEXT[self.state]

        def end(self) -> tuple:
            self.put_in()
            return *self.head, self.sha.hexdigest()

    kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = [*known, "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Digest | None = None
        for batch in batches:
            done: list[tuple] = []
            kinds[0] = batch.column(0).type
            cols = [c.to_pylist() for c in batch.columns]
            for i, kind in enumerate(cols[1]):
                if kind:
                    now.row(cols[2][i], cols[3][i])
                    continue
                if now:
                    done.append(now.end())
                now = Digest((cols[0][i], *(c[i] for c in cols[4:])))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[now.end()]), kinds)], names)

    return stream.mapInArrow(run, f"conv_id {of_id}, {FACTS}, repaired_sha256 string")


def repairs(turns: DataFrame) -> DataFrame:
    """Damages the conversations and returns, per original ``conv_id``, faults, cost, audit and digest of the repair.

    Rows are taken by turn, nulls first; rows of one turn by role and text, so
    repeated rows are next to each other. A null ``conv_id`` is a conversation
    like any other. One all of whose rows are dropped has zeros, an empty audit
    and the hash of nothing; an empty table gives no rows; other columns are
    not read.
    """
    rows = damaged(turns)
    facts = judged(symbol_parts(marked(rows)))
    ids = columns(turns, "conv_id").distinct()
    every = ids.join(facts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"))
    return repaired(rows, written(every, "repairs"))
