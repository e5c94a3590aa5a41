"""Repair of a conversation's structure by a dynamic program over retained turns.

Rows of a conversation are taken by turn.  Cheapest edits make its role initials read
``(s?(ua)+)?``: keep a row, give it the role user or assistant, delete it, or insert an
empty turn of either role.  Blank and repeated rows have to go, and a truncated row that
stays is paid for.

The program runs over the rows that stay, kept or with a new role, from the last one to
the first.  Its states are the role of a row that stays, and the start.  What lies
between two of them is a difference of prefix sums of deletions, so each state needs
only its running minimum over later rows; how many turns to insert follows from the pair
of roles.  Of equal costs the audit that is least in ASCII wins: the later row (more D
first), then an insertion, then keeping before a new role.  That is decided where the
minimum is taken, so audits are never compared as strings.

Defined results: null role or text is one space; rows without a turn come first; equal
turns go by role, then text; rows that are the same keep their number; a null conv_id is
a conversation of its own; a role without a first letter s, u or a, or an empty one, is
never kept; other columns are ignored; an empty table gives no rows.  A conversation is
one output row, so it must fit in a row; it is gathered by partial aggregation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, tidy

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

_START, _S, _U, _A = range(4)
_STATE = {"s": _S, "u": _U, "a": _A}
_ROLE = {_U: "user", _A: "assistant"}
#: Roles to insert between a row that stays (or the start) and the next one, or the end.
_BETWEEN = {
    (_START, _S): [], (_START, _U): [], (_START, _A): [_U],
    (_S, _U): [], (_S, _A): [_U],
    (_U, _A): [], (_U, _U): [_A],
    (_A, _U): [], (_A, _A): [_U],
}
_LAST = {_START: [], _S: [_U, _A], _U: [_A], _A: []}
#: For each state: the next roles and how many turns stand between.
_NEXT = {x: [(to, len(turns)) for (of, to), turns in _BETWEEN.items() if of == x] for x in _LAST}


def plan(initials: list[str], must_go: list[bool], truncated: list[bool]) -> tuple[int, str, list[tuple[int, int]]]:
    """Cost and audit of the cheapest edits, and the turns they leave: (row, or -1 where one
    is inserted; state)."""
    n = len(initials)
    # running minimum of each state: cost with the deletions before the next row that stays, that row, its role
    least = {x: (INSERT * len(turns) + DELETE * n, n, _START) for x, turns in _LAST.items()}
    after: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in range(n - 1, -1, -1):
        if must_go[i]:
            continue
        own = _STATE.get(initials[i], _START)
        costs = {}
        for to in (_S, _U, _A) if own == _S else (_U, _A):
            after[i, to] = least[to]
            costs[to] = (KEEP if to == own else REROLE) + (TRUNCATED if truncated[i] else 0) + least[to][0] - DELETE * (i + 1)
        found = {}
        for x, following in _NEXT.items():
            cost, _, _, to = min((costs[to] + INSERT * m + DELETE * i, -m, to != own, to) for to, m in following if to in costs)
            if cost < least[x][0]:
                found[x] = (cost, i, to)
        least |= found
    cost, j, to = least[_START]
    total, audit, turns, at, state = cost, [], [], 0, _START
    while True:
        audit.append("D" * (j - at))
        between = _LAST[state] if j == n else _BETWEEN[state, to]
        audit.append("I" * len(between))
        turns += [(-1, x) for x in between]
        if j == n:
            return total, "".join(audit), turns
        audit.append("K" if _STATE.get(initials[j]) == to else "R")
        turns.append((j, to))
        at, state = j + 1, to
        _, j, to = after[j, to]


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none ("")."""
    out, seen = [], set()
    for role, text in rows:
        solid = text.rstrip(BLANKS)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if solid[-1] in ENDS else "truncated")
        seen.add((role, text))
    return out


def repaired(rows: list[tuple[str, str]]) -> tuple[list[str], int, str, list[tuple[str, str]]]:
    """Faults, cost, audit and the repaired (role, text) of a conversation."""
    found = faults(rows)
    cost, audit, turns = plan([role[:1] for role, _ in rows], [f in ("blank", "duplicate") for f in found], [f == "truncated" for f in found])
    out = []
    for i, state in turns:
        if i < 0:
            out.append((_ROLE[state], ""))
        else:
            role, text = rows[i]
            out.append((role if _STATE.get(role[:1]) == state else _ROLE[state], text))
    return found, cost, audit, out


_LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def _row(turns: list[dict]) -> tuple[list[int], str, list[tuple[str, str]]]:
    rows = [(t["role"], t["text"]) for t in turns for _ in range(t["copies"])]
    found, cost, audit, out = repaired(rows)
    numbers = {t["turn"] for t in turns if t["has"] and t["copies"]}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in _LEGAL for a, b in zip(rows, rows[1:]))  # noqa: B905
    return [gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost], audit, out


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (array of
    struct<role, text>) of every conversation of turns (conv_id, turn, role, text).

    ``copies``: how often each row stands, once if not given; a conversation all whose rows
    stand zero times still has its output row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    each = F.struct(turn.isNotNull().alias("has"), F.coalesce(turn, F.lit(0)).alias("turn"), role, text, (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    groups = turns.select(F.col("conv_id").cast("long"), each.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    @tidy
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [_row(x) for x in part.column(1).to_pylist()]
                columns = [pa.array(x, pa.int64()) for x in zip(*(r[0] for r in rows), strict=True)]
                out = pa.array([[{"role": a, "text": b} for a, b in r[2]] for r in rows], pa.list_(_TURN))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([r[1] for r in rows], pa.string()), out], names=["conv_id", *_COUNTS, "audit", "repaired"])

    return small_batches(groups).mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired array<struct<role: string, text: string>>")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """turns with the query's damage by the CRC-32 of ``conv_id:turn``, and the column that
    says how often each row then stands."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    role, text = part("role"), part("text")
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")


def digest(rows: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return rows.select("conv_id", *_COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return digest(repair(*damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
