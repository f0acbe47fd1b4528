"""Repair of conversation structure by depth-first branch-and-bound.

A conversation should read `(s?(ua)+)?` by its role initials. Edits cost: Keep 0,
Rerole 1, Delete 2, Insert 5; a truncated row that is not deleted adds 5; blank
and duplicate rows must go. The search walks edits depth first in ASCII order over
an explicit stack. It gives up a prefix when its cost and the least that the rest
must cost reach the incumbent, or when the same node was reached as cheaply before:
the earlier prefix is the ASCII-smaller one, so the first audit found at the least
cost is the answer.

Rows are judged without their texts: each becomes one character. Those are range
partitioned in conversation order, so that a conversation may span tasks: a part of one
is searched from every state to every state, and the parts' tables are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut

SPACES = " \t\n\x0b\f\r"
PART = 256  # rows that are searched together; longer conversations are added up from parts
REMEMBERED = 50_000  # patterns whose repair a task remembers
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5

# states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row
EXPECTED, AFTER = "uuau", (2, 2, 3, 2)
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # what completes each state
DONE = 4  # the exit of a part that holds a whole conversation
LEGAL = ("su", "ua", "au")

# a row's character: fault (none, truncated, duplicate, blank) by role initial (system, user, assistant, other)
CODES = {"": "suax", "truncated": "SUAX", "duplicate": "0123", "blank": "4567"}
_INITIALS = str.maketrans("".join(CODES.values()), "suax" * 4)
_SEARCHED = str.maketrans("01234567", "--------")


def _moves(state: int, row: str) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next state, rows used), in ASCII order of the edits.

    An insertion before a row that must go is left out: the same rows result, at the
    same cost and with a smaller audit, when it follows the deletion.
    """
    if row == "-":
        return [("D", DELETE, state, 1)]
    kept = CUT_OFF if row.isupper() else 0
    out = [("D", DELETE, state, 1), ("I", INSERT, AFTER[state], 0)]
    if row.lower() == EXPECTED[state]:
        out.append(("K", kept, AFTER[state], 1))
    elif row.lower() == "s" and state == 0:
        out.append(("K", kept, 1, 1))
    return [*out, ("R", REROLE + kept, AFTER[state], 1)]


MOVES = [{row: _moves(state, row) for row in "suaxSUAX-"} for state in range(4)]
_LEAST: dict[str, int] = {}


def _least(rows: str) -> int:
    """What a few rows cost at least, from whatever state."""
    if rows not in _LEAST:
        costs = [0, 0, 0, 0]
        for row in rows:
            for _ in range(2):
                for state in range(4):
                    costs[AFTER[state]] = min(costs[AFTER[state]], costs[state] + INSERT)
            after = [1 << 30] * 4
            for state in range(4):
                for _, cost, to, used in MOVES[state][row]:
                    if used:
                        after[to] = min(after[to], costs[state] + cost)
            costs = after
        _LEAST[rows] = min(costs)
    return _LEAST[rows]


def suffix_bounds(rows: str) -> list[int]:
    """Lower bound of the cost of each suffix: the dearest way to cut it into runs of at most four rows."""
    bounds = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        bounds[i] = max(_least(rows[i : i + k]) + bounds[i + k] for k in range(1, min(4, len(rows) - i) + 1))
    return bounds


def _edits(path: tuple) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def search(rows: str, entry: int = 0, goal: int | None = None) -> tuple[int, str]:
    """Least (cost, audit) from state `entry` through all rows, to state `goal` or to a complete conversation.

    `goal` must be reachable. The first incumbent is only a guess, the bound and a slack that doubles until a
    repair is found below it.
    """
    bounds, slack = suffix_bounds(rows), 1
    while True:
        best, found = bounds[0] + slack, None
        least = [[1 << 30] * 4 for _ in range(len(rows) + 1)]
        stack: list[tuple] = [(0, entry, 0, ())]
        while stack:
            i, state, cost, path = stack.pop()
            if cost + bounds[i] >= best or cost >= least[i][state]:
                continue
            if goal is not None and goal < 2 and state > goal:  # nothing leads back to states 0 and 1
                continue
            least[i][state] = cost
            if i == len(rows):
                extra, tail = END[state] if goal is None else (0 if state == goal else 1 << 30, "")
                if cost + extra < best:
                    best, found = cost + extra, (path, tail)
                continue
            for edit, extra, to, used in reversed(MOVES[state][rows[i]]):
                stack.append((i + used, to, cost + extra, (path, edit)))
        if found is not None:
            return best, _edits(found[0]) + found[1]
        slack *= 2


def reachable(rows: str, entry: int, goal: int) -> bool:
    """Whether edits without insertions after the last row can lead from `entry` to `goal`."""
    if not rows.strip("-"):
        return entry == goal
    return goal >= 2 or entry == goal or (entry == 0 and goal == 1 and "s" in rows.lower())


def part_table(pattern: str, whole: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a part; one line if it is a whole conversation."""
    rows = pattern.translate(_SEARCHED)
    if whole:
        return [(0, DONE, *search(rows))]
    return [(a, b, *search(rows, a, b)) for a in range(4) for b in range(4) if reachable(rows, a, b)]


def add_tables(tables: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from the tables of its parts, in order.

    Audits of one length of rows are never true prefixes of each other, so their order is
    settled by the first part in which they differ: states carry a rank instead of audits.
    """
    front, steps = {0: (0, 0)}, []
    for table in tables:
        found: dict[int, tuple] = {}
        for entry, leave, cost, audit in table:
            if entry in front:
                option = (front[entry][0] + cost, front[entry][1], audit, entry)
                if leave not in found or option < found[leave]:
                    found[leave] = option
        ranks = {leave: k for k, leave in enumerate(sorted(found, key=lambda e: found[e][1:3]))}
        front = {leave: (option[0], ranks[leave]) for leave, option in found.items()}
        steps.append({leave: (option[3], option[2]) for leave, option in found.items()})
    ends = [*END, (0, "")]
    state = min(front, key=lambda e: (front[e][0] + ends[e][0], front[e][1]))
    cost, audits = front[state][0] + ends[state][0], [ends[state][1]]
    for step in reversed(steps):
        state, audit = step[state]
        audits.append(audit)
    return cost, "".join(reversed(audits))


def _study(pattern: str, whole: bool) -> tuple:
    """Faults, illegal neighbours and table of a part."""
    initials = pattern.translate(_INITIALS)
    faults = [sum(pattern.count(c) for c in CODES[fault]) for fault in ("blank", "duplicate", "truncated")]
    return *faults, sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1)), part_table(pattern, whole)


PART_SCHEMA = (
    "conv_id long, task long, part long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, entry array<int>, leave array<int>, cost array<long>, audit array<string>"
)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations from ordered rows (conv_id, turn, row, again, n); see `PART_SCHEMA`."""
    task, known = TaskContext.get().partitionId(), {}
    names = [field.split()[0] for field in PART_SCHEMA.split(", ")]
    out: list[tuple] = []

    def close(conv: int | None, pattern: list[str], turns: list[int], whole: bool) -> None:
        text = "".join(pattern)
        if (text, whole) not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[text, whole] = _study(text, whole)
        blank, duplicate, truncated, illegal, table = known[text, whole]
        ends = text.translate(_INITIALS)
        low, high = (turns[0], turns[-1]) if turns else (None, None)
        entry, leave, cost, audit = (list(c) for c in zip(*table))
        out.append((conv, task, len(out) + base, blank, duplicate, truncated, illegal, ends[0], ends[-1], low, high, len(turns), entry, leave, cost, audit))

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else ([] for _ in names)
        kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    base, current, pattern, turns, open_start = 0, None, [], [], True
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            conv, turn, code, again, n = row
            if pattern and conv != current:
                close(current, pattern, turns, whole=not open_start)
                pattern, turns, open_start = [], [], False
            current = conv
            left = n
            while left:
                if len(pattern) == PART:
                    close(current, pattern, turns, whole=False)
                    pattern, turns, open_start = [], [], True
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
                fresh = [code] if left == n else []
                some = min(left, PART - len(pattern))
                pattern += fresh + [again] * (some - len(fresh))
                left -= some
        if len(out) >= 2000:
            yield flush()
            base, out = base + len(out), []
    if pattern:  # its conversation may go on in the next task
        close(current, pattern, turns, whole=False)
    yield flush()


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the faults that crc32(`conv_id:turn`) % 20 sets; nulls become one space."""
    spot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spot("conv_id"), F.lit(":"), spot("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.where(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest():
    return F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest")


def judged_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, row, again, n): one line for equal rows of one turn, without the text.

    `row` is the character of the first of the n rows, `again` that of the others.
    """
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    number = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    number = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), number - 1).otherwise(3)
    own = F.when(solid == "", 3).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    lines = rows.select("conv_id", "turn", "role", _digest(), (own * 4 + number).alias("code"), "copies")
    lines = lines.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.max("code").alias("code"))
    lines = cut(lines)
    # null turns come first in the order of structs, as they do in a conversation
    firsts = lines.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    firsts = firsts.select("conv_id", F.col("t.turn").alias("turn"), "role", "digest", F.lit(0).cast("long").alias("n"), F.lit(-1).alias("code"), F.lit(1).alias("fresh"))
    marked = lines.withColumn("fresh", F.lit(0)).unionByName(firsts)
    marked = marked.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.max("code").alias("code"), F.max("fresh").alias("fresh"))
    letters = F.lit("".join(CODES.values()))
    again = F.when(F.col("code") >= 12, F.col("code")).otherwise(8 + F.col("code") % 4)
    own = F.when(F.col("fresh") == 1, F.col("code")).otherwise(again)
    letter = lambda c: F.substring(letters, c.cast("int") + 1, F.lit(1))
    return marked.select("conv_id", "turn", "role", "digest", letter(own).alias("row"), letter(again).alias("again"), "n")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _summary(parts: list[dict]) -> tuple:
    """gaps, the four counts, cost and audit of a conversation from its parts, in order."""
    if not parts:
        return 0, 0, 0, 0, 0, 0, ""
    counts = [sum(p[name] for p in parts) for name in COUNTS]
    counts[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    dated = [p for p in parts if p["turns"]]
    turns = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
    cost, audit = add_tables([*zip(p["entry"], p["leave"], p["cost"], p["audit"])] for p in parts)
    return gaps, *counts, cost, audit


def _apply(audit: Iterator[str], state: int, role: str) -> tuple[list[str], str | None, int]:
    """Roles inserted before a row, the row's new role (None: deleted) and the state after it."""
    inserted: list[str] = []
    for edit in audit:
        if edit == "D":
            return inserted, None, state
        written = "assistant" if state == 2 else "user"
        if edit == "K":
            return inserted, role, 1 if state == 0 and role[:1] == "s" else AFTER[state]
        state = AFTER[state]
        if edit == "R":
            return inserted, written, state
        inserted.append(written)
    return inserted, None, state


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("start", conv_id, summary), ("turn", role, text) ... and ("end", conv_id) of every conversation, from its parts and then its texts."""
    current, parts, audit, state = (), [], None, 0
    for batch in batches:
        for conv, part, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "copies"))):
            if current != (conv,):
                if current:
                    yield from _finish(current[0], parts, audit, state)
                current, parts, audit, state = (conv,), [], None, 0
            if text is None:
                if part is not None:
                    parts.append(part)
                continue
            if audit is None:
                found = _summary(parts)
                yield "start", conv, found
                audit = iter(found[-1])
            for _ in range(copies):
                inserted, written, state = _apply(audit, state, role)
                for extra in inserted:
                    yield "turn", extra, ""
                if written is not None:
                    yield "turn", written, text
    if current:
        yield from _finish(current[0], parts, audit, state)


def _finish(conv: int | None, parts: list[dict], audit: Iterator[str] | None, state: int) -> Iterator[tuple]:
    if audit is None:  # no row left
        yield "start", conv, _summary(parts)
    else:
        for extra in _apply(audit, state, "")[0]:
            yield "turn", extra, ""
    yield "end", conv


def _joined(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """Parts and texts of every conversation side by side, in conversation order."""
    ordered = ["conv_id", "turn", "role", "digest"]
    judged = judged_rows(rows).repartitionByRange(*ordered).sortWithinPartitions(*ordered).select("conv_id", "turn", "row", "again", "n")
    parts = cut(judged.mapInArrow(_parts, PART_SCHEMA))
    inner = [c for c in parts.columns if c != "conv_id"]
    kept = parts.select("conv_id", F.struct(*inner).alias("part"))
    none = conv_ids.select("conv_id").distinct()
    texts = rows.select("conv_id", "turn", "role", _digest(), "text", "copies")
    every = texts.unionByName(kept, allowMissingColumns=True).unionByName(none, allowMissingColumns=True)
    every = every.withColumn("place", F.when(F.col("text").isNotNull(), 2).when(F.col("part").isNotNull(), 1).otherwise(0))
    order = ["conv_id", "place", F.col("part.task"), F.col("part.part"), "turn", "role", "digest"]
    return every.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "part", "role", "text", "copies")


def _own(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))


def _with_copies(conversations: DataFrame) -> DataFrame:
    """Undamaged rows: nulls become one space."""
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", blank("role"), blank("text"), F.lit(1).cast("long").alias("copies"))


def repair(conversations: DataFrame, *, damaged: bool = False) -> DataFrame:
    """One line per conversation: faults, the cheapest audit and the SHA-256 of the repaired conversation.

    `damaged` first sets faults by `damage`. Rows of one turn are ordered by role, then by a digest of the text, so repeated rows lie
    side by side. Null roles and texts count as one space; null turns come first; the rows without conv_id form one
    conversation. A conversation with no rows gets zeros, an empty audit and the hash of nothing. Extra columns are
    ignored; an empty table gives no lines. A text of any length is one value of one row. One conversation's hash is
    one chain, so its texts pass through one task, row by row and without being held.
    """
    own = _own(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [field.split()[0] for field in SUMMARY.split(", ")] + ["repaired_sha256"]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else ([] for _ in names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for event, first, *rest in _conversations(batches):
            if event == "start":
                summary, digest, begun = rest[0], hashlib.sha256(), False
            elif event == "turn":
                digest.update(("\n" if begun else "").encode() + f"{first}:{rest[0]}".encode())
                begun = True
            else:
                out.append((first, *summary, digest.hexdigest()))
                if len(out) >= 2000:
                    yield flush()
                    out = []
        yield flush()

    rows = damage(own) if damaged else _with_copies(own)
    return _joined(rows, own).mapInArrow(run, SUMMARY + ", repaired_sha256 string")


def repaired_turns(conversations: DataFrame, *, damaged: bool = False) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves, places from 0; cases as in `repair`."""
    own = _own(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else ([] for _ in range(4))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv_id", "place", "role", "text"])

        out: list[tuple] = []
        for event, first, *rest in _conversations(batches):
            if event == "start":
                conv, place = first, 0
            elif event == "turn":
                out.append((conv, place, first, rest[0]))
                place += 1
                if len(out) >= 500:
                    yield flush()
                    out = []
        yield flush()

    rows = damage(own) if damaged else _with_copies(own)
    return _joined(rows, own).mapInArrow(run, "conv_id long, place long, role string, text string")
