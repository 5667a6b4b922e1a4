"""Repair of conversation structure by depth-first branch and bound.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Every row is kept (cost 0), given the role
user or assistant (1) or deleted (2, required if it is blank or a duplicate), and a row with an empty text
can be inserted anywhere (5); a truncated row that stays adds 5.  Of the cheapest edits the string of their
initials that is ASCII-least decides.

The search walks prefixes with an explicit stack, in ASCII order of the edits.  Bounds of all suffixes come
from the same grammar without its end, the incumbent is the best (cost, audit) so far, and a table per node
(row, role before it) holds the cost of the best prefix, so that worse ones go no further.  Equal costs are
settled by the order of the walk: of two prefixes of the same rows with the same cost, the earlier is less.

Rows are dealt out by range of (conversation, turn, role, text digest).  A conversation inside one task is
repaired there.  One that goes over an edge, as a hot one does, is taken in pieces: each gives the best edits
from every role before it to every role after it, and these are joined along the conversation.  Its digest is
a chain over its whole text and is made by one task that streams the rows and holds none.

Order: turn (nulls first), role, SHA-256 of the text.  A null role or text is one space.  Conversations
without an id are one conversation.  Rows marked ``gone`` only name their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gapwise.llm.common import SPACES, Scratch, steps

#: Costs.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What stands before a row: nothing yet, system, user or assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: The state after an initial, and the only user or assistant that may come next.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
#: States that insertions alone reach.
REACHED = ({START, USER, ASSISTANT}, {SYSTEM, USER, ASSISTANT}, {USER, ASSISTANT}, {USER, ASSISTANT})
ENDS = frozenset((START, ASSISTANT))
LEGAL = frozenset(("su", "ua", "au"))
NEVER = 1 << 60


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a row; ``seen`` if its role and text stood earlier."""
    words = text.rstrip(" " + SPACES)
    if not words:
        return BLANK
    return DUPLICATE if seen else SOUND if words[-1] in ".!?" else TRUNCATED


def _edits(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row from a state, in ASCII order: letter, cost, state after it."""
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT if fault == TRUNCATED else 0
    kept = AFTER[state].get(initial)
    if kept is not None:
        out.append(("K", KEEP + more, kept))
    out.append(("R", REROLE + more, NEXT[state]))
    return out


def suffix_bounds(rows: list[tuple[str, int]], goals: frozenset[int]) -> list[list[int]]:
    """For every place and state, no more than the cheapest edits of what follows cost."""
    # Without the grammar's end: whatever insertions could still turn into a goal counts as one.
    bounds = [[0 if REACHED[state] & goals else NEVER for state in range(4)]]
    for initial, fault in reversed(rows):
        after = bounds[-1]
        here = [min(cost + after[to] for _, cost, to in _edits(initial, fault, state)) for state in range(4)]
        user, assistant = here[USER], here[ASSISTANT]
        here[USER], here[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
        here[START], here[SYSTEM] = (min(here[s], INSERT + here[USER]) for s in (START, SYSTEM))
        bounds.append(here)
    return bounds[::-1]


def _greedy(rows: list[tuple[str, int]], bounds: list[list[int]], state: int, goals: frozenset[int]) -> int:
    """The cost of one way to a goal, for a first incumbent."""
    cost = at = 0
    while at < len(rows) or state not in goals:
        choices = [(INSERT, at, NEXT[state])]
        if at < len(rows):
            choices += [(c, at + 1, to) for _, c, to in _edits(*rows[at], state)]
        step, at, state = min(choices, key=lambda c: (c[0] + bounds[c[1]][c[2]], -c[1]))
        cost += step
        if cost >= NEVER:
            break
    return cost


def search(rows: list[tuple[str, int]], state: int = START, goals: frozenset[int] = ENDS) -> tuple[int, str] | None:
    """The cheapest edits (cost, audit) of rows (role initial, fault) from a state to one of the goals."""
    bounds = suffix_bounds(rows, goals)
    if bounds[0][state] >= NEVER:
        return None
    most, audit = _greedy(rows, bounds, state, goals), None
    best = [[NEVER] * 4 for _ in range(len(rows) + 1)]
    path: list[str] = []
    stack = [(0, state, 0, 0, "")]
    while stack:
        at, state, cost, depth, letter = stack.pop()
        del path[max(depth - 1, 0) :]
        if letter:
            path.append(letter)
        bound = cost + bounds[at][state]
        # The first incumbent has only a cost; later ones come earlier in ASCII order than what follows.
        if cost >= best[at][state] or bound > most or (bound == most and audit is not None):
            continue
        best[at][state] = cost
        if at == len(rows) and state in goals:
            most, audit = cost, "".join(path)
        moves = [("I", INSERT, NEXT[state], at)]
        if at < len(rows):
            moves += [(edit, c, to, at + 1) for edit, c, to in _edits(*rows[at], state)]
        for edit, c, to, place in sorted(moves, reverse=True):
            stack.append((place, to, cost + c, depth + 1, edit))
    return None if audit is None else (most, audit)


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the repaired conversation from its rows (role, text) in order."""
    first = (len(audit) - audit.count("D")) % 2  # an odd number of rows starts with the system's
    place, rest = 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if (place - first) % 2 else "user"
        place += 1
        yield f"{role}:{text}"


def digest_of(pieces: Iterable[str]) -> str:
    out = hashlib.sha256()
    for n, piece in enumerate(pieces):
        out.update(("\n" if n else "").encode() + piece.encode("utf-8", "surrogatepass"))
    return out.hexdigest()


# --- on tables ------------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLACE = ["conv", "part", "at"]


def damaged(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows dropped (then marked ``gone``), emptied, cut, repeated or given another role by a hash of their place."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(place.cast("binary")) % 20
    old = F.coalesce(F.col(text), space)
    new = F.when(kind == 1, "").when(kind == 2, F.translate(old, ".!?", "")).otherwise(old)
    named = rows.select(
        F.col(key).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        new.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return named.drop("_copy")


def _open_schema(key: T.DataType) -> T.StructType:
    fields = [("conv", key), ("done", T.BooleanType()), ("part", T.IntegerType()), ("at", T.LongType()), ("turn", T.LongType())]
    fields += [(n, T.StringType()) for n in ("role", "text", "digest")] + [("gone", T.BooleanType()), ("fault", T.IntegerType())]
    fields += [(n, T.LongType()) for n in COUNTS] + [("audit", T.StringType()), ("repaired", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _solve(conv, rows: list[tuple]) -> tuple:
    """The result of a whole conversation; ``rows``: turn, role, text, digest, gone, fault."""
    present = [r for r in rows if not r[4]]
    turns = {r[0] for r in present} - {None}
    faults = [r[5] for r in present]
    initials = [r[1][:1] for r in present]
    cost, audit = search(list(zip(initials, faults)))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(initials), cost)
    return (conv, True, *[None] * 8, *counts, audit, digest_of(repaired(audit, ((r[1], r[2]) for r in present))))


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _first_pass(rows: DataFrame) -> DataFrame:
    """Results of conversations inside one task (``done``), and the rows of those at the edges of tasks."""
    schema = _open_schema(rows.schema["conv"].dataType)

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, number, sent, held, seen = None, 0, 0, [], set()
        out: list[tuple] = []

        def opened() -> list[tuple]:
            return [(conv, False, part, sent + i, *r, *[None] * (len(COUNTS) + 2)) for i, r in enumerate(held)]

        for batch in steps(batches, "text"):
            for c, *row in _rows([batch], ["conv", "turn", "role", "text", "digest", "gone"]):
                if not number or c != conv:
                    if number > 1:
                        out.append(_solve(conv, held))
                    else:
                        out += opened()
                    conv, number, sent, held, seen = c, number + 1, 0, [], set()
                _, role, text, digest, gone = row
                fault = None if gone else fault_of(text, (role, digest) in seen)
                held.append((*row, fault))
                if not gone:
                    seen.add((role, digest))
            if number == 1:  # the first conversation may go on from the task before: no need to hold it
                out += opened()
                sent, held = sent + len(held), []
            yield _batch(out, schema)
            out = []
        yield _batch(opened(), schema)

    return rows.mapInArrow(run, schema)


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """Faults of rows whose role and text stand in a piece before theirs.

    A piece already knows its own duplicates, so a role and text has at most one row per task here.
    """
    fresh = rows.where(F.col("fault").isin(SOUND, TRUNCATED))
    first = fresh.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("part").alias("p"), F.count(F.lit(1)).alias("n"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    joined = rows.join(first.where("n > 1").drop("n"), same & F.col("fault").isin(SOUND, TRUNCATED), "left")
    return joined.withColumn("fault", F.when(F.col("p") < F.col("part"), DUPLICATE).otherwise(F.col("fault"))).drop("c", "r", "d", "p")


def _grouped(rows: Iterator[tuple], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``size`` values."""
    key, held = None, []
    for row in rows:
        if key != row[:size]:
            if held:
                yield key, held
            key, held = row[:size], []
        held.append(row[size:])
    if held:
        yield key, held


_PIECE_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _pieces(rows: DataFrame) -> DataFrame:
    """Per piece of a conversation its counts, outer initials, and best edits between any two states."""
    fields = [("conv", rows.schema["conv"].dataType), ("part", T.IntegerType())] + [(n, T.LongType()) for n in _PIECE_COUNTS]
    fields += [("first", T.StringType()), ("last", T.StringType()), ("costs", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches):
        for (conv, part), held in _grouped(_rows(batches, ["conv", "part", "initial", "fault"]), 2):
            initials, faults = [r[0] for r in held], [r[1] for r in held]
            found = [search(held, a, frozenset((b,))) for a in range(4) for b in range(4)]
            counts = [*(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(initials)]
            yield _batch([(conv, part, *counts, initials[0], initials[-1], [f and f[0] for f in found], [f and f[1] for f in found])], schema)

    coded = rows.select("conv", "part", "at", F.substring("role", 1, 1).alias("initial"), "fault")
    return coded.repartition("conv", "part").sortWithinPartitions(*_PLACE).drop("at").mapInArrow(run, schema)


def joined(best: list, costs: list, audits: list) -> list:
    """The best (cost, audit) in every state after one more piece."""
    out = []
    for to in range(4):
        ways = [(b[0] + costs[4 * a + to], b[1] + audits[4 * a + to]) for a, b in enumerate(best) if b and costs[4 * a + to] is not None]
        out.append(min(ways, default=None))
    return out


def _along(pieces: DataFrame) -> DataFrame:
    """Counts, cost and audit of conversations from their pieces; only one piece at a time is held."""
    fields = [("conv", pieces.schema["conv"].dataType)] + [(n, T.LongType()) for n in (*_PIECE_COUNTS, "cost")] + [("audit", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches):
        current = None

        def result():
            cost, audit = min(b for b in (best[s] for s in ENDS) if b)
            return _batch([(current[0], *counts, cost, audit)], schema)

        names = ["conv", "part", *_PIECE_COUNTS, "first", "last", "costs", "audits"]
        for batch in steps(batches, "audits"):
            for conv, _, *numbers, first, last, costs, audits in _rows([batch], names):
                if current is None or current[0] != conv:
                    if current:
                        yield result()
                    current, counts, best, before = (conv,), [0] * len(_PIECE_COUNTS), [(0, ""), None, None, None], None
                counts = [a + b for a, b in zip(counts, numbers)]
                counts[-1] += before is not None and before + first not in LEGAL
                best, before = joined(best, costs, audits), last
        if current:
            yield result()

    return pieces.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)


def _digests(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The results with ``repaired``, the digest of each conversation, made while its rows stream by."""
    names = results.columns
    schema = T.StructType([*results.schema.fields, T.StructField("repaired", T.StringType())])
    ahead = results.withColumns({"part": F.lit(-1), "at": F.lit(0).cast("long")})
    both = ahead.unionByName(rows.select("conv", "part", "at", "role", "text"), allowMissingColumns=True)

    def run(batches):
        stream = ((row[: len(names)], row[-3:]) for row in _rows(steps(batches, "text"), [*names, "role", "text", "part"]))
        head = next(stream, None)
        while head is not None:
            result, following = head[0], []

            def own():
                for _, (role, text, part) in (pair for pair in iter(lambda: next(stream, None), None)):
                    if part < 0:
                        following.append((_, None))
                        return
                    yield role, text

            rest = own()
            digest = digest_of(repaired(result[names.index("audit")], rest))
            for _ in rest:  # deleted rows at the end
                pass
            yield _batch([(*result, digest)], schema)
            head = following[0] if following else None

    return both.repartition("conv").sortWithinPartitions(*_PLACE).mapInArrow(run, schema)


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv``, the counts, ``cost``, ``audit`` and ``repaired`` (SHA-256) of every conversation.

    ``rows``: ``conv, turn, role, text, gone``, as ``damaged`` gives them.
    """
    named = rows.select("conv", "turn", "role", "text", F.sha2("text", 256).alias("digest"), "gone")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    found = scratch.put(_first_pass(named.repartitionByRange(*order).sortWithinPartitions(*order)), "first-pass")
    results = ["conv", *COUNTS, "audit", "repaired"]
    done, rest = found.where("done").select(*results), found.where("NOT done")

    present = scratch.put(_with_duplicates(rest.where("NOT gone").select(*_PLACE, "turn", "role", "text", "digest", "fault")), "edges")
    edited = _along(scratch.put(_pieces(present), "pieces"))
    turn = F.when(~F.col("gone"), F.col("turn"))
    span = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    gaps = rest.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    # A conversation whose rows are all gone has no pieces.
    everything = gaps.join(edited.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    everything = everything.na.fill(0, [*_PIECE_COUNTS, "cost"]).na.fill("", ["audit"]).select(*results[:-1])
    return done.unionByName(_digests(present, everything).select(*results))
