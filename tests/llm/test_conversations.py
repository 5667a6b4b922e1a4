"""Repair of conversations against an exhaustive search, inside tasks and over their edges."""

import itertools
import random
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from gapwise.llm import conversations as conv
from gapwise.llm.common import Scratch

GOOD = re.compile("(s?(ua)+)?")
COLUMNS = ("conv", *conv.COUNTS, "audit", "repaired")
SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, audit string, part int"


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits; ``rows``: role, text, fault."""
    best = None
    choices = []
    for role, text, fault in rows:
        more = 5 if fault == "truncated" else 0
        edits = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            edits += [("K", more, (role, text))] + [("R", 1 + more, (r, text)) for r in ("user", "assistant")]
        choices.append(edits)
    extra = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*choices):
        base = sum(e[1] for e in edits)
        if best and base > best[0]:
            continue
        for places in itertools.product(extra, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, places))
            if best and cost > best[0]:
                continue
            letters, out = "", []
            for n, inserted in enumerate(places):
                letters += "I" * len(inserted)
                out += [(r, "") for r in inserted]
                if n < len(rows):
                    letters += edits[n][0]
                    out += [edits[n][2]] if edits[n][2] else []
            if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                found = (cost, letters, "\n".join(f"{r}:{t}" for r, t in out))
                best = min(best, found) if best else found
    return best


def by_rows(rows):
    """(cost, audit) by the best way to every place and state, one row after the other."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def with_inserts(best):
        for _ in range(3):
            for (before, initial), after in step.items():
                if initial != "s" and before in best:
                    cost, audit = best[before]
                    best[after] = min(best.get(after, (10**9, "")), (cost + 5, audit + "I"))
        return best

    for role, _, fault in rows:
        more, after = 5 if fault == "truncated" else 0, {}
        for before, (cost, audit) in with_inserts(best).items():
            ways = [(before, cost + 2, audit + "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(step[before, i], cost + more + (i != role[:1] or r), audit + ("R" if i != role[:1] or r else "K")) for i in "sua" for r in (0, 1) if (before, i) in step and (i != "s" or (role[:1] == "s" and not r))]
            for to, c, a in ways:
                after[to] = min(after.get(to, (10**9, "")), (c, a))
        best = after
    best = with_inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not words else "duplicate" if (role, text) in seen else "ok" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def plain(table, search):
    """Every conversation's result; ``table``: conv, turn, role, text before the damage."""
    groups = {}
    for c, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups.setdefault(c, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = set()
    for c, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], brute.sha(r[2])))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        judged = faults_of([r[1:] for r in rows])
        kinds = [k for _, _, k in judged]
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = search(judged)
        out.add((c, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, brute.sha(text)))
    return out


def with_text(rows):
    cost, audit = by_rows(rows)
    return cost, audit, "\n".join(conv.repaired(audit, [r[:2] for r in rows]))


def test_search_finds_the_cheapest_least_edits():
    rng = random.Random(5)
    for n in range(120):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " "]), rng.choice(["A.", "b", "C!", " ", "d?"])) for _ in range(n % 5)]
        judged = faults_of(rows)
        cost, audit, text = cheapest(judged)
        assert (cost, audit) == by_rows(judged)
        codes = [(r[:1], ("ok", "blank", "duplicate", "truncated").index(k)) for r, _, k in judged]
        assert conv.search(codes) == (cost, audit)
        assert "\n".join(conv.repaired(audit, rows)) == text


def test_search_of_long_conversations():
    rng = random.Random(6)
    for kind in ("sua", "u", "a", "s", "uat"):
        rows = [(rng.choice(kind), "", rng.choice(["ok", "ok", "truncated", "blank"])) for _ in range(1500)]
        codes = [(r, ("ok", "blank", "duplicate", "truncated").index(k)) for r, _, k in rows]
        assert conv.search(codes) == by_rows(rows)
        cuts = sorted(rng.sample(range(1500), 3))
        best = [(0, ""), None, None, None]
        for a, b in zip([0, *cuts], [*cuts, 1500]):
            found = [conv.search(codes[a:b], s, frozenset((t,))) for s in range(4) for t in range(4)]
            best = conv.joined(best, [f and f[0] for f in found], [f and f[1] for f in found])
        assert min(b for b in (best[conv.START], best[conv.ASSISTANT]) if b) == by_rows(rows)


def awkward():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, ""]), rng.choice(["Yes.", "No!", "cut off", "", None, " \n", "é?", "Yes."])) for c in range(40) for t in range(c % 9)]
    rows += [(None, None, "user", "Hi."), (None, None, "user", "Hi."), (None, 4, "assistant", "w " * 50_000 + "."), (None, None, None, None)]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Line {t % 50}.") for t in range(900)]
    rows += [(101, 3, r, x) for r in ("user", "assistant") for x in ("A.", "B.", "A.")]
    return rows


@pytest.mark.parametrize("parts", ["8", "67"])
def test_conversations(spark, parts):
    rows = awkward()
    table = spark.createDataFrame([(*r, True, "x", 1) for r in rows], SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == "8").lower())
    try:
        got = {tuple(r) for r in conv.repair(conv.damaged(table), Scratch(spark, "test")).select(*COLUMNS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows, with_text)


def test_the_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = [tuple(r) for r in entry.queries()["op11_conversations"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, with_text)


def test_no_conversations(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conv.repair(conv.damaged(table), Scratch(spark, "test")).count() == 0
    one = spark.createDataFrame([(c, t, "user", "A.", True, "", 1) for c in range(60) for t in range(1)], SCHEMA)
    gone = {c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0}
    out = {r.conv: (r.cost, r.audit, r.repaired) for r in conv.repair(conv.damaged(one), Scratch(spark, "test")).collect()}
    assert len(out) == 60 and gone and all(out[c] == (0, "", brute.sha("")) for c in gone)
