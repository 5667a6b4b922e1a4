"""The ordered primitives against plain Python, with whole keys and with small chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.ordered import (
    Axis, Lag, Last, Lead, Least, Next, Sum, Tail, asof, fold, overlap_join, plan_axis, quantiles,
    row_number, scan,
)

MODES = (None, 3.0)


def table(spark, seed=1, sessions=4, rows=17):
    rng = random.Random(seed)
    data = []
    for s in range(sessions):
        frame = 0
        for _ in range(rows):
            frame += rng.choice((1, 1, 1, 2, 9))
            data.append((s, frame, rng.choice((None, *range(9)))))
    return data, spark.createDataFrame(data, "session_id int, frame int, v int")


@pytest.mark.parametrize("width", MODES)
def test_scan_matches_python(spark, width):
    data, df = table(spark)
    axis = Axis(("session_id",), ("frame",), width)
    out = scan(
        df, axis, lag=Lag(F.col("v")), lead=Lead(F.col("v")), last=Last(F.col("v")),
        prev=Last(F.col("v"), here=False), nxt=Next(F.col("v")), after=Next(F.col("v"), here=False),
        total=Sum(F.col("v")), low=Least(F.col("v")), n=row_number(), tail=Tail(F.col("frame"), 4),
    )
    got = {(r.session_id, r.frame): r for r in out.collect()}
    for s in {d[0] for d in data}:
        rows = [d for d in data if d[0] == s]
        v = [d[2] for d in rows]
        for i, (_, frame, _) in enumerate(rows):
            known = [x for x in v[: i + 1] if x is not None]
            before = [x for x in v[:i] if x is not None]
            r = got[s, frame]
            assert r.lag == (v[i - 1] if i else None)
            assert r.lead == (v[i + 1] if i + 1 < len(v) else None)
            assert r.last == (known[-1] if known else None)
            assert r.prev == (before[-1] if before else None)
            assert r.nxt == next((x for x in v[i:] if x is not None), None)
            assert r.after == next((x for x in v[i + 1 :] if x is not None), None)
            assert r.total == (sum(known) if known else None)
            assert r.low == (min(known) if known else None)
            assert r.n == i + 1
            assert r.tail == [d[1] for d in rows[max(0, i - 3) : i + 1]]


@pytest.mark.parametrize("width", MODES)
def test_fold_carries_state(spark, width):
    data, df = table(spark, seed=2)
    schema = T.StructType.fromDDL("session_id int, frame int, state int")

    def step(state, rows):
        out = []
        for r in rows:
            # Forgets at every null, so assumed states soon come true.
            state = None if r.v is None or r.v != r.v else (state or 0) * 2 % 7 + int(r.v)
            out.append((r.session_id, r.frame, state))
        return state, out

    got = {(r.session_id, r.frame): r.state for r in
           fold(df, Axis(("session_id",), ("frame",), width), step, schema).collect()}
    for s in {d[0] for d in data}:
        state = None
        for _, frame, v in (d for d in data if d[0] == s):
            state = None if v is None else (state or 0) * 2 % 7 + v
            assert got[s, frame] == state


@pytest.mark.parametrize("bound", (1000, 5))
def test_asof(spark, group_rows, bound):
    group_rows(bound)
    rng = random.Random(3)
    left = [(s, rng.random() * 10) for s in range(3) for _ in range(20)]
    right = [(s, rng.random() * 10, i) for s in range(3) for i in range(12)]
    l_df = spark.createDataFrame(left, "k int, t double")
    r_df = spark.createDataFrame(right, "k int, at double, id int")
    axis = plan_axis(l_df, ("k",), ("t",))
    assert axis.chunked == (bound == 5)
    rows = asof(l_df, r_df, axis, "t", "at", "m").collect()
    assert len(rows) == len(left)
    for r in rows:
        before = [x for x in right if x[0] == r.k and x[1] <= r.t]
        want = max(before, key=lambda x: x[1])[2] if before else None
        assert (r.m.id if r.m else None) == want


def test_overlap_join_finds_every_pair_once(spark):
    rng = random.Random(4)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.choice((rng.random() * 50, float(rng.randrange(50))))
            out.append((rng.randrange(2), i, a, a + rng.choice((0.0, 0.3, 4.0, 33.0, 1e-9))))
        return out

    a, b = spans(60), spans(60)
    schema = "k int, id int, s double, e double"
    pairs = overlap_join(
        spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("k",), ("s", "e"), ("s", "e")
    )
    got = sorted((r.l.id, r.r.id) for r in pairs.collect())
    want = sorted(
        (x[1], y[1]) for x in a for y in b
        if x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3])
    )
    assert got == want


@pytest.mark.parametrize("bound", (1000, 4))
def test_quantiles_are_exact(spark, group_rows, bound):
    group_rows(bound)
    rng = random.Random(5)
    data = [(k, float(rng.randrange(30))) for k in range(3) for _ in range(5 + 20 * k)]
    rows = quantiles(spark.createDataFrame(data, "k int, v double"), ("k",), "v",
                     {"mid": 0.5, "high": 0.95}).collect()
    for r in rows:
        v = [x for k, x in data if k == r.k]
        assert r.mid == pytest.approx(np.quantile(v, 0.5))
        assert r.high == pytest.approx(np.quantile(v, 0.95))


def test_plan_axis_keeps_equal_values_together(spark, group_rows):
    """One value that repeats beyond the bound stays in one chunk; the rest is cut all the same."""
    from gapwise.ordered import Sum, scan

    group_rows(3)
    rows = [(0, 1.0, n) for n in range(9)] + [(0, 10.0 + n, 9 + n) for n in range(9)]
    table = spark.createDataFrame(rows, "k int, t double, n int")
    axis = plan_axis(table, ("k",), ("t", "n"))
    assert axis.chunked
    assert max(r["count"] for r in table.groupBy(axis.chunk()).count().collect()) <= 9
    got = scan(table, axis, upto=Sum(F.col("n"))).orderBy("t", "n").collect()
    assert [r.upto for r in got] == [sum(range(i + 1)) for i in range(18)]
