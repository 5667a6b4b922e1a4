"""Set forms against plain sequential rules on many random sequences (one per session)."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gapwise.channel import Channel
from gapwise.operators import admission, joins, labels, odometry, runs, scoring, selection
from gapwise.operators.fusion import AnchorSettings, Fuser, FusionSettings, find_anchor
from gapwise.operators.runs import EventSettings
from gapwise.ordered import Axis, group_rows as bound_of, plan_axis

SESSIONS = 150
SETTINGS = EventSettings(on=5, off=2, persistence=0.1, max_gap=0.05)
BRAKE = Channel("brake", "v", "q")


def signals(seed):
    rng = random.Random(seed)
    data = []
    for s in range(SESSIONS):
        frame, time, v = 0, 0.0, 0.0
        for _ in range(rng.randrange(1, 40)):
            frame += rng.choice((1,) * 9 + (2,))
            time = round(time + rng.choice((0.02,) * 9 + (0.08,)), 6)
            v = rng.choice((v, v, v, 0.0, 1.0, 3.0, 6.0, 50.0, 101.0))
            q = rng.choice(("observed",) * 12 + ("held", "missing"))
            data.append((s, frame, time, None if q == "missing" else v, q, rng.choice((None, 1, 1, 2, 2, 3))))
    return data


@pytest.fixture(scope="module", params=(1, 2))
def signal(request, spark):
    data = signals(request.param)
    schema = "session_id int, frame long, time_s double, v double, q string, raw int"
    return data, spark.createDataFrame(data, schema).cache()


@pytest.fixture(params=("whole", "chunks"))
def axis(request):
    return Axis(("session_id",), ("frame",), 7.0 if request.param == "chunks" else None)


def per_session(data):
    return {k: list(g) for k, g in itertools.groupby(data, key=lambda d: d[0])}


def ok(row):
    return row[4] == "observed" and row[3] is not None and 0 <= row[3] <= 100


def test_hysteresis_events(signal, axis):
    data, df = signal
    want = []
    for s, rows in per_session(data).items():
        on, wait, last = None, None, None
        for r in rows:
            _, frame, t, v, *_ = r
            if not ok(r):
                on = wait = last = None
                continue
            if last is None or not 0 < t - last <= 0.05 + 1e-12:
                on = wait = None
            if on is None:
                on = True if v >= 5 else (False if v <= 2 else None)
                if on:
                    want.append((s, "brake_active_unbounded", frame, frame))
            elif (v <= 2) if on else (v >= 5):
                wait = wait or (frame, t)
                if t - wait[1] + 1e-12 >= 0.1:
                    want.append((s, "brake_off" if on else "brake_on", wait[0], frame))
                    on, wait = not on, None
            else:
                wait = None
            last = t
    got = runs.hysteresis_events(df, axis, BRAKE, SETTINGS)
    got = got.select("session_id", "type", "frame", "confirmed_frame").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert want


def test_no_event_without_fresh_rows(signal, axis):
    data, df = signal
    fresh = {(r[0], r[1]) for r in data if ok(r)}
    for event in runs.hysteresis_events(df, axis, BRAKE, SETTINGS).collect():
        assert (event.session_id, event.frame) in fresh
        assert (event.session_id, event.confirmed_frame) in fresh


def test_runs_and_gaps_cover_every_row_once(signal, axis):
    data, df = signal
    samples = sum(r.samples for r in runs.evidence_runs(df, axis, BRAKE, 0.05).collect())
    assert samples == sum(ok(r) for r in data)
    gaps = runs.evidence_gaps(df, axis, BRAKE, 0.05, 0.02).filter("kind = 'invalid_samples'").collect()
    bad = {(r[0], r[1]) for r in data if not ok(r)}
    hit = {(g.session_id, f) for g in gaps for f in range(g.start_frame, g.end_frame)} & bad
    assert hit == bad


def test_label_confirmation(signal, axis):
    data, df = signal
    want = {}
    for s, rows in per_session(data).items():
        sure, pending, n = None, None, 0
        for r in rows:
            raw, boundary = r[5], False
            if raw is not None and (sure is None or raw == sure + 1):
                n = n + 1 if pending == raw else 1
                pending = raw
                if n == 2:
                    boundary = sure is not None
                    sure, pending, n = raw, None, 0
            else:
                pending, n = None, 0
            want[s, r[1]] = (sure, boundary)
    got = labels.confirm_labels(df, axis, "raw", 2).collect()
    assert {(r.session_id, r.frame): (r.confirmed_label, r.is_boundary) for r in got} == want


def test_rate_admission(signal, axis):
    data, df = signal
    want = {}
    for s, rows in per_session(data).items():
        last = None
        for _, frame, t, v, q, _ in rows:
            if q != "observed" or v is None:
                last, bad = None, False
            else:
                bad = False
                if last is not None and t - last[0] <= 0.05:
                    change, allowed = abs(v - last[1]), 100 * (t - last[0])
                    bad = change > allowed and not math.isclose(change, allowed)
                last = None if bad else (t, v)
            want[s, frame] = bad
    rows = df.withColumns({"value": F.col("v"), "quality": F.col("q")})
    got = admission.admit_rate(rows, axis, max_rate=100, max_gap=0.05).collect()
    assert {(r.session_id, r.frame): r.admission_reason is not None for r in got} == want
    assert all(r.value is None for r in got if r.admission_reason)


def test_filling_never_leaves_its_bracket(signal, axis):
    _, df = signal
    rows = odometry.fill_bounded(df, axis, "v", 0.1).collect()
    by = per_session(sorted((r.session_id, r.frame, r) for r in rows))
    for session in by.values():
        values = [r for *_, r in session]
        for i, r in enumerate(values):
            if not r.was_filled:
                assert r.filled_value == r.v
                continue
            left = next(x for x in values[i::-1] if x.v is not None)
            right = next(x for x in values[i:] if x.v is not None)
            assert right.time_s - left.time_s <= 0.1
            low, high = sorted((left.v, right.v))
            assert low - 1e-9 <= r.filled_value <= high + 1e-9


def test_every_step(signal, axis):
    data, df = signal
    want = set()
    for s, rows in per_session(data).items():
        due = 0
        for r in rows:
            if r[2] >= due * 0.07:
                want.add((s, r[1]))
                due += 1
    got = selection.every_step(df, axis, 0.07).collect()
    assert {(r.session_id, r.frame) for r in got} == want


@pytest.mark.parametrize("bound", (1000, 5))
def test_matching_against_brute_force(spark, group_rows, bound):
    group_rows(bound)
    rng = random.Random(7)
    truth, found = [], []
    for s in range(40):
        for i in range(rng.randrange(6)):
            a = rng.randrange(30) / 2
            truth.append((s, i, a, a + 1.0))
        for i in range(rng.randrange(6)):
            t = rng.randrange(30) / 2
            found.append((s, i, t, t + 0.5))
    t_df = spark.createDataFrame(truth, "session_id int, id long, lo_s double, hi_s double")
    p_df = spark.createDataFrame(found, "session_id int, id long, time_s double, confirmed_at_s double")
    axis = plan_axis(t_df.unionByName(p_df, allowMissingColumns=True).withColumn(
        "t", F.coalesce("lo_s", "time_s")).withColumn("u", F.monotonically_increasing_id()),
        ("session_id",), ("t", "u"))
    assert axis.chunked == (bound_of(spark) == 5)
    rows = scoring.match_events(t_df, p_df, axis, 2.0).collect()
    for s in range(40):
        mid = sorted(r[2] + 0.5 for r in truth if r[0] == s)
        times = sorted(r[2] for r in found if r[0] == s)
        best = (0, 0.0)
        for k in range(1, min(len(mid), len(times)) + 1):
            for a in itertools.combinations(mid, k):
                for b in itertools.combinations(times, k):
                    if all(abs(x - y) <= 2.0 for x, y in zip(a, b)):
                        best = min(best, (-k, sum(abs(x - y) for x, y in zip(a, b))))
        own = [r for r in rows if r.session_id == s]
        assert len(own) == -best[0]
        assert sum(r.absolute_error_s for r in own) == pytest.approx(best[1])
        assert len({r.truth_id for r in own}) == len({r.prediction_id for r in own}) == len(own)


ANCHOR = AnchorSettings()


def anchor(projections=(), before=None, after=None, length=100.0, last=None):
    return find_anchor((10.0, 50.0), list(projections), before, after, length, last, ANCHOR)


def test_anchor_on_the_boundary_frame_is_exact():
    assert anchor([(0.3, 0.01, 1.0, 2.0)])[:5] == (0.3, 1.0, 2.0, 0.0, "exact")


def test_two_equal_projections_give_no_anchor():
    assert anchor([(0.3, 0.01, 0, 0), (0.7, 0.01, 0, 0)])[4] == "missing"


def test_anchor_between_two_frames():
    side = [(0.998, 0.01, 0.0, 0.0)], [(0.002, 0.01, 2.0, 2.0)]
    found = anchor(before=(9.9, 49.8, side[0]), after=(10.1, 50.2, side[1]))
    assert found[4] == "interpolated"
    assert found[0] % 1.0 == pytest.approx(0.0, abs=1e-9) or found[0] == pytest.approx(1.0)
    assert found[1:3] == (pytest.approx(1.0), pytest.approx(1.0))
    assert 0 < found[3] <= 0.25 * ANCHOR.unavailable_uncertainty


def test_anchor_from_one_side_needs_the_stricter_gate():
    near = (9.95, 49.9, [(0.4, 0.0, 0.0, 0.0)])
    assert anchor(before=near)[4] == "nearest"
    assert anchor(before=(9.8, 49.9, near[2]))[4] == "missing"
    assert anchor(before=near, length=None)[4] == "missing"


def test_progress_stays_silent_before_the_first_anchor_and_at_the_limit():
    fuser = Fuser(FusionSettings())
    first = fuser.advance(0.0, 0.0, None, 0.0, "observed", 100.0, 0.5, 0.0, [])
    assert first[0] is None and first[4] == ["unanchored"]
    fuser.boundary(1.0, 10.0, 0.0, 100.0, "exact", 0.0)
    fused = fuser.advance(1.1, 15.0, 5.0, 0.0, "observed", 100.0, 0.08, 0.001, [])
    assert fused[3] == "fused" and fused[0] == pytest.approx(0.05 + 0.35 * 0.03)
    lost = fuser.advance(9.0, 20.0, 5.0, 0.0, "missing", 100.0, None, 0.0, ["visual_missing"])
    assert lost[0] is None and lost[4][-1] == "uncertainty_limit"


def test_lap_choice_is_limited(spark):
    laps = spark.createDataFrame([(0, n) for n in range(4)], "session_id int, lap_number int")
    pairs = joins.chosen_pairs(laps, ("session_id",), [0, 2, 3, 9]).collect()
    assert sorted((r.lap_a, r.lap_b) for r in pairs) == [(0, 2), (0, 3), (2, 3)]
    for bad in ([1], list(range(11))):
        with pytest.raises(ValueError):
            joins.chosen_pairs(laps, ("session_id",), bad)


def test_settings_are_checked():
    for bad in (dict(on=2, off=5), dict(persistence=0), dict(max_gap=float("nan")), dict(on=101)):
        with pytest.raises(ValueError):
            EventSettings(**bad)


def test_lost_frames_are_not_fresh(spark):
    from gapwise.operators.aggregates import segment_coverage

    frames = spark.createDataFrame([("a", 0, True), ("a", 3, True), ("b", 0, True)], "session_id string, frame long, fresh boolean")
    segments = spark.createDataFrame([("a", 0, 3), ("a", 2, 3), ("c", 5, 6)], "session_id string, frame_lo long, frame_hi long")
    rows = {r.session_id: (r.denominator_frames, r.observed_frames, r.status) for r in segment_coverage(frames, segments, ("session_id",)).collect()}
    assert rows == {"a": (4, 2, "fail"), "b": (0, 0, "not_evaluated"), "c": (2, 0, "fail")}


def test_equal_points_stay_apart_on_a_long_ring(spark):
    from pyspark.sql import functions as F

    from gapwise.operators.geometry import RING_BLOCK, nearest_vertex

    for size in (RING_BLOCK, RING_BLOCK + 1):
        turn = F.col("id") * (2 * 3.141592653589793 / size)
        ring = spark.range(size).select(F.lit(0).alias("track_id"), F.col("id").alias("idx"), F.cos(turn).alias("x"), F.sin(turn).alias("y"))
        points = spark.createDataFrame([(0, 1.0, 0.0), (0, 1.0, 0.0), (0, 0.0, 1.0)], "track_id int, x double, y double")
        assert [r.vertex for r in nearest_vertex(points, ring).orderBy("vertex").collect()] == [0, 0, round(size / 4)]


def test_nearest_vertex_of_long_rings(spark):
    """Three levels of boxes against every vertex, with ties, far points and points without a place."""
    import numpy as np
    from pyspark.sql import functions as F

    from gapwise.operators.geometry import nearest_vertex

    rng, sizes = np.random.default_rng(5), {1: 9_000, 2: 70, 3: 3}
    ring = spark.createDataFrame(list(sizes.items()), "track_id int, size int").withColumn("id", F.explode(F.expr("sequence(0L, size - 1L)")))
    turn = F.col("id") / F.col("size") * 6.283185307179586
    # Rounded places, so that many vertices are equally near.
    x, y = (F.round(g(turn) * (1 + F.sin(turn * 7) / 3), 3) for g in (F.cos, F.sin))
    ring = ring.select("track_id", F.col("id").alias("idx"), x.alias("x"), y.alias("y"))
    spots = [(t, i, *np.round(rng.normal(0, s, 2), 3).tolist()) for t in (*sizes, 4) for i, s in enumerate([0.1, 1, 1, 1, 9] * 12)]
    spots += [(1, 99, 0.0, 0.0), (1, 100, None, 0.0), (2, 101, float("nan"), 1.0)]
    points = spark.createDataFrame(spots, "track_id int, n int, x double, y double")
    found = {(r.track_id, r.n): r.vertex for r in nearest_vertex(points, ring).collect()}
    plain = {t: np.array([(r.x, r.y) for r in ring.where(F.col("track_id") == t).orderBy("idx").collect()]) for t in sizes}
    for t, n, x, y in spots:
        if t in sizes and n < 100:
            dx, dy = x - plain[t][:, 0], y - plain[t][:, 1]
            assert found.pop((t, n)) == (dx * dx + dy * dy).argmin()
    assert sorted(found) == [(1, 100), (2, 101)]


def test_closing_a_stream_of_labels(spark):
    """The end of the stream in one scan, against a plain loop over every key."""
    import random
    from collections import Counter

    from gapwise.operators.labels import close_labels
    from gapwise.ordered import plan_axis

    rng, rows, want = random.Random(3), [], {}
    for key in range(60):
        smoothed, raw, own = None, 1, []
        for frame in range(rng.choice([1, 4, 20, 45])):
            smoothed = rng.choice([smoothed, smoothed, raw])
            raw = raw + 1 if rng.random() < 0.08 else raw
            own.append((key, frame, None if rng.random() < 0.3 else raw + (rng.random() < 0.2), smoothed))
        tail = [r[2] for r in own if r[2] is not None][-15:]
        counts = Counter(tail)
        final = max(counts, key=lambda v: (counts[v], -tail.index(v))) if tail else None
        final = final if tail and counts[final] >= max(len(tail) * 0.3, 1) else None
        start = len(own) - 1
        while start and own[start - 1][3] == own[-1][3]:
            start -= 1
        moves = final is not None and own[-1][3] is not None and final == own[-1][3] + 1
        want |= {(key, r[1]): final if moves and r[1] >= start else r[3] for r in own}
        rows += own
    table = spark.createDataFrame(rows, "session_id int, frame long, raw long, smoothed_label long")
    for bound in (2_000_000, 9):
        spark.conf.set("spark.gapwise.maxGroupRows", str(bound))
        try:
            axis = plan_axis(table, ("session_id",), ("frame",), unique_step=True)
            found = {(r.session_id, r.frame): r.final_label for r in close_labels(table, axis, "raw").collect()}
        finally:
            spark.conf.unset("spark.gapwise.maxGroupRows")
        assert found == want
    assert any(want[r[0], r[1]] != r[3] for r in rows)


def test_non_finite_numbers_deep_inside(spark):
    from gapwise.sources.tables import non_finite_rows

    nan, inf = float("nan"), float("inf")
    schema = "k int, s struct<a:double,b:array<double>>, m map<string,double>, t string"
    rows = [(1, (1.0, [1.0]), {"x": 1.0}, "t"), (2, (nan, None), None, None), (3, (1.0, [1.0, inf]), {"x": 1.0}, ""), (4, None, {"x": -inf}, "")]
    found = {(r.k, r.key) for r in non_finite_rows(spark.createDataFrame(rows, schema), ("k",)).collect()}
    assert found == {(2, "s"), (3, "s"), (4, "m")}


def test_anchors_as_columns_equal_the_sequential_choice(spark):
    """The table form and the tracker's form of the anchor rule on random boundaries."""
    import random

    from gapwise.operators.fusion import recover_anchors

    rng = random.Random(11)

    def near(t, d):
        spots = [(rng.random(), rng.choice([0.0, 0.01, 0.04, 0.07]), rng.random(), rng.random()) for _ in range(rng.randrange(3))]
        return None if rng.random() < 0.3 else (t + rng.uniform(-0.2, 0.2), d + rng.uniform(-0.3, 0.3), spots)

    rows = []
    for i in range(300):
        here = [(rng.random(), rng.choice([0.01, 0.03, 0.09]), 1.0 * i, 2.0) for _ in range(rng.choice([0, 0, 1, 2]))]
        rows.append((0, i, 10.0, 50.0, rng.choice([100.0, None, 0.0, 80.0]), rng.choice([None, 0.25]), here, near(10.0, 50.0), near(10.0, 50.0)))
    spot = "array<struct<s:double,d:double,x:double,y:double>>"
    side = f"struct<time_s:double,distance_m:double,projections:{spot}>"
    schema = f"session_id int, frame int, time_s double, distance_m double, length double, last_raw_s double, projections {spot}, before {side}, after {side}"
    found = recover_anchors(spark.createDataFrame(rows, schema), ("session_id",), ANCHOR).collect()
    assert len({r.anchor_kind for r in found}) == 4
    for r in found:
        _, _, t, d, length, last, here, before, after = rows[r.frame]
        want = find_anchor((t, d), here, before, after, length, last, ANCHOR)
        assert r.anchor_kind == want[4]
        assert (r.raw_s, r.x, r.y, r.anchor_uncertainty) == tuple(None if v is None else pytest.approx(v) for v in want[:4])
