"""Integrity checks.  Each returns violations ``(keys, rule, key)``; none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.channel import finite
from gapwise.ordered import Axis, Lag, Last, Lead, asof, row_number, scan
from gapwise.schema import SPAN_STATES

CLOCK_TOLERANCE = 1e-8
PTS_ROUNDING = 1e-6
VISIBILITY_FIELDS = ("speed", "gear", "lap_number", "throttle", "brake", "steering")
PASSAGE_KINDS = ("landmark", "lap_boundary", "pedal_event")
ROLES = ("development", "holdout")


def assert_none(violations: DataFrame) -> None:
    """Raise when there is a violation, showing a few of them."""
    shown = violations.limit(5).collect()
    if shown:
        raise ValueError(f"violations found, for example {shown}")


def _no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def _report(df: DataFrame, keys: tuple[str, ...], key: Column, rules: dict[str, Column]):
    """One violation row per rule that a row breaks."""
    items = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("bad"))
            for n, c in rules.items()
        ]
    )
    broken = F.filter(items, lambda i: i["bad"])
    rows = df.select(*keys, key.cast("string").alias("key"), F.explode(broken).alias("_b"))
    return rows.select(*keys, F.col("_b.rule").alias("rule"), "key")


def check_intervals(
    spans: DataFrame, keys: tuple[str, ...], durations: DataFrame | None = None,
    chunk: float | None = None,
) -> DataFrame:
    """Spans are finite, ordered, inside the recording, reviewed and free of overlap per field."""
    axis = Axis((*keys, "field"), ("start_s", "end_s"), chunk)
    rows = scan(spans, axis, _pe=Lag(F.col("end_s")))
    if durations is not None:
        rows = rows.join(durations, list(keys), "left")
        late = F.col("end_s") > F.col("duration_s")
    else:
        late = F.lit(False)
    sane = finite(F.col("start_s")) & finite(F.col("end_s"))
    rules = {
        "not_finite": ~sane,
        "not_ordered": sane & ~((F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s"))),
        "after_end": late,
        "overlap": F.col("start_s") < F.col("_pe"),
        "blank_reviewer": _no(F.trim("reviewer") != ""),
    }
    if "state" in spans.columns:
        rules["unknown_state"] = _no(F.col("state").isin(*SPAN_STATES))
    return _report(rows, keys, F.concat_ws("@", "field", F.col("start_s")), rules)


def check_windows(
    windows: DataFrame, axis: Axis, frame_count: DataFrame
) -> DataFrame:
    """Frame windows lie in the recording, in order and apart from each other."""
    along = Axis(axis.keys, ("frame_lo", "frame_hi"), axis.width)
    rows = scan(windows, along, _ph=Lag(F.col("frame_hi")))
    rows = rows.join(frame_count, list(axis.keys), "left")
    inside = (F.col("frame_lo") >= 0) & (F.col("frame_lo") <= F.col("frame_hi"))
    rules = {
        "outside_recording": _no(inside & (F.col("frame_hi") < F.col("frame_count"))),
        "overlap": F.col("frame_lo") <= F.col("_ph"),
    }
    return _report(rows, axis.keys, F.col("frame_lo"), rules)


def check_partition(zones: DataFrame, axis: Axis, bounds: DataFrame) -> DataFrame:
    """Zones have clean unique ids and cover [start_frame, end_frame) of ``bounds`` exactly."""
    keys = axis.keys
    along = Axis(keys, ("start_frame", "end_frame"), axis.width)
    rows = scan(
        zones, along, _pe=Lag(F.col("end_frame")), _n=Lead(F.lit(True))
    )
    repeated = zones.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_uses"))
    rows = rows.join(repeated, [*keys, "id"], "left").join(bounds, list(keys), "left")
    rules = {
        "invalid_id": _no(F.col("id").rlike("^[A-Za-z0-9_-]+$")),
        "repeated_id": F.col("_uses") > 1,
        "blank_label": _no(F.trim("label") != ""),
        "empty_zone": _no(F.col("start_frame") < F.col("end_frame")),
        "hole_or_overlap": F.col("_pe").isNotNull() & (F.col("_pe") != F.col("start_frame")),
        "wrong_start": F.col("_pe").isNull() & (F.col("start_frame") != F.col("lo")),
        "wrong_end": F.col("_n").isNull() & (F.col("end_frame") != F.col("hi")),
    }
    return _report(rows, keys, F.col("id"), rules)


def check_clock(df: DataFrame, axis: Axis, frame_time: float) -> DataFrame:
    """Frames and times increase together, one frame per frame time."""
    rows = scan(
        df, axis, _p=Lag(F.struct(F.col("frame").alias("f"), F.col("time_s").alias("t")))
    )
    frames, seconds = F.col("frame") - F.col("_p.f"), F.col("time_s") - F.col("_p.t")
    due = frames * frame_time
    apart = F.abs(seconds - due) > F.greatest(
        F.lit(CLOCK_TOLERANCE), 1e-9 * F.greatest(F.abs(seconds), F.abs(due))
    )
    rules = {
        "invalid_frame": _no(F.col("frame") >= 0),
        "invalid_time": ~finite(F.col("time_s")),
        "frame_not_increasing": frames <= 0,
        "time_not_increasing": seconds <= 0,
        "cadence": apart,
    }
    return _report(rows, axis.keys, F.col("frame"), rules)


def check_lap_clock(df: DataFrame, laps: DataFrame, axis: Axis, frame_time: float) -> DataFrame:
    """Every frame of a bounded lap exists, at the lap's start time plus its offset.

    The lap that has begun last is found along the frames; lap rows carry
    ``start_frame, end_frame, start_time_s``.
    """
    rows = asof(df, laps, axis, "frame", "start_frame", "lap")
    rows = rows.filter(F.col("frame") < F.col("lap.end_frame"))
    offset = (F.col("frame") - F.col("lap.start_frame")) * frame_time
    off = F.abs(F.col("time_s") - F.col("lap.start_time_s") - offset) > CLOCK_TOLERANCE
    rows = rows.select(*axis.keys, F.col("lap.lap_number").alias("lap_number"), off.alias("off"))
    seen = rows.groupBy(*axis.keys, "lap_number").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("off").alias("off")
    )
    out = laps.join(seen, [*axis.keys, "lap_number"], "left")
    rules = {
        "incomplete": F.coalesce("n", F.lit(0)) != F.col("end_frame") - F.col("start_frame"),
        "misaligned": F.col("off") > 0,
    }
    return _report(out, axis.keys, F.col("lap_number"), rules)


def audit_timebase(
    df: DataFrame, axis: Axis, pts: str, *, rate: float, tick: float, flags: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per stream: is every time stamp on the constant rate within one tick.

    Discarded packets (a flag with ``D``) do not count.  The strict form also bounds each
    step and the drift.
    """
    if flags is not None:
        df = df.filter(~F.coalesce(F.col(flags).contains("D"), F.lit(False)))
    at = F.col(pts)
    rows = scan(df, axis, _rn=row_number(), _p=Lag(at))
    rows = scan(rows, axis, _first=Last(F.when(F.col("_p").isNull(), at)))
    residual = F.abs((at - F.col("_first")) - (F.col("_rn") - 1) / rate)
    step = at - F.col("_p")
    out = rows.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.bool_and(F.coalesce(step > 0, F.lit(True))).alias("monotonic"),
        F.max(residual).alias("max_residual"),
        F.max(F.abs(step - 1.0 / rate)).alias("max_step_error"),
        F.min("_first").alias("first_pts"),
        F.max(at).alias("last_pts"),
    )
    good = (F.col("frame_count") >= 2) & F.col("monotonic")
    if strict:
        good = good & (F.col("max_step_error") <= tick + PTS_ROUNDING)
        good = good & (F.col("max_residual") <= 1.0 / rate)
    else:
        good = good & (F.col("max_residual") <= tick)
    return out.withColumn("status", F.when(good, "pass").otherwise("fail"))


def _entries(column: str) -> Column:
    # Maps cannot be compared; their sorted entries can.
    return F.sort_array(F.map_entries(F.col(column)))


def _against_manifest(lines: DataFrame, keys: tuple[str, ...], manifest: DataFrame) -> tuple[DataFrame, dict]:
    """Lines beside their manifest, and the rules that every kind of line has to keep."""
    m = manifest.select(
        *keys,
        *[F.col(c).alias(f"_m_{c}") for c in ("schema_version", "source_id", "source_sha256",
                                              "profile", "start_s")],
    )
    rows = lines.join(m, list(keys), "left")
    foreign = F.lit(False)
    for c in ("schema_version", "source_id", "source_sha256", "profile"):
        foreign = foreign | _differs(F.col(c), F.col(f"_m_{c}"))
    expected = F.col("_m_start_s") + F.col("time_s")
    return rows, {"foreign_envelope": foreign, "source_time": _differs(F.col("source_time_s"), expected)}


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def check_envelope(lines: DataFrame, keys: tuple[str, ...], manifest: DataFrame) -> DataFrame:
    """Envelope and inner sample agree with each other and with the manifest."""
    rows, rules = _against_manifest(lines, keys, manifest)
    inner = {
        "frame": _differs(F.col("frame"), F.col("sample.frame")),
        "time": _differs(F.col("time_s"), F.col("sample.time_s")),
        "quality": _differs(_entries("field_quality"), _entries("sample.field_quality")),
        "reasons": _differs(_entries("field_reasons"), _entries("sample.field_reasons")),
    }
    return _report(rows, keys, F.col("frame"), rules | inner)


def check_observation_envelope(lines: DataFrame, keys: tuple[str, ...], manifest: DataFrame) -> DataFrame:
    """Flags and reasons of an observation line are those of its observations."""
    rows, rules = _against_manifest(lines, keys, manifest)

    def inner(name: str) -> Column:
        return F.array_sort(F.map_entries(F.transform_values("observations", lambda _, o: o[name])))

    own = {
        "observation_quality": _differs(_entries("field_quality"), inner("quality")),
        "observation_reasons": _differs(_entries("field_reasons"), inner("reasons")),
    }
    return _report(rows, keys, F.col("frame"), rules | own)


def check_row_counts(samples: DataFrame, observations: DataFrame, manifest: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """As many samples as observations as the manifest says, each at the frame and time of the other.

    Partial counts per frame and side, so neither side meets the other row by row.
    """
    sides = [t.select(*keys, "frame", "time_s", F.lit(n).alias("_side")) for n, t in enumerate((samples, observations))]
    both = sides[0].unionByName(sides[1])
    frames = both.groupBy(*keys, "frame", "time_s").agg(
        F.count_if(F.col("_side") == 0).alias("s"), F.count_if(F.col("_side") == 1).alias("o")
    )
    alone = _report(frames, keys, F.col("frame"), {"misaligned_rows": F.col("s") != F.col("o")})
    counts = frames.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("o").alias("o"))
    rows = manifest.select(*keys, "frame_count").join(counts, list(keys), "left").na.fill(0, ["s", "o"])
    wrong = (F.col("s") != F.col("o")) | _differs(F.col("s"), F.col("frame_count"))
    return alone.unionByName(_report(rows, keys, F.lit("rows"), {"row_count": wrong}))


def check_hashes(files: DataFrame, manifest: DataFrame, key: str, payload: str) -> DataFrame:
    """Payloads whose SHA-256 differs from the recorded one, and missing ones."""
    actual = files.select(key, F.sha2(F.col(payload).cast("binary"), 256).alias("_actual"))
    both = manifest.join(actual, key, "full_outer")
    rule = (
        F.when(F.col("_actual").isNull(), "missing_payload")
        .when(F.col("sha256").isNull(), "not_recorded")
        .when(F.col("_actual") != F.col("sha256"), "integrity_mismatch")
    )
    rows = both.withColumn("rule", rule).filter(F.col("rule").isNotNull())
    return rows.select(F.col(key).cast("string").alias("key"), "rule")


def check_annotation_frames(frames: DataFrame, capture: DataFrame, keys: tuple[str, ...]):
    """Rules on reviewed frames: identity, time, visibility, literal text and pedals.

    ``capture``: keys, ``frame, capture_time_s``; ``frames`` follow ``ANNOTATIONS``.
    """
    by = [*keys, "frame"]
    uses = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("_uses"))
    rows = frames.join(uses, by, "left").join(capture, by, "left")
    vis = F.col("visibility")
    names = F.array(*[F.lit(f) for f in VISIBILITY_FIELDS])
    full = (F.size(F.array_except(names, F.map_keys(vis))) == 0) & (
        F.size(F.map_keys(vis)) == len(VISIBILITY_FIELDS)
    )
    rules = {
        "unreviewed": _no(F.col("reviewed")),
        "repeated_frame": F.col("_uses") > 1,
        "time_mismatch": _no(F.abs(F.col("time_s") - F.col("capture_time_s")) <= 1e-6),
        "degradation_unreviewed": F.col("degraded").isNull(),
        "visibility_incomplete": _no(full) | F.exists(F.map_values(vis), lambda v: v.isNull()),
    }
    fields = {"speed_text": "speed", "gear_text": "gear", "lap_text": "lap_number"}
    for column, field in fields.items():
        text, given = F.trim(column), F.col(column).isNotNull()
        rules[f"{column}_unreadable"] = given & ((text == "") | _no(vis[field]))
        if column == "gear_text":
            rules["gear_text_domain"] = given & ~text.rlike("^([1-6]|N|R)$")
        else:
            rules[f"{column}_literal"] = given & ~text.rlike("^[0-9]+$")
    for field in ("brake", "throttle"):
        value = F.col(f"{field}_pct")
        given = value.isNotNull()
        rules[f"{field}_range"] = given & _no(value.between(0, 100))
        rules[f"{field}_not_visible"] = given & _no(vis[field])
        rules[f"{field}_tolerance"] = given & _no(F.col("pedal_tolerance_pct").between(0, 100))
    return _report(rows, keys, F.col("frame"), rules)


def check_passages(passages: DataFrame, keys: tuple[str, ...], frame_count: DataFrame):
    uses = passages.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_uses"))
    rows = passages.join(uses, [*keys, "id"], "left").join(frame_count, list(keys), "left")
    inside = (F.col("frame_lo") >= 0) & (F.col("frame_lo") <= F.col("frame_hi"))
    pedal = F.col("kind") == "pedal_event"
    rules = {
        "outside_recording": _no(inside & (F.col("frame_hi") < F.col("frame_count"))),
        "unreviewed": _no(F.col("reviewed")),
        "blank_id": _no(F.trim("id") != ""),
        "repeated_id": F.col("_uses") > 1,
        "unknown_kind": _no(F.col("kind").isin(*PASSAGE_KINDS)),
        "pedal_without_field": pedal & _no(F.col("field").isin("throttle", "brake")),
    }
    return _report(rows, keys, F.col("id"), rules)


def check_span_occlusion(spans: DataFrame, frames: DataFrame, axis: Axis) -> DataFrame:
    """Reviewed frames that call a field hidden inside a span that calls it visible."""
    along = Axis((*axis.keys, "field"), axis.order, axis.width)
    seen = frames.select(*axis.keys, "frame", "time_s", F.explode("visibility").alias("field", "ok"))
    rows = asof(seen.filter(~F.col("ok")), spans, along, "time_s", "start_s", "_span")
    hit = F.col("time_s") < F.col("_span.end_s")
    return rows.filter(hit).select(
        *axis.keys, F.lit("span_contradicts_occlusion").alias("rule"),
        F.col("frame").cast("string").alias("key"),
    )


def review_counts(frames: DataFrame, passages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Readable frames per field, degraded frames, event windows and eligible passages."""
    vis = F.col("visibility")
    readable = frames.groupBy(*keys).agg(
        F.count_if(vis["speed"] & F.col("speed_text").isNotNull()).alias("readable_speed"),
        F.count("brake_pct").alias("readable_brake"),
        F.count("throttle_pct").alias("readable_throttle"),
        F.count_if("degraded").alias("degraded_frames"),
    )
    window = F.coalesce("event_window_id", "id")
    pedal = F.col("kind") == "pedal_event"
    physical = F.coalesce("physical_landmark_reviewed", F.lit(True))
    events = passages.groupBy(*keys).agg(
        F.count_distinct(F.when(pedal, window)).alias("event_windows"),
        F.count_if(F.col("kind").isin("landmark", "lap_boundary") & physical).alias("passages"),
    )
    out = readable.join(events, list(keys), "full_outer")
    return out.na.fill(0)


def consolidate_reviews(approvals: DataFrame, keys: tuple[str, ...], content: list[str]):
    """One row per source and frame from repeated approvals, and the conflicts.

    ``approvals``: keys, ``frame, approval_source`` and the reviewed ``content`` columns.
    Equal repetitions merge their sources; unequal ones conflict.  Equality is taken from
    the smallest and largest content, so nothing is collected per frame but the sources.
    """
    body = F.struct(*content)
    merged = approvals.groupBy(*keys, "frame").agg(
        F.min(body).alias("_a"),
        F.max(body).alias("_b"),
        F.array_sort(F.collect_set("approval_source")).alias("approval_sources"),
    )
    same = F.col("_a").eqNullSafe(F.col("_b"))
    rows = merged.filter(same).select(*keys, "frame", "_a.*", "approval_sources")
    conflicts = merged.filter(~same).select(
        *keys, F.lit("conflicting_readings").alias("rule"), F.col("frame").cast("string").alias("key")
    )
    return rows, conflicts


def check_lineage(approvals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sources whose role or recording differs between approvals, or with an unknown role."""
    item = F.struct(F.coalesce("role", F.lit("")), F.coalesce("recording_id", F.lit("")))
    per = approvals.groupBy(*keys).agg(
        (F.min(item) != F.max(item)).alias("_mixed"),
        F.bool_or(_no(F.col("role").isin(*ROLES))).alias("_odd"),
    )
    rules = {"conflicting_lineage": F.col("_mixed"), "invalid_role": F.col("_odd")}
    return _report(per, keys, F.lit("source"), rules)


def latest_events(events: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Events keyed by id, of which the later one replaces the earlier."""
    rest = [c for c in events.columns if c not in (*keys, "id", order)]
    rows = events.groupBy(*keys, "id").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return rows.select(*keys, "id", "_r.*")


def check_case(
    passages: DataFrame, reviewed: DataFrame, samples: DataFrame, keys: tuple[str, ...],
    speed_reviews: DataFrame | None = None, axis: Axis | None = None,
) -> DataFrame:
    """Rules on a review case of two or three passages.

    ``passages``: keys, ``id, window_lo, window_hi, entry_lo, entry_hi, exit_lo, exit_hi,
    max_review_gap_s`` (nullable landmarks); ``reviewed``: keys, ``id, frame`` in long
    form; ``samples``: keys, ``frame, time_s``.
    """
    axis = axis or Axis(tuple(keys), ("frame",))
    by = [*keys, "id"]
    counts = passages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")
    )
    out = _report(
        counts, keys, F.lit("case"),
        {"passage_count": ~F.col("n").between(2, 3), "repeated_passage": F.col("n") > F.col("ids")},
    )
    marks = ("window_lo", "window_hi", "entry_lo", "entry_hi", "exit_lo", "exit_hi")
    held = reviewed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_frames"), F.count_distinct("frame").alias("_distinct")
    )
    rows = passages.join(held, by, "left")
    for m in marks[2:]:
        hit = reviewed.select(*by, F.col("frame").alias(m)).distinct().withColumn(f"_{m}", F.lit(True))
        rows = rows.join(hit, [*by, m], "left")
    entry, leave = F.col("entry_lo").isNotNull(), F.col("exit_lo").isNotNull()
    lo = F.col("window_lo")
    ordered_entry = (lo <= F.col("entry_lo")) & (F.col("entry_lo") <= F.col("entry_hi"))
    ordered_entry = ordered_entry & (F.col("entry_hi") <= F.col("window_hi"))
    from_where = F.coalesce(F.col("entry_hi"), lo)
    ordered_exit = (from_where <= F.col("exit_lo")) & (F.col("exit_lo") <= F.col("exit_hi"))
    ordered_exit = ordered_exit & (F.col("exit_hi") <= F.col("window_hi"))
    gap = F.col("max_review_gap_s")
    out = out.unionByName(
        _report(
            rows, keys, F.col("id"),
            {
                "invalid_window": _no(lo < F.col("window_hi")),
                "no_reviewed_frames": F.col("_frames").isNull(),
                "repeated_reviewed_frame": F.col("_frames") > F.col("_distinct"),
                "entry_unreviewed": entry & (F.col("_entry_lo").isNull() | F.col("_entry_hi").isNull()),
                "exit_unreviewed": leave & (F.col("_exit_lo").isNull() | F.col("_exit_hi").isNull()),
                "entry_order": entry & _no(ordered_entry),
                "exit_order": leave & _no(ordered_exit),
                "invalid_gap": entry & leave & _no(finite(gap) & (gap > 0)),
            },
        )
    )
    timed = reviewed.join(samples.select(*keys, "frame", "time_s"), [*keys, "frame"], "left")
    timed = timed.join(
        passages.select(*by, "window_lo", "window_hi", "entry_lo", "exit_hi", "max_review_gap_s"), by
    )
    within = F.col("frame").between(F.col("entry_lo"), F.col("exit_hi"))
    inner = scan(timed.filter(within), axis.within("id"), _pt=Lag(F.col("time_s")))
    out = out.unionByName(
        _report(
            inner, keys, F.col("id"),
            {"review_spacing": F.col("time_s") - F.col("_pt") > F.col("max_review_gap_s") + 1e-9},
        ).distinct()
    )
    outside = F.col("time_s").isNull() | ~F.col("frame").between(
        F.col("window_lo"), F.col("window_hi")
    )
    out = out.unionByName(_report(timed, keys, F.col("frame"), {"frame_outside": outside}))
    if speed_reviews is not None:
        seen = reviewed.select(*keys, "frame").distinct()
        lost = speed_reviews.join(seen, [*keys, "frame"], "left_anti")
        out = out.unionByName(
            _report(lost, keys, F.col("frame"), {"speed_review_outside": F.lit(True)})
        )
        value = F.col("hud_kmh")
        out = out.unionByName(
            _report(
                speed_reviews, keys, F.col("frame"),
                {"invalid_speed_review": value.isNotNull() & ~(finite(value) & (value >= 0))},
            )
        )
    return out
