"""Filters and selections of rows, laps, frames and sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.ordered import Axis, Last, Lead, Least, asof, row_number, scan

INDEX_SLACK = 1e-9
SEQUENCE_BLOCK = 65536
LAP_CHOICE = (2, 10)


def select_rows(
    df: DataFrame,
    laps: list[int] | None = None,
    start_frame: int | None = None,
    end_frame: int | None = None,
) -> DataFrame:
    """Rows of the given laps and of the inclusive frame range; both reach the scan."""
    if laps is not None:
        df = df.filter(F.col("lap_number").isin(*laps))
    if start_frame is not None:
        df = df.filter(F.col("frame") >= start_frame)
    if end_frame is not None:
        df = df.filter(F.col("frame") <= end_frame)
    return df


def check_lap_choice(laps: list) -> list:
    low, high = LAP_CHOICE
    if not low <= len(set(laps)) <= high:
        raise ValueError(f"choose {low} to {high} laps")
    return sorted(set(laps))


def select_laps(df: DataFrame, chosen: list[tuple], lap_table: DataFrame) -> DataFrame:
    """Rows of two to ten (session, lap) pairs with the lap's own time."""
    ids = check_lap_choice(chosen)
    wanted = F.broadcast(
        df.sparkSession.createDataFrame(ids, "session_id bigint, lap_number int")
    )
    by = ["session_id", "lap_number"]
    times = lap_table.join(wanted, by, "left_semi")
    found = times.select(*by).distinct().count()
    if found < LAP_CHOICE[0]:
        raise ValueError("fewer than two of the chosen laps exist")
    return df.join(wanted, by, "left_semi").join(times, by, "left")


def bounded_laps(boundaries: DataFrame, axis: Axis) -> DataFrame:
    """Laps with exactly one start and a next boundary one lap and some frames later."""
    nxt = F.struct(F.col("frame"), F.col("time_s"), F.col("to_lap"))
    rows = scan(boundaries, axis, _n=Lead(nxt))
    starts = boundaries.groupBy(*axis.keys, "to_lap").agg(F.count(F.lit(1)).alias("_starts"))
    rows = rows.join(starts, [*axis.keys, "to_lap"])
    good = (F.col("_n.to_lap") == F.col("to_lap") + 1) & (F.col("_n.frame") > F.col("frame"))
    return rows.filter((F.col("_starts") == 1) & good).select(
        *axis.keys,
        F.col("to_lap").alias("lap_number"),
        F.col("frame").alias("start_frame"),
        F.col("_n.frame").alias("end_frame"),
        F.col("time_s").alias("start_time_s"),
        F.col("_n.time_s").alias("end_time_s"),
    )


def frames_in_window(
    laps: DataFrame, start_s: float, end_s: float, fps: float
) -> DataFrame:
    """Frame range [first, end) of a time window measured from each lap's start."""
    if not all(math.isfinite(x) for x in (start_s, end_s, fps)) or fps <= 0:
        raise ValueError("invalid window")
    base = F.col("start_time_s")
    first = F.ceil((base + start_s) * fps - INDEX_SLACK)
    end = F.ceil((base + end_s) * fps - INDEX_SLACK)
    inside = (F.col("start_frame") <= first) & (first < end) & (end <= F.col("end_frame"))
    return laps.withColumns(
        {"first_frame": first, "end_frame_exclusive": end, "valid_window": inside}
    )


def frame_sequence(
    windows: DataFrame, start: str, end: str, step_s: float, fps: float
) -> DataFrame:
    """One row per frame from start to end at a fixed stride."""
    if fps <= 0 or step_s < 1 / fps:
        raise ValueError("the step must be at least one frame")
    stride = max(1, round(step_s * fps))
    first = F.ceil(F.col(start) * fps - INDEX_SLACK).cast("long")
    last = F.floor(F.col(end) * fps + INDEX_SLACK).cast("long")
    # Two steps keep every array short, however long a window is.
    far = F.lit(stride * SEQUENCE_BLOCK).cast("long")
    blocks = F.when(first <= last, F.sequence(first, last, far))
    rows = windows.withColumns({"_last": last, "_block": blocks}).withColumn(
        "_block", F.explode("_block")
    )
    stop = F.least(F.col("_last"), F.col("_block") + far - stride)
    frames = F.sequence(F.col("_block"), stop, F.lit(stride).cast("long"))
    return rows.withColumn("frame", F.explode(frames)).drop("_last", "_block")


def evenly_spaced(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """Rows at the truncated indexes of ``n`` evenly spaced places, first and last included."""
    if n <= 0:
        return df.limit(0)
    rows = scan(df, axis, _rn=row_number())
    counts = df.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, list(axis.keys))
    k = F.least(F.lit(n).cast("long"), F.col("_n"))
    step = (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1))
    index = F.col("_rn") - 1
    # The last place is pinned to the last index, the others are cut towards zero.
    near = F.floor(index / F.when(step > 0, step)).cast("long")
    hit = (index == 0) | ((index == F.col("_n") - 1) & (k > 1))
    for shift in (0, 1):
        place = near + shift
        hit = hit | F.coalesce((place < k - 1) & (F.floor(place * step) == index), F.lit(False))
    return rows.filter(hit).select(*df.columns)


def every_step(df: DataFrame, axis: Axis, step: float) -> DataFrame:
    """The first row at or after each due time; the due time moves by one step per pick.

    After i rows the number of picks is the running minimum of (dues passed at row j)
    plus the rows since j, so no sequential pass is needed.
    """
    rows = scan(df, axis, _rn=row_number())
    passed = F.floor(F.col("time_s") / step) + 1
    rows = scan(rows, axis, _low=Least(passed - F.col("_rn")))
    rows = rows.withColumn("_picks", F.col("_rn") + F.least(F.lit(0), F.col("_low")))
    before = F.coalesce(F.col("_before"), F.lit(0))
    rows = scan(rows, axis, _before=Last(F.col("_picks"), here=False))
    return rows.filter(F.col("_picks") > before).select(*df.columns)


def list_sessions(df: DataFrame) -> DataFrame:
    """One row per session, newest first."""
    return (
        df.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.count_distinct("lap_number").alias("laps"),
            F.max("time_s").alias("last_time_s"),
        )
        .orderBy(F.desc("last_time_s"), "session_id")
    )


def list_laps(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("lap_number").isNotNull())
        .groupBy("session_id", "lap_number")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.min("frame").alias("start_frame"),
            F.max("frame").alias("end_frame"),
        )
        .orderBy("session_id", "lap_number")
    )


# Reasons of readings outside a reviewed visible span.
UNVERIFIED = "hud_visibility_unverified"
STATE_REASONS = {"absent": "speed_hud_absent", "unknown": "speed_hud_unverified"}


def gate_visibility(
    obs: DataFrame,
    spans: DataFrame,
    axis: Axis,
    *,
    allow_unreviewed: bool = False,
    use_state: bool = False,
) -> DataFrame:
    """Withhold readings outside a reviewed [start, end) span.

    Spans of one field must not overlap (see ``check_intervals``), so the newest span
    that has begun decides.  With ``use_state`` an absent or unknown span withholds too.
    """
    along = Axis((*axis.keys, "field"), axis.order, axis.width)
    rows = asof(obs, spans, along, "time_s", "start_s", "_span")
    inside = F.coalesce(F.col("time_s") < F.col("_span.end_s"), F.lit(False))
    if use_state:
        state = F.when(inside, F.col("_span.state")).otherwise("unknown")
        covered = state == "visible"
        reason = F.when(state == "absent", STATE_REASONS["absent"]).otherwise(
            STATE_REASONS["unknown"]
        )
        admits = covered | (F.lit(allow_unreviewed) & (state == "unknown"))
    else:
        covered = inside
        reason = F.lit(UNVERIFIED)
        admits = covered | F.lit(allow_unreviewed)
    told = F.when(~covered, F.array(reason)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "value": F.when(admits, F.col("value")),
            "quality": F.when(admits, F.col("quality")).otherwise("missing"),
            "reasons": F.when(
                admits, F.concat(F.coalesce("reasons", F.array().cast("array<string>")), told)
            ).otherwise(told),
        }
    ).drop("_span")
