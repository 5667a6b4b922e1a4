"""Joins of samples with observations, reviewed truth, zones, windows and laps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.channel import Channel
from gapwise.ordered import Axis, Last, Lead, Next, asof, overlap_join, scan


def align_frames(samples: DataFrame, observations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Violations of a one-to-one match of frames with equal times."""
    by = [*keys, "frame"]
    s = samples.select(*by, F.col("time_s").alias("_st"), F.lit(True).alias("_s"))
    o = observations.select(*by, F.col("time_s").alias("_ot"), F.lit(True).alias("_o"))
    both = s.join(o, by, "full_outer")
    rule = (
        F.when(F.col("_s").isNull(), "missing_sample")
        .when(F.col("_o").isNull(), "missing_observation")
        .when(~F.col("_st").eqNullSafe(F.col("_ot")), "time_mismatch")
    )
    return both.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(*by, "rule")


def fresh_in_both(sample: Channel, observation_quality: Column) -> Column:
    """The sample's value if sample and observation both call it observed."""
    both = F.coalesce(observation_quality == "observed", F.lit(False))
    observed = F.coalesce(sample.flag() == "observed", F.lit(False))
    return F.when(both & observed, sample.v())


def join_truth_points(
    truth: DataFrame, samples: DataFrame, keys: tuple[str, ...], channel: Channel,
    observation_quality: str | None = None,
) -> DataFrame:
    """Reviewed points with a prediction only where the reading was fresh."""
    by = [*keys, "frame"]
    other = F.col(observation_quality) if observation_quality else F.lit("observed")
    value = fresh_in_both(channel, other)
    readings = samples.select(*by, value.cast("double").alias("prediction"))
    return truth.join(readings, by, "left")


def assign_zone(events: DataFrame, zones: DataFrame, axis: Axis) -> DataFrame:
    """Events with ``zone_id`` of the half-open zone that holds their frame.

    Zones partition a lap (see ``check_partition``), so the newest zone start decides.
    """
    rows = asof(events, zones, axis, "frame", "start_frame", "_z")
    inside = F.col("frame") < F.col("_z.end_frame")
    return rows.withColumn("zone_id", F.when(inside, F.col("_z.id"))).drop("_z")


def unique_event_in_window(
    passages: DataFrame, segments: DataFrame, events: DataFrame, keys: tuple[str, ...],
    frame_time: float,
) -> DataFrame:
    """The only event of the wanted type in the segments around a passage, with offsets.

    ``passages`` has ``id, wanted_type, frame_lo, frame_hi``.  Passages meet segments
    and segments meet events by interval joins; an event in two segments counts once.
    """
    span = ("frame_lo", "frame_hi")
    around = overlap_join(passages, segments, keys, span, span).filter(
        (F.col("r.frame_lo") <= F.col("l.frame_lo")) & (F.col("l.frame_hi") <= F.col("r.frame_hi"))
    )
    around = around.select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        F.col("l.id").alias("id"),
        F.col("l.wanted_type").alias("wanted_type"),
        F.col("r.frame_lo").alias("frame_lo"),
        F.col("r.frame_hi").alias("frame_hi"),
    )
    inside = overlap_join(around, events, keys, span, ("frame", "frame"))
    inside = inside.filter(F.col("l.wanted_type") == F.col("r.type"))
    inside = inside.select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        F.col("l.id").alias("id"),
        F.col("r.frame").alias("frame"),
    )
    # Lowest and highest frame tell "exactly one" without collecting the events.
    found = inside.groupBy(*keys, "id").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    rows = passages.join(found, [*keys, "id"], "left")
    only = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    rows = rows.withColumn("event_frame", only)
    hit = F.col("event_frame").isNotNull()
    return rows.withColumns(
        {
            "offset_lo_s": (F.col("event_frame") - F.col("frame_hi")) * frame_time,
            "offset_hi_s": (F.col("event_frame") - F.col("frame_lo")) * frame_time,
            "status": F.when(hit, "unique_candidate_in_existing_window").otherwise(
                "absent_or_ambiguous"
            ),
        }
    ).drop("_a", "_b")


def replace_readings(
    samples: DataFrame, readings: DataFrame, keys: tuple[str, ...], *,
    low: float = 0.0, high: float = 100.0,
) -> tuple[DataFrame, DataFrame]:
    """Replace previously observed values by re-read ones.

    ``samples`` has ``frame, value, quality, obs_value, obs_quality``; ``readings`` has
    ``frame, new_value, new_quality``.  Returns the refreshed table and violations.
    """
    by = [*keys, "frame"]
    rows = samples.join(readings.select(*by, "new_value", "new_quality"), by, "left")
    was = (F.col("quality") == "observed") & (F.col("obs_quality") == "observed")
    was = F.coalesce(was, F.lit(False))
    agrees = F.coalesce(F.col("value") == F.col("obs_value"), F.lit(False))
    new = F.col("new_value")
    good = (F.col("new_quality") == "observed") & new.between(low, high) & ~F.isnan(new)
    good = F.coalesce(good, F.lit(False))
    rows = rows.withColumns(
        {
            "_rule": F.when(was & ~agrees, "prior_disagreement").when(
                was & ~good, "lost_fresh_evidence"
            ),
            "_new": F.when(was & agrees & good, new),
        }
    )
    violations = rows.filter(F.col("_rule").isNotNull()).select(
        *keys, F.col("_rule").alias("rule"), F.col("frame").cast("string").alias("key")
    )
    refreshed = rows.withColumns(
        {
            "value": F.coalesce(F.col("_new"), F.col("value")),
            "obs_value": F.coalesce(F.col("_new"), F.col("obs_value")),
            "replaced": F.col("_new").isNotNull(),
        }
    ).select(*samples.columns, "replaced")
    return refreshed, violations


def broadcast_lap_time(rows: DataFrame, lap_times: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The time of a completed lap on every row of that lap.

    The lap table is one row per lap; Spark broadcasts it when it is small and splits a
    skewed lap otherwise.
    """
    return rows.join(lap_times, [*keys, "lap_number"], "left")


def nearest_gated(
    frames: DataFrame,
    axis: Axis,
    *,
    usable: str,
    boundary: str,
    length: str,
    max_gap: float,
    max_distance_fraction: float,
) -> DataFrame:
    """Boundary rows with the nearest usable frame on both sides, inside the gates.

    Another boundary in between stops the search, and so does a frame out of the gates;
    time and distance do not decrease, so testing the found frame is enough.
    """
    here = F.struct("frame", "time_s", "distance_m", F.col(boundary).alias("is_boundary"))
    stop = F.when(F.col(usable) | F.col(boundary), here)
    rows = scan(
        frames, axis, before=Last(stop, here=False), after=Next(stop, here=False)
    ).filter(F.col(boundary))

    def gated(side: str) -> Column:
        other = F.col(side)
        near = F.abs(other["time_s"] - F.col("time_s")) <= max_gap
        share = F.abs(other["distance_m"] - F.col("distance_m")) / F.col(length)
        fits = ~other["is_boundary"] & near & (share <= max_distance_fraction)
        return F.when(F.coalesce(fits, F.lit(False)), other)

    return rows.withColumns({"before": gated("before"), "after": gated("after")})


def time_deltas(grid: DataFrame, pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Time lost by lap a against lap b at every common position.

    ``grid`` has one row per (lap, position) with nullable ``time, lap_start_time_s`` and
    channels; ``pairs`` names the laps to compare.  Linear in grid rows times pairs.
    """
    channels = [c for c in ("throttle", "brake", "steering", "speed", "time") if c in grid.columns]
    kept = [*channels, "lap_start_time_s"]

    def side(name: str) -> DataFrame:
        return grid.select(
            *keys,
            F.col("lap_number").alias(f"lap_{name}"),
            "position",
            *[F.col(c).alias(f"{c}_{name}") for c in kept],
            *([F.col("time_run").alias(f"time_run_{name}")] if "time_run" in grid.columns else []),
        )

    both = pairs.join(side("a"), [*keys, "lap_a"]).join(side("b"), [*keys, "lap_b", "position"])
    masked = {}
    for c in channels:
        common = F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()
        masked[f"{c}_a"] = F.when(common, F.col(f"{c}_a"))
        masked[f"{c}_b"] = F.when(common, F.col(f"{c}_b"))
    both = both.withColumns(masked)
    own = F.col("time_a") - F.col("lap_start_time_s_a")
    return both.withColumn("delta_s", own - (F.col("time_b") - F.col("lap_start_time_s_b")))


def chosen_pairs(laps: DataFrame, keys: tuple[str, ...], chosen: list[int]) -> DataFrame:
    """Pairs (a before b) among two to ten chosen lap numbers of each session."""
    from gapwise.operators.selection import check_lap_choice

    ids = check_lap_choice(chosen)
    have = laps.filter(F.col("lap_number").isin(*ids)).select(*keys, "lap_number").distinct()
    # Each lap names its possible partners, at most nine, and keeps those that exist.
    later = F.filter(F.array(*[F.lit(i) for i in ids]), lambda i: i > F.col("lap_number"))
    asked = have.select(*keys, F.col("lap_number").alias("lap_a"), F.explode(later).alias("lap_b"))
    return asked.join(
        have.withColumnRenamed("lap_number", "lap_b"), [*keys, "lap_b"], "left_semi"
    ).select(*keys, "lap_a", "lap_b")


def adjacent_pairs(laps: DataFrame, axis: Axis) -> DataFrame:
    """Each lap with the next lap of its session."""
    one = laps.select(*axis.keys, "lap_number").distinct()
    along = Axis(axis.keys, ("lap_number",), axis.width)
    rows = scan(one, along, lap_b=Lead(F.col("lap_number")))
    return rows.filter(F.col("lap_b").isNotNull()).withColumnRenamed("lap_number", "lap_a")
