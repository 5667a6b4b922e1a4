"""Gap-bounded filling, distance integration and robust length calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.ordered import (
    Axis, Lag, Last, Lead, Next, Sum, asof, materialize, medians, row_number, scan,
)


def fill_bounded(df: DataFrame, axis: Axis, value: str, max_gap: float) -> DataFrame:
    """Linear filling of interior holes whose bracket is short and runs forward in time.

    Adds ``filled_value`` and ``was_filled``; ``value`` is left as it was.
    """
    rows = scan(df, axis, _pt=Lag(F.col("time_s")))
    rows = rows.withColumn("_back", (F.coalesce(F.col("time_s") <= F.col("_pt"), F.lit(False))))
    rows = scan(rows, axis, _bad=Sum(F.col("_back").cast("long")))
    v = F.col(value).cast("double")
    known = F.struct(v.alias("v"), F.col("time_s").alias("t"), F.col("_bad").alias("bad"))
    known = F.when(v.isNotNull(), known)
    rows = scan(rows, axis, _l=Last(known), _r=Next(known))
    width = F.col("_r.t") - F.col("_l.t")
    fits = (width > 0) & (width <= max_gap) & (F.col("_l.bad") == F.col("_r.bad"))
    share = (F.col("time_s") - F.col("_l.t")) / F.when(width > 0, width)
    between = F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v"))
    fills = F.coalesce(v.isNull() & fits, F.lit(False))
    rows = rows.withColumns(
        {
            "was_filled": fills,
            "filled_value": F.when(fills, between).otherwise(v),
        }
    )
    return rows.select(*df.columns, "filled_value", "was_filled")


#: Steps are added as whole numbers of 1 / UNIT, so that a sum does not depend on how it is split.
UNIT = 2.0**60


def _whole(value: Column) -> Column:
    return (value * F.lit(UNIT)).cast("decimal(38,0)")


def integrate(
    df: DataFrame,
    axis: Axis,
    *,
    speed: str,
    quality: str,
    max_gap: float,
    observed_rate: float = 0.00005,
    interpolated_rate: float = 0.001,
    metres_per_unit: float = 1 / 3.6,
) -> DataFrame:
    """Trapezoidal distance with the source and the reasons of every step.

    ``metres_per_unit`` turns speed times one unit of ``time_s`` into metres.
    """
    s = F.col(speed).cast("double")
    observed = F.coalesce((F.col(quality) == "observed") & (s >= 0), F.lit(False))
    odd = F.coalesce(F.col(quality) == "anomalous", F.lit(False)) | F.coalesce(
        s < 0, F.lit(False)
    )
    rows = df.withColumns({"_s": F.when(observed, s), "_odd": odd})
    rows = fill_bounded(rows, axis, "_s", max_gap)
    rows = scan(
        rows,
        axis,
        _p=Lag(
            F.struct(
                F.col("time_s").alias("t"),
                F.col("filled_value").alias("v"),
                F.col("was_filled").alias("f"),
                F.col("_odd").alias("odd"),
            )
        ),
    )
    first = F.col("_p").isNull()
    dt = F.col("time_s") - F.col("_p.t")
    v, pv = F.col("filled_value"), F.col("_p.v")
    backward = F.coalesce(dt <= 0, F.lit(False))
    gap = ~first & ~backward & (v.isNull() | pv.isNull())
    filled = F.col("was_filled") | F.coalesce(F.col("_p.f"), F.lit(False))
    moves = ~first & ~backward & v.isNotNull() & pv.isNotNull()
    delta = F.when(moves, (pv + v) / 2.0 * metres_per_unit * dt)
    rate = F.when(gap | (moves & filled), F.lit(interpolated_rate)).when(
        moves, F.lit(observed_rate)
    )
    anomalous = F.col("_odd") | (~first & F.coalesce(F.col("_p.odd"), F.lit(False)))
    lost = F.when(anomalous, "speed_anomalous").otherwise("speed_missing")
    source = (
        F.when(first, F.when(v.isNull(), "missing").otherwise("observed"))
        .when(backward | gap, "missing")
        .when(filled, "interpolated")
        .otherwise("observed")
    )
    reason = (
        F.when(first, F.when(v.isNull(), lost))
        .when(backward, "non_monotonic_time")
        .when(gap, lost)
        .when(filled, "speed_gap_interpolated")
    )
    rows = rows.withColumns(
        {
            "delta_distance_m": delta,
            "_unc": F.coalesce(rate * dt, F.lit(0.0)),
            "odometry_source": source,
            "odometry_reasons": F.array_compact(F.array(reason)),
        }
    )
    rows = scan(
        rows,
        axis,
        _d=Sum(_whole(F.coalesce(F.col("delta_distance_m"), F.lit(0.0)))),
        _u=Sum(_whole(F.col("_unc"))),
    )
    return rows.select(
        *df.columns,
        "delta_distance_m",
        (F.col("_d").cast("double") / UNIT).alias("distance_m"),
        F.least(F.lit(1.0), F.col("_u").cast("double") / UNIT).alias("odometry_uncertainty"),
        "odometry_source",
        "odometry_reasons",
    )


def segment_fraction(df: DataFrame, axis: Axis, boundary: str, length: str) -> DataFrame:
    """Distance since the last boundary over the length, clamped to [0, 1]."""
    rows = scan(df, axis, _d0=Last(F.when(F.col(boundary), F.col("distance_m"))))
    share = (F.col("distance_m") - F.col("_d0")) / F.when(F.col(length) > 0, F.col(length))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return rows.withColumn("fraction", F.when(share.isNotNull(), clamped)).drop("_d0")


def lap_distances(odometry: DataFrame, bounds: DataFrame, axis: Axis) -> DataFrame:
    """Distance and share of missing steps between consecutive boundaries.

    ``bounds`` has the key columns, ``frame``, ``time_s`` and ``to_lap``.  Running
    counts taken at both ends replace a range join over the points between them.
    """
    missing = (F.col("odometry_source") == "missing").cast("long")
    points = scan(odometry, axis, _n=row_number(), _m=Sum(missing))
    points = points.select(*axis.keys, "frame", "time_s", "distance_m", "_n", "_m")
    ends = bounds.select(*axis.keys, F.col("frame").alias("b_frame"), "time_s", "to_lap")
    placed = asof(ends, points, axis, "time_s", "time_s", "p", tie="frame")
    along = Axis(axis.keys, ("b_frame",), axis.width)
    nxt = F.struct(F.col("time_s"), F.col("p"))
    laps = scan(placed, along, e=Lead(nxt)).filter(F.col("e").isNotNull())
    zero = F.lit(0).cast("long")
    n0, m0 = F.coalesce(F.col("p._n"), zero), F.coalesce(F.col("p._m"), zero)
    n1, m1 = F.coalesce(F.col("e.p._n"), zero), F.coalesce(F.col("e.p._m"), zero)
    complete = F.col("p").isNotNull() & F.col("e.p").isNotNull()
    return laps.select(
        *axis.keys,
        F.col("to_lap").alias("lap_number"),
        F.col("time_s").alias("start_time_s"),
        F.col("e.time_s").alias("end_time_s"),
        F.when(complete, F.col("e.p.distance_m") - F.col("p.distance_m"))
        .otherwise(0.0)
        .alias("distance_m"),
        F.when(n1 > n0, (m1 - m0) / (n1 - n0)).otherwise(1.0).alias("missing_fraction"),
        complete.alias("complete"),
        F.when(complete, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("missing_boundary")))
        .alias("reasons"),
    )


def judge_laps(
    laps: DataFrame, keys: tuple[str, ...], *, max_missing: float, max_deviation: float
) -> DataFrame:
    """All laps with ``accepted`` and the ordered reasons of a rejection."""
    # One row per lap, used several times below; its lineage holds whole sessions.
    laps = materialize(laps)
    duration = F.col("end_time_s") - F.col("start_time_s")
    usable = F.col("complete") & (F.col("distance_m") > 0)
    usable = usable & (F.col("missing_fraction") <= max_missing)
    rows = laps.withColumns({"_dur": duration, "_eligible": (duration > 0) & usable})
    eligible = rows.filter("_eligible")
    counts = eligible.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    centre = counts.join(medians(eligible, keys, {"_dm": "distance_m", "_tm": "_dur"}), list(keys))
    rows = rows.join(centre, list(keys), "left")
    judged = F.col("_eligible") & (F.coalesce(F.col("_n"), F.lit(0)) >= 3)
    far = judged & (F.abs(F.col("distance_m") - F.col("_dm")) / F.col("_dm") > max_deviation)
    slow = judged & (F.abs(F.col("_dur") - F.col("_tm")) / F.col("_tm") > max_deviation)
    extra = (
        F.when(F.col("_dur") <= 0, "non_positive_duration")
        .when(far, "distance_outlier")
        .when(slow, "duration_outlier")
    )
    accepted = F.coalesce(F.col("_eligible") & ~far & ~slow, F.lit(False))
    told = F.array_distinct(
        F.concat(
            F.col("reasons"),
            F.array_compact(F.array(extra)),
            F.array(F.lit("calibration_lap_rejected")),
        )
    )
    return rows.withColumns(
        {"accepted": accepted, "reasons": F.when(accepted, F.col("reasons")).otherwise(told)}
    ).select(*laps.columns, "accepted")


def calibrate_length(
    judged: DataFrame, keys: tuple[str, ...], *, max_deviation: float
) -> DataFrame:
    """Median distance of the accepted laps with its relative median deviation."""
    judged = materialize(judged)
    good = judged.filter("accepted")
    mid = medians(good, keys, {"effective_length_m": "distance_m"})
    spread = good.join(mid, list(keys)).withColumn(
        "_dev", F.abs(F.col("distance_m") - F.col("effective_length_m"))
    )
    mad = medians(spread, keys, {"_mad": "_dev"})
    counts = judged.groupBy(*keys).agg(
        F.count_if("accepted").alias("accepted_laps"),
        F.count_if(~F.col("accepted")).alias("rejected_laps"),
    )
    rows = counts.join(mid, list(keys), "left").join(mad, list(keys), "left")
    relative = F.col("_mad") / F.col("effective_length_m")
    uncertainty = F.when(F.col("accepted_laps") == 1, F.lit(float(max_deviation))).otherwise(
        F.col("relative_mad")
    )
    return (
        rows.withColumn("relative_mad", relative)
        .withColumn("uncertainty", F.least(F.lit(1.0), F.coalesce(uncertainty, F.lit(1.0))))
        .drop("_mad")
    )
