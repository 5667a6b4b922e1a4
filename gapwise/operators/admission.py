"""Causal admission of readings that change too fast; nothing is smoothed or held."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.channel import finite
from gapwise.ordered import Axis, Lag, Last, row_number, scan

RELATIVE_TOLERANCE = 1e-9


def close_to(a: Column, b: Column) -> Column:
    """Equality up to the usual relative tolerance."""
    return F.abs(a - b) <= RELATIVE_TOLERANCE * F.greatest(F.abs(a), F.abs(b))


def admit_rate(
    df: DataFrame,
    axis: Axis,
    *,
    max_rate: float,
    max_gap: float,
    value: str = "value",
    quality: str = "quality",
    reasons: str = "reasons",
    context: str | None = None,
) -> DataFrame:
    """Reject readings whose change exceeds ``max_rate`` per unit of time.

    A rejected reading cannot judge its successor, so inside a streak of consecutive
    violations every odd one is rejected and every even one is admitted.
    """
    if not all(math.isfinite(x) and x > 0 for x in (max_rate, max_gap)):
        raise ValueError("admission limits must be finite and positive")
    v, t = F.col(value).cast("double"), F.col("time_s").cast("double")
    observed = F.coalesce((F.col(quality) == "observed") & v.isNotNull(), F.lit(False))
    bad_value = observed & ~(finite(v) & (v >= 0))
    bad_time = observed & ~bad_value & ~(finite(t) & (t >= 0))
    scene = F.col(context) if context else F.lit(0)
    rows = df.withColumns(
        {"_ok": observed & ~bad_value & ~bad_time, "_bv": bad_value, "_bt": bad_time}
    )
    rows = scan(
        rows,
        axis,
        _p=Lag(
            F.struct(
                v.alias("v"), t.alias("t"), F.col("_ok").alias("ok"), scene.alias("scene")
            )
        ),
    )
    dt = t - F.col("_p.t")
    change = F.abs(v - F.col("_p.v"))
    allowed = F.lit(float(max_rate)) * dt
    linked = F.col("_ok") & F.coalesce(F.col("_p.ok"), F.lit(False))
    linked = linked & scene.eqNullSafe(F.col("_p.scene"))
    backward = F.coalesce(linked & (dt <= 0), F.lit(False))
    fast = linked & (dt > 0) & (dt <= max_gap) & (change > allowed) & ~close_to(change, allowed)
    fast = F.coalesce(fast, F.lit(False))
    rows = rows.withColumns({"_bw": backward, "_fast": fast})
    rows = scan(rows, axis, _rn=row_number())
    calm = ~(F.col("_bw") | F.col("_fast"))
    rows = scan(rows, axis, _calm=Last(F.when(calm, F.col("_rn"))))
    odd = (F.col("_rn") - F.coalesce(F.col("_calm"), F.lit(0))) % 2 == 1
    reason = (
        F.when(F.col("_bv"), "speed_value_invalid")
        .when(F.col("_bt") | (F.col("_bw") & odd), "speed_timebase_invalid")
        .when(F.col("_fast") & odd, "speed_rate_exceeded")
    )
    rows = rows.withColumn("_why", reason)
    rejected = F.col("_why").isNotNull()
    out = {
        value: F.when(~rejected, F.col(value)),
        quality: F.when(rejected, F.lit("anomalous")).otherwise(F.col(quality)),
    }
    if reasons in df.columns:
        kept = F.coalesce(F.col(reasons), F.array().cast("array<string>"))
        out[reasons] = F.concat(kept, F.array_compact(F.array(F.col("_why"))))
    rows = rows.withColumn("admission_reason", F.col("_why")).withColumns(out)
    return rows.select(*df.columns, "admission_reason")
