"""Resampling of laps on a common position grid, on original runs only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.channel import finite
from gapwise.ordered import Axis, Lag, Sum, scan

CHANNELS = ("throttle", "brake", "steering", "speed", "time", "frame")
# One unit in the last place has no Spark function; a relative slack stands for it.
ULP = 1e-15
CONFIRMED_START = "lap_boundary_confirmed"


def _at_most(value: Column, limit: float) -> Column:
    return value <= limit * (1 + 4 * ULP)


def accepted_position(
    source: Column, hint: Column, uncertainty: Column, *, strict: bool, gate_passed: bool,
    max_uncertainty: float | None,
) -> Column:
    """May the position be used, by its source flag and the explicit hint on it."""
    plain = source.isin("observed") if strict else source.isin("observed", "legacy_unverified")
    if max_uncertainty is None or (strict and not gate_passed):
        derived = F.lit(False)
    else:
        derived = source.isin("fused", "predicted", "interpolated") & finite(uncertainty)
        derived = derived & (uncertainty < max_uncertainty)
    refused = F.coalesce(hint.isin("held", "missing", "anomalous"), F.lit(False))
    return F.coalesce(plain | derived, F.lit(False)) & ~refused


def resample_on_grid(df: DataFrame, axis: Axis, *, channels: dict[str, tuple[str, str | None]], **limits) -> DataFrame:
    """One row per (lap, grid position, channel) with value, quality and run number: ``resample_wide`` in long form."""
    wide = resample_wide(df, axis, channels=channels, **limits)
    parts = [
        F.struct(
            F.lit(n).alias("channel"), F.col(n).alias("value"), F.col(f"{n}_quality").alias("quality"), F.col(f"{n}_run").alias("run")
        )
        for n in channels
    ]
    lap = (*axis.keys, "lap_number")
    long = wide.select(*lap, "k", "position", "lap_start_time_s", F.inline(F.array(*parts)))
    return long.select(*lap, "channel", "k", "position", "value", "quality", "run", "lap_start_time_s")


def resample_wide(
    df: DataFrame,
    axis: Axis,
    *,
    step: float,
    max_position_gap: float,
    max_time_gap: float,
    channels: dict[str, tuple[str, str | None]],
    position_ok: Column | None = None,
    start_times: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per (lap, grid position) with value, ``_quality`` and ``_run`` of every channel.

    ``channels`` maps a name to its value column and its quality column (``None``: the
    channel needs no flag).  A position that repeats inside the lap counts nowhere;
    rows are never reordered and nothing is extrapolated.  A grid position claimed by
    two runs is ambiguous.
    """
    if not 0 < max_position_gap <= 1 or not math.isfinite(max_time_gap) or max_time_gap <= 0:
        raise ValueError("invalid alignment limits")
    if not math.isfinite(step) or not 0 < step <= 1:
        raise ValueError("invalid position step")
    lap = (*axis.keys, "lap_number")
    along = axis.within("lap_number")
    rows = df.filter(F.col("lap_number").isNotNull())
    # A position that occurs once is found by a partial count, so repeated ones (however
    # many rows share them) vanish before the shuffle.
    once = (
        rows.filter(F.col("s").isNotNull())
        .groupBy(*lap, "s")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("frame").alias("frame"))
        .filter("_n = 1")
        .select(*lap, "frame", F.lit(True).alias("_once"))
    )
    rows = rows.join(once, [*lap, "frame"], "left")
    fits = F.coalesce(F.col("_once"), F.lit(False)) & F.col("s").between(0, 1)
    fits = fits & finite(F.col("time_s"))
    if position_ok is not None:
        fits = fits & position_ok
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    good, values, quality = {}, {}, {}
    for name, (value, flag) in channels.items():
        mark = F.lit("observed") if flag is None else F.coalesce(F.col(flag), F.lit("missing"))
        usable = mark == "observed"
        if not strict:
            usable = usable | (mark == "legacy_unverified")
        good[f"_g_{name}"] = F.col("_fits") & finite(F.col(value)) & usable
        values[name] = F.col(value).cast("double")
        quality[name] = mark
    rows = rows.withColumns(good)
    before = F.struct(
        F.col("s").alias("s"),
        F.col("time_s").alias("t"),
        *[F.col(g).alias(g) for g in good],
        *[values[n].alias(f"v_{n}") for n in channels],
    )
    rows = scan(rows, along, _p=Lag(before))
    ds, dt = F.col("s") - F.col("_p.s"), F.col("time_s") - F.col("_p.t")
    linked = (ds > 0) & _at_most(ds, max_position_gap) & (dt > 0) & _at_most(dt, max_time_gap)
    rows = rows.withColumn("_linked", F.coalesce(linked, F.lit(False)))
    joined = {
        f"_j_{n}": F.col(f"_g_{n}") & F.col("_linked") & F.coalesce(F.col(f"_p._g_{n}"), F.lit(False))
        for n in channels
    }
    rows = rows.withColumns(joined)
    starts = {
        f"_run_{n}": Sum((F.col(f"_g_{n}") & ~F.col(f"_j_{n}")).cast("long")) for n in channels
    }
    rows = scan(rows, along, **starts)
    # Grid numbers reachable from this row: its own position, and what lies after the
    # previous row of the run.
    reach = F.when(F.col("_linked"), F.col("_p.s")).otherwise(F.col("s"))
    low = F.greatest(F.floor(reach / step) - 1, F.lit(0)).cast("long")
    high = (F.ceil(F.col("s") / step) + 1).cast("long")
    last = int(math.floor(1 / step + 1e-9))
    t = F.col("k") * step
    hits = rows.filter(F.col("_fits")).select(
        "*", F.explode(F.sequence(low, F.least(high, F.lit(last)))).alias("k")
    )
    near = (t == F.col("s")) | ((t > F.col("_p.s")) & (t < F.col("s")))
    hits = hits.filter(F.coalesce(near, F.lit(False)))
    exact = t == F.col("s")
    share = (t - F.col("_p.s")) / (F.col("s") - F.col("_p.s"))
    claims = []
    for n in channels:
        claim = F.col(f"_g_{n}") & (exact | F.col(f"_j_{n}"))
        between = F.col(f"_p.v_{n}") + share * (values[n] - F.col(f"_p.v_{n}"))
        claims += [
            F.count_if(claim).alias(f"_n_{n}"),
            F.max(F.when(claim, F.when(exact, values[n]).otherwise(between))).alias(f"_v_{n}"),
            F.max(F.when(claim, F.when(exact, quality[n]).otherwise("interpolated"))).alias(f"_q_{n}"),
            F.max(F.when(claim, F.col(f"_run_{n}") - 1)).alias(f"_r_{n}"),
        ]
    claimed = hits.groupBy(*lap, "k").agg(*claims)
    grid = rows.select(*lap).distinct().select(
        *lap, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("k")
    )
    out = grid.join(claimed, [*lap, "k"], "left")
    columns = []
    for n in channels:
        single = F.col(f"_n_{n}") == 1
        columns += [
            F.when(single, F.col(f"_v_{n}")).alias(n),
            F.when(single, F.col(f"_q_{n}")).when(F.col(f"_n_{n}") > 1, "ambiguous").otherwise("missing").alias(f"{n}_quality"),
            F.when(single, F.col(f"_r_{n}")).otherwise(F.lit(-1)).alias(f"{n}_run"),
        ]
    out = out.select(*lap, "k", (t * 100).alias("position"), *columns)
    if start_times is None:
        return out.withColumn("lap_start_time_s", F.lit(None).cast("double"))
    return out.join(start_times, list(lap), "left")


def confirmed_starts(df: DataFrame, keys: tuple[str, ...], reasons: str) -> DataFrame:
    """Lap start from the only row that confirms the boundary; two such rows give none."""
    hits = df.filter(F.array_contains(reasons, CONFIRMED_START))
    found = hits.groupBy(*keys, "lap_number").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_s").alias("t")
    )
    return found.select(
        *keys, "lap_number", F.when(F.col("n") == 1, F.col("t")).alias("lap_start_time_s")
    )


def grid_wide(long: DataFrame, keys: tuple[str, ...], channels: list[str]) -> DataFrame:
    """Channel columns side by side, one row per lap and position."""
    by = (*keys, "lap_number", "k", "position", "lap_start_time_s")
    picks = []
    for n in channels:
        here = F.col("channel") == n
        picks.append(F.max(F.when(here, F.col("value"))).alias(n))
        picks.append(F.max(F.when(here, F.col("quality"))).alias(f"{n}_quality"))
        picks.append(F.max(F.when(here, F.col("run"))).alias(f"{n}_run"))
    return long.groupBy(*by).agg(*picks)
