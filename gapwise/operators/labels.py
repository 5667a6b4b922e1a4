"""Confirmed labels (laps) from noisy readings of a counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.ordered import Axis, Lag, Last, Sum, Tail, fold, row_number, scan


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def label_transitions(df: DataFrame, axis: Axis, label: str) -> DataFrame:
    """Rows whose non-null label differs from the previous non-null one."""
    rows = scan(df.filter(F.col(label).isNotNull()), axis, _p=Lag(F.col(label)))
    return rows.filter(F.col(label) != F.col("_p")).select(
        *axis.keys,
        "frame",
        "time_s",
        F.col("_p").alias("from_label"),
        F.col(label).alias("to_label"),
        (F.col(label) == F.col("_p") + 1).alias("is_increment"),
    )


def accept_successors(marks: DataFrame, axis: Axis, label: str) -> DataFrame:
    """Keep the first mark of a key, then only marks one above the last kept one."""
    schema = T.StructType(list(marks.schema.fields))

    def step(state, rows):
        current, kept = state, []
        for row in rows:
            value = getattr(row, label)
            if current is None or value == current + 1:
                current = int(value)
                kept.append(tuple(row[: len(schema)]))
        return current, kept

    return fold(marks, axis, step, schema)


def _readings(df: DataFrame, axis: Axis, label: str) -> DataFrame:
    """Rows with ``_count``: the length so far of the streak of equal non-null labels."""
    rows = scan(df, axis, _prev=Lag(F.col(label)), _rn=row_number())
    opens = F.col(label).isNotNull() & ~_yes(F.col(label) == F.col("_prev"))
    rows = scan(
        rows,
        axis,
        _open=Last(F.when(opens, F.struct(F.col("_rn").alias("rn"), F.col("time_s").alias("t")))),
    )
    count = F.when(F.col(label).isNotNull(), F.col("_rn") - F.col("_open.rn") + 1)
    return rows.withColumn("_count", count)


def _confirmations(rows: DataFrame, axis: Axis, label: str, n: int) -> DataFrame:
    marks = rows.filter(F.col("_count") == n).select(
        *axis.keys, "frame", F.col(label).cast("long").alias("label")
    )
    return accept_successors(marks, axis, "label")


def confirm_labels(df: DataFrame, axis: Axis, label: str, n: int) -> DataFrame:
    """State of the confirmed label at every row, after ``n`` equal readings in a row.

    The first confirmation may be any value; later ones must be one above.  Boundary
    rows carry the fields of a confirmed boundary.
    """
    if n <= 0:
        raise ValueError("the number of consecutive readings must be positive")
    readings = _readings(df, axis, label)
    accepted = _confirmations(readings, axis, label, n)
    marks = accepted.select(
        *axis.keys, "frame", F.lit(0).alias("_side"), F.col("label").alias("_mark")
    )
    rows = readings.withColumn("_side", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    along = axis.then("_side")
    both = scan(
        both,
        along,
        _now=Last(F.col("_mark")),
        _marked=Lag(F.col("_mark")),
    )
    both = both.filter(F.col("_side") == 1)
    # A mark directly in front of the row means that this row confirms it.
    both = scan(both, axis, _before=Lag(F.col("_now")))
    raw, now, before = F.col(label), F.col("_now"), F.col("_before")
    both = scan(both, axis, _seen_s=Last(F.when(raw == now, F.col("time_s")), here=False))
    confirms = F.col("_marked").isNotNull()
    boundary = confirms & before.isNotNull()
    pending = F.least(F.lit(1.0), F.col("_count") / F.lit(float(n)))
    confidence = (
        F.when(raw.isNull(), 0.0)
        .when(before.isNull(), pending)
        .when(raw == before, 1.0)
        .when(raw == before + 1, pending)
        .otherwise(0.0)
    )
    reason = (
        F.when(raw.isNull(), "lap_observation_missing")
        .when(boundary, "lap_boundary_confirmed")
        .when(confirms, "lap_initial_confirmed")
        .when(before.isNull(), "lap_confirmation_pending")
        .when(raw == before, F.lit(None))
        .when(raw == before + 1, "lap_confirmation_pending")
        .otherwise("lap_observation_rejected")
    )
    quality = F.when(now.isNull(), "missing").when(raw == now, "observed").otherwise("held")
    names = [c for c in df.columns if c not in axis.keys]
    return both.select(
        *axis.keys,
        *names,
        now.alias("confirmed_label"),
        quality.alias("label_quality"),
        confidence.alias("confidence"),
        F.array_compact(F.array(reason)).alias("label_reasons"),
        boundary.alias("is_boundary"),
        F.when(boundary, before).alias("from_label"),
        F.when(boundary, F.col("_open.t")).alias("first_candidate_time_s"),
        F.when(boundary, F.col("_seen_s")).alias("last_previous_observed_time_s"),
    )


def boundaries(states: DataFrame, axis: Axis) -> DataFrame:
    """The boundary rows of ``confirm_labels`` as a table."""
    return states.filter("is_boundary").select(
        *axis.keys,
        "frame",
        "time_s",
        F.col("from_label").alias("from_lap"),
        F.col("confirmed_label").alias("to_lap"),
        "confidence",
        "first_candidate_time_s",
        F.col("time_s").alias("confirmed_at_s"),
        F.col("last_previous_observed_time_s").alias("last_previous_lap_observed_time_s"),
    )


def majority(readings: Column, share: float, least: int) -> Column:
    """Most frequent value of an array, the first seen on ties, or null below the quorum."""
    counts = F.transform(
        F.array_distinct(readings),
        lambda v: F.struct(
            F.size(F.filter(readings, lambda x: x == v)).alias("n"),
            (-F.array_position(readings, v)).alias("place"),
            v.alias("value"),
        ),
    )
    best = F.array_max(counts)
    quorum = F.greatest(F.size(readings) * F.lit(share), F.lit(float(least)))
    return F.when(best["n"] >= quorum, best["value"])


def rolling_majority(
    df: DataFrame,
    axis: Axis,
    label: str,
    *,
    size: int = 15,
    share: float = 0.7,
    least: int = 3,
    successors_only: bool = True,
) -> DataFrame:
    """Majority label of the newest ``size`` valid readings, held where there is none.

    With ``successors_only`` (the lap form) the label may only stay or grow by one.
    """
    valid = scan(
        df.filter(F.col(label).isNotNull()), axis, _tail=Tail(F.col(label).cast("long"), size)
    )
    votes = valid.withColumn("vote", majority(F.col("_tail"), share, least))
    marks = votes.filter(F.col("vote").isNotNull()).select(*axis.keys, "frame", "vote")
    marks = scan(marks, axis, _p=Lag(F.col("vote")))
    marks = marks.filter(~_yes(F.col("_p") == F.col("vote"))).drop("_p")
    if successors_only:
        marks = accept_successors(marks, axis, "vote")
    both = df.withColumn("_side", F.lit(1)).unionByName(
        marks.select(*axis.keys, "frame", F.lit(0).alias("_side"), "vote"),
        allowMissingColumns=True,
    )
    both = scan(both, axis.then("_side"), smoothed_label=Last(F.col("vote")))
    return both.filter(F.col("_side") == 1).drop("_side", "vote")


def close_labels(
    smoothed: DataFrame, axis: Axis, label: str, *, size: int = 15, share: float = 0.3
) -> DataFrame:
    """End of the stream: a weaker majority may move the trailing rows one label up.

    One scan and one aggregate: trailing rows start at the last change of the smoothed label, and
    the newest ``size`` readings are the newest of every remainder of their number by ``size``.
    """
    keys, reading = list(axis.keys), F.col(label).cast("long")
    valid = reading.isNotNull()
    rows = scan(
        smoothed, axis, _before=Lag(F.col("smoothed_label")), _n=Sum(valid.cast("long"))
    )
    changed = ~F.col("smoothed_label").eqNullSafe(F.col("_before"))
    numbered = F.struct(F.col("_n").alias("n"), reading.alias("value"))
    newest = [F.max(F.when(valid & (F.col("_n") % size == i), numbered)) for i in range(size)]
    ends = rows.groupBy(*keys).agg(
        F.array_sort(F.array_compact(F.array(*newest))).alias("_tail"),
        F.max_by("smoothed_label", "frame").alias("_last"),
        F.max(F.when(changed, F.col("frame"))).alias("_since"),
    )
    tail = F.transform("_tail", lambda r: r["value"])
    ends = ends.withColumn("_final", majority(tail, share, 1)).drop("_tail")
    rows = rows.join(ends, keys, "left")
    trailing = F.col("_since").isNull() | (F.col("frame") >= F.col("_since"))
    moves = _yes(F.col("_final") == F.col("_last") + 1) & trailing
    return rows.withColumns(
        {
            "final_label": F.when(moves, F.col("_final")).otherwise(F.col("smoothed_label")),
            "relabelled": moves,
        }
    ).drop("_final", "_last", "_since", "_before", "_n")
