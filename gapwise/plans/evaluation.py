"""Measured sessions against reviewed annotations: one status per check and per session."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.operators import aggregates, scoring
from gapwise.ordered import Axis, materialize
from gapwise.plans import jobs

#: The type of lap boundaries beside the pedal types.
LAP = "lap_boundary"
#: Parts of a session's report; each has a status of its own.
PARTS = ("accuracy", "coverage", "continuous", "pedal", "laps", "timebase")


@dataclass(frozen=True)
class EvaluationSettings:
    """Limits of the checks; ``mae`` and ``p95`` by field."""

    mae: dict[str, float]
    p95: dict[str, float] = field(default_factory=dict)
    coverage: float = 0.95
    window: float = 0.5
    max_error: float = 0.1
    time_tolerance: float = 1e-6


def _status(bad: Column, open_: Column) -> Column:
    return F.when(open_, "not_evaluated").when(bad, "fail").otherwise("pass")


def _part_status(part: str) -> Column:
    """The rule of ``combine_status`` for the checks of one part."""
    own = F.col("part") == part
    failed, open_ = (F.count_if(own & (F.col("status") == s)) > 0 for s in ("fail", "not_evaluated"))
    return F.when(failed, "fail").when(open_ | (F.count_if(own) == 0), "not_evaluated").otherwise("pass")


def _by_field(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("field") == name, F.lit(float(value))).otherwise(out)
    return out


def field_checks(labels: DataFrame, samples: DataFrame, keys: tuple[str, ...], settings: EvaluationSettings) -> DataFrame:
    """Accuracy and point coverage per field.

    ``labels``: keys, ``frame, field, truth, visible``; ``samples``: keys, ``frame, field, value,
    fresh``.  A fresh reading where the review hides the field is a false observation, and one of
    them makes the field fail.
    """
    by = (*keys, "field")
    read = samples.filter("fresh").select(*by, "frame", F.col("value").alias("prediction"))
    both = labels.join(read, [*by, "frame"], "left")
    points = both.filter(F.col("visible") & F.col("truth").isNotNull())
    errors = aggregates.field_errors(points, by)
    false_ = both.groupBy(*by).agg(F.count_if(~F.col("visible") & F.col("prediction").isNotNull()).alias("false_count"))
    rows = false_.join(errors, list(by), "left").na.fill(0, ["denominator", "measured_count"])
    high = F.coalesce(F.col("p95") > _by_field(settings.p95), F.lit(False))
    wrong = (F.col("false_count") > 0) | high | (F.col("mae") > _by_field(settings.mae))
    accuracy = _status(F.coalesce(wrong, F.lit(False)), F.col("mae").isNull() & (F.col("false_count") == 0))
    covered = _status(F.col("coverage") < settings.coverage, F.col("denominator") == 0)
    return rows.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("part"), F.col("field").alias("name"), accuracy.alias("status"),
                         F.col("measured_count").alias("measured"), F.col("denominator").alias("expected"), F.col("false_count").alias("false")),
                F.struct(F.lit("coverage").alias("part"), F.col("field").alias("name"), covered.alias("status"),
                         F.col("measured_count").alias("measured"), F.col("denominator").alias("expected"), F.lit(0).cast("long").alias("false")),
            )
        ),
    )


def continuous_checks(
    samples: DataFrame, capture: DataFrame, spans: DataFrame, keys: tuple[str, ...], settings: EvaluationSettings
) -> DataFrame:
    """Share of fresh frames among those of the reviewed spans (keys, ``field, start_s, end_s``), per field."""
    by = (*keys, "field")
    fields = samples.select(*by).distinct()
    frames = fields.join(capture.select(*keys, "time_s"), list(keys))
    found = aggregates.segment_coverage(
        samples.select(*by, "time_s", "fresh"), spans, by, span=("start_s", "end_s"), on="time_s",
        minimum=settings.coverage, half_open=True, capture=frames,
    )
    return found.select(
        *keys, F.lit("continuous").alias("part"), F.col("field").alias("name"), "status",
        F.col("observed_frames").alias("measured"), F.col("denominator_frames").alias("expected"), F.lit(0).cast("long").alias("false"),
    )


def event_checks(
    passages: DataFrame, crossings: DataFrame, transitions: DataFrame, samples: DataFrame, capture: DataFrame,
    axis: Axis, settings: EvaluationSettings, complete_review: DataFrame,
) -> DataFrame:
    """Latency of every pedal type and of lap boundaries, matched in one pass: the type is one more key.

    ``passages``: keys, ``id, type, lo_s, hi_s``, eligible ones only; ``crossings``: keys, ``id, field,
    direction, time_s``; ``transitions``: keys, ``id, time_s`` of first candidates; ``complete_review``:
    the keys whose lap changes were all reviewed.
    """
    keys = axis.keys
    along = axis.within("type")
    kinds = F.create_map(*[F.lit(x) for name, (f, d) in scoring.PEDAL_TYPES.items() for x in (f"{f} {d}", name)])
    pedal = crossings.select(*keys, "id", "time_s", kinds[F.concat_ws(" ", "field", "direction")].alias("type"))
    truth = materialize(passages.select(*keys, "type", "id", "lo_s", "hi_s"))
    laps = transitions.select(*keys, "id", "time_s", F.lit(LAP).alias("type"))
    told = pedal.filter(F.col("type").isNotNull()).unionByName(laps)
    told = materialize(told.withColumn("confirmed_at_s", F.col("time_s")))  # few rows, from whole recordings
    # Sparse truth cannot call a crossing away from it false; a lap change may well be.
    nobody = truth.select(*along.keys, F.col("id").alias("truth_id"), F.col("id").alias("prediction_id")).limit(0)
    near = scoring.match_classes(truth, told, nobody, along, settings.window).filter("side = 'prediction' AND class = 'duplicate'")
    ours = told.filter(F.col("type") == LAP)
    scope = near.select(*along.keys, "id").unionByName(ours.select(*along.keys, "id")).distinct()
    inside = materialize(told.join(scope, [*along.keys, "id"], "left_semi"))
    matches = materialize(scoring.match_events(truth, inside, along, settings.window))
    metrics = scoring.match_metrics(scoring.match_classes(truth, inside, matches, along, settings.window), matches, along.keys)

    # Types of one field look at the same readings, so these are counted along the field.
    fields = F.create_map(*[F.lit(x) for name, (f, _) in scoring.PEDAL_TYPES.items() for x in (name, f)])
    pedals = truth.filter(F.col("type") != LAP).withColumn("field", fields[F.col("type")])
    pedals = pedals.withColumn("id", F.struct("type", "id"))
    by = (*keys, "field")
    wanted = pedals.select(*by).distinct()
    read = samples.select(*by, "time_s", "fresh").join(wanted, list(by), "left_semi")
    frames = wanted.join(capture.select(*keys, "time_s"), list(keys)).select(*by, "time_s")
    seen = jobs.observable_truth(pedals, read, by, settings.window, frames).select(*keys, "id.type")
    seen = seen.groupBy(*along.keys).agg(F.count(F.lit(1)).alias("observable_count"))

    rows = metrics.join(seen, list(along.keys), "left").na.fill(0, ["observable_count"])
    rows = rows.join(complete_review.select(*keys).distinct().withColumn("_complete", F.lit(True)), list(keys), "left")
    lap = F.col("type") == LAP
    status = F.when(lap, jobs.lap_event_status(settings.max_error, F.coalesce("_complete", F.lit(False)))).otherwise(jobs.latency_status(settings.max_error))
    return rows.select(
        *keys, F.when(lap, "laps").otherwise("pedal").alias("part"), F.col("type").alias("name"), status.alias("status"),
        F.col("matched_count").alias("measured"), F.col("truth_count").alias("expected"),
        F.when(lap, F.col("duplicate_count") + F.col("outside_count")).otherwise(0).alias("false"),
    )


def timebase_checks(samples: DataFrame, capture: DataFrame, keys: tuple[str, ...], settings: EvaluationSettings) -> DataFrame:
    """Whether every frame of the capture has its sample at its time, and no sample is beside them.

    ``samples`` and ``capture``: keys, ``frame, time_s``.
    """
    given = capture.select(*keys, "frame", "time_s", F.lit(1).alias("c"), F.lit(0).alias("s"))
    own = samples.select(*keys, "frame", "time_s").distinct().select("*", F.lit(0).alias("c"), F.lit(1).alias("s"))
    frames = given.unionByName(own).groupBy(*keys, "frame").agg(
        F.sum("c").alias("c"), F.sum("s").alias("s"), (F.max("time_s") - F.min("time_s")).alias("apart")
    )
    fits = (F.col("c") == 1) & (F.col("s") == 1) & (F.col("apart") <= settings.time_tolerance)
    return frames.groupBy(*keys).agg(
        F.lit("timebase").alias("part"), F.lit("alignment").alias("name"),
        F.when(F.bool_and(fits), "pass").otherwise("fail").alias("status"),
        F.count_if(fits).alias("measured"), F.sum("c").alias("expected"), F.count_if((F.col("c") == 0)).alias("false"),
    )


def evaluate_session(
    *, labels: DataFrame, samples: DataFrame, capture: DataFrame, spans: DataFrame, passages: DataFrame,
    crossings: DataFrame, transitions: DataFrame, landmarks: DataFrame, positions: DataFrame,
    complete_review: DataFrame, axis: Axis, settings: EvaluationSettings,
) -> dict[str, DataFrame]:
    """All checks of all sessions as one long table, and one row per session.

    ``samples``: keys, ``frame, time_s, field, value, fresh``; the other tables as the single checks
    say; ``landmarks`` and ``positions`` as ``landmark_positions`` takes them.  A session's part fails
    if one of its checks fails, passes if all pass, and is open otherwise.
    """
    keys = axis.keys
    parts = [
        field_checks(labels, samples, keys, settings),
        continuous_checks(samples, capture, spans, keys, settings),
        event_checks(passages, crossings, transitions, samples, capture, axis, settings, complete_review),
        timebase_checks(samples, capture, keys, settings),
    ]
    checks = parts[0]
    for part in parts[1:]:
        checks = checks.unionByName(part)
    checks = materialize(checks)  # a few rows per session, from whole recordings
    sessions = checks.groupBy(*keys).agg(
        *(_part_status(part).alias(f"{part}_status") for part in PARTS),
        aggregates.combine_status(F.col("status")).alias("status"),
        F.count_if(F.col("status") == "fail").alias("failed_checks"),
        F.count_if(F.col("status") == "not_evaluated").alias("open_checks"),
        F.coalesce(F.sum(F.when(F.col("part") == "accuracy", F.col("false"))), F.lit(0)).alias("false_observed_count"),
    )
    marks = jobs.landmark_positions(landmarks, positions, keys)
    spread = marks.groupBy(*keys).agg(
        F.count_if(F.col("status") == "available").alias("landmarks_available"), F.max("range_s").alias("landmark_range_s")
    )
    sessions = sessions.join(spread, list(keys), "left").na.fill(0, ["landmarks_available"])
    return {"checks": checks, "sessions": sessions, "landmarks": marks}
