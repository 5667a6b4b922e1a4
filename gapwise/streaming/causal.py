"""Causal operators as Structured Streaming jobs.

Sessions are dealt to buckets; a bucket keeps one state row with the state of each of its
sessions.  Inside a micro-batch the rows of a bucket are sorted by session and order; a row that comes later than its successor is refused as evidence by the same
rule as in batch.  Every job gives the rows of its batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from gapwise.operators.fusion import FUSED, FUSE_INPUT, FusionSettings, fuse_step
from gapwise.operators.runs import TIME_SLACK, EventSettings
from gapwise.ordered import Step


def observation_stream(
    spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet",
    files: int | None = None,
) -> DataFrame:
    """Observation files as a stream, oldest file first, ``files`` of them per trigger."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(form).load(path)


#: Sessions are dealt to this many buckets, each one call per micro-batch; fixed for a stream's life.
BUCKETS = 2048


def causal(stream: DataFrame, keys: list[str], step: Step, schema: T.StructType, order: list[str]):
    """Run ``step(state, rows)`` per session; a bucket's states are JSON and travel with its rows."""
    names = schema.names

    def advance(key, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        # Rows of one bucket in one micro-batch; the trigger bounds their number.
        batch = pd.concat(list(frames), ignore_index=True).sort_values([*keys, *order])
        own = [batch[k].astype(object).where(batch[k].notna(), None).tolist() for k in keys]
        sessions, ordered = list(zip(*own)), list(batch.itertuples(index=False, name="Row"))
        states, out, start = json.loads(kept.get[0]) if kept.exists else {}, [], 0
        for stop in range(1, len(ordered) + 1):
            if stop < len(ordered) and sessions[stop] == sessions[start]:
                continue
            session = json.dumps(sessions[start])
            states[session], produced = step(states.get(session), ordered[start:stop])
            out += produced
            start = stop
        kept.update((json.dumps(states),))
        yield pd.DataFrame(out, columns=names, dtype=object)

    # Null keys lie in buckets of their own, so a key column is null throughout a bucket or nowhere.
    nulls = sum((F.col(k).isNull().cast("long") * 2**i for i, k in enumerate(keys)), F.lit(0))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + nulls * BUCKETS
    dealt = stream.withColumn("bucket_", bucket).groupBy("bucket_")
    return dealt.applyInPandasWithState(advance, schema, "body string", "append", "NoTimeout")


def _schema(stream: DataFrame, names: list[str], rest: str) -> T.StructType:
    kept = [f for f in stream.schema.fields if f.name in names]
    return T.StructType(kept + T.StructType.fromDDL(rest).fields)


def _given(value):
    return None if value is None or value != value else value


def stream_labels(stream: DataFrame, label: str, n: int) -> DataFrame:
    """Confirmed label and reason at every row (batch twin: ``confirm_labels``)."""
    keys = ["session_id"]
    schema = _schema(
        stream, [*keys, "frame", "time_s"],
        "confirmed_label bigint, label_quality string, confidence double, label_reason string, "
        "is_boundary boolean",
    )

    def step(state, rows):
        confirmed, pending, count = state or [None, None, 0]
        out = []
        for row in rows:
            head, raw = (row.session_id, row.frame, row.time_s), _given(getattr(row, label))
            raw = None if raw is None else int(raw)
            reason, sure, boundary = None, 1.0, False
            counts = raw is not None and (confirmed is None or raw == confirmed + 1)
            if counts:
                count = count + 1 if pending == raw else 1
                pending, sure = raw, min(1.0, count / n)
                reason = "lap_confirmation_pending"
                if count >= n:
                    boundary = confirmed is not None
                    reason = "lap_boundary_confirmed" if boundary else "lap_initial_confirmed"
                    confirmed, pending, count = raw, None, 0
            else:
                pending, count = None, 0
                if raw is None:
                    sure, reason = 0.0, "lap_observation_missing"
                elif raw != confirmed:
                    sure, reason = 0.0, "lap_observation_rejected"
            if confirmed is None:
                quality = "missing"
            else:
                quality = "observed" if raw == confirmed else "held"
            out.append((*head, confirmed, quality, sure, reason, boundary))
        return [confirmed, pending, count], out

    return causal(stream, keys, step, schema, ["frame"])


def _columns(rows, *names: str) -> list[np.ndarray]:
    """Numeric columns of a session's sorted rows as doubles with NaN for null."""
    return [np.array([getattr(r, n) for r in rows], float) for n in names]


def _runs(marks: np.ndarray, *breaks: np.ndarray) -> np.ndarray:
    """First rows of stretches of equal marks; a break starts a stretch as well."""
    new = np.ones(len(marks), bool)
    new[1:] = marks[1:] != marks[:-1]
    for other in breaks:
        new |= other
    return np.flatnonzero(new)


def stream_admission(
    stream: DataFrame, *, max_rate: float, max_gap: float, value: str, quality: str
) -> DataFrame:
    """Admitted readings and the reason of a refusal (batch twin: ``admit_rate``).

    As in batch: a pair of neighbouring readings violates the limits or not, and in a stretch of
    violating pairs every other reading is refused.  The state is the last reading, if admitted.
    """
    keys = ["session_id"]
    schema = _schema(
        stream, [*keys, "frame", "time_s"],
        "admitted double, admitted_quality string, admission_reason string",
    )

    def step(state, rows):
        t, v = _columns(rows, "time_s", value)
        given = np.array([getattr(r, quality) for r in rows], object)
        read = (given == "observed") & np.array([_given(getattr(r, value)) is not None for r in rows])
        good = read & np.isfinite(v) & (v >= 0)
        timely = good & np.isfinite(t) & (t >= 0)
        before_t, before_v = (np.concatenate(([x], y[:-1])) for x, y in zip(state or [np.nan] * 2, (t, v)))
        follows = timely & np.concatenate(([state is not None], timely[:-1]))
        dt, change = t - before_t, np.abs(v - before_v)
        backward = follows & (dt <= 0)
        limit = max_rate * dt
        close = np.abs(change - limit) <= 1e-9 * np.maximum(np.abs(change), np.abs(limit))
        fast = follows & ~backward & (dt <= max_gap) & (change > limit) & ~close
        violates = backward | fast
        stretch = _runs(violates)
        place = np.arange(len(t)) - np.repeat(stretch, np.diff(np.append(stretch, len(t))))
        refused = violates & (place % 2 == 0)
        reason = np.select(
            [read & ~good, good & ~timely, refused & backward, refused],
            ["speed_value_invalid", "speed_timebase_invalid", "speed_timebase_invalid", "speed_rate_exceeded"],
            "",
        )
        out = [
            (r.session_id, r.frame, r.time_s, None, "anomalous", str(why)) if why
            else (r.session_id, r.frame, r.time_s, _given(getattr(r, value)), getattr(r, quality), None)
            for r, why in zip(rows, reason, strict=True)
        ]
        return [float(t[-1]), float(v[-1])] if timely[-1] and not refused[-1] else None, out

    return causal(stream, keys, step, schema, ["frame"])


def stream_events(
    stream: DataFrame, settings: EventSettings, *, name: str, value: str, quality: str
) -> DataFrame:
    """Events, emitted with the row that confirms them (batch twin: ``hysteresis_events``).

    As in batch: the rows of an evidence run fall into stretches above, between and below the
    thresholds, and a stretch that lasts long enough turns the state if it contradicts it.  The
    state carries the open run: its side, the stretch that has not lasted yet, the last time.
    """
    keys = ["session_id"]
    schema = _schema(
        stream, keys,
        "type string, frame bigint, time_s double, confirmed_frame bigint, confirmed_at_s double, "
        "previous_evidence_time_s double, value double",
    )

    def step(state, rows):
        side, waiting, last_t = state or [None, None, None]
        t, v = _columns(rows, "time_s", value)
        valid = np.array([getattr(r, quality) == "observed" for r in rows]) & (v >= 0) & (v <= 100)
        before = np.concatenate(([np.nan if last_t is None else last_t], np.where(valid, t, np.nan)[:-1]))
        apart = ~((t > before) & (t - before <= settings.max_gap + TIME_SLACK))
        marks = np.select([~valid, v >= settings.on, v <= settings.off], [9, 1, -1], 0)
        first = _runs(marks, valid & apart)
        out = []
        for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(t)], strict=True):
            mark = int(marks[start])
            if mark == 9 or apart[start]:
                side = waiting = None
            if mark == 9:
                continue
            if side is None or mark in (0, side):
                if side is None and mark == 1:
                    at = int(rows[start].frame), float(t[start])
                    out.append((rows[start].session_id, f"{name}_active_unbounded", *at, *at, None, float(v[start])))
                side, waiting = side or mark or None, None
                continue
            if start or waiting is None:
                known = None if np.isnan(before[start]) else float(before[start])
                waiting = [int(rows[start].frame), float(t[start]), float(v[start]), known]
            lasted = np.flatnonzero(t[start:stop] - waiting[1] + TIME_SLACK >= settings.persistence)
            if len(lasted):
                row, kind = start + int(lasted[0]), f"{name}_on" if mark == 1 else f"{name}_off"
                at = int(rows[row].frame), float(t[row])
                out.append((rows[row].session_id, kind, *waiting[:2], *at, waiting[3], waiting[2]))
                side, waiting = mark, None
        return [side, waiting, float(t[-1]) if valid[-1] else None], out

    return causal(stream, keys, step, schema, ["frame"])


def stream_last_observed(stream: DataFrame) -> DataFrame:
    """Newest observed time per field (batch twin: ``last_observed_time``)."""
    keys = ["session_id", "field"]
    schema = _schema(stream, [*keys, "frame", "time_s"], "last_observed_time_s double")

    def step(state, rows):
        seen, out = state, []
        for row in rows:
            seen = float(row.time_s) if row.quality == "observed" else seen
            out.append((row.session_id, row.field, row.frame, row.time_s, seen))
        return seen, out

    return causal(stream, keys, step, schema, ["frame"])


def stream_fusion(stream: DataFrame, settings: FusionSettings) -> DataFrame:
    """Fused progress with a known length (batch twin: ``fuse_progress``)."""
    keys = ["session_id"]
    rows = stream.select(*keys, *FUSE_INPUT)
    return causal(rows, keys, fuse_step(keys, settings), _schema(rows, keys, FUSED), ["frame"])
