"""Control episodes between on and off events, and what lies between episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.channel import Channel
from gapwise.operators.runs import TIME_SLACK, EventSettings, marked_events, stacked
from gapwise.ordered import Axis, Last, Lead, Next, overlap_join, scan


def marked_episodes(df: DataFrame, axis: Axis, channels: list[Channel], settings: EventSettings) -> DataFrame:
    """The one pass behind episodes and their events: every row of every field with the events around it."""
    along = axis.within("field")
    rows = marked_events(stacked(df, axis, channels), along, settings, split_on_frame_jump=True)
    jumped = F.col("frame") != F.col("_p.frame") + 1
    broken = F.coalesce(jumped | (F.col("time_s") - F.col("_p.time_s") > settings.max_gap + TIME_SLACK), F.lit(False))
    starts = F.col("_ok") & ~(F.coalesce(F.col("_p.ok"), F.lit(False)) & ~broken)
    event, on = F.col("_event"), ~F.col("_event.off")
    rows = scan(
        rows,
        along,
        _start=Last(F.when(starts, F.struct(F.col("frame").alias("f"), F.col("_p").isNull().alias("edge")))),
        _nf=Lead(F.lit(True)),
        _past=Last(event),
        _past_on=Last(F.when(on, event["frame"])),
    )
    # An event holds from the first row of its island, which is before the row that confirms it.
    rows = scan(rows, along, _next=Next(event), _after=Next(event, here=False))
    own = F.coalesce(F.col("_next.frame") == F.col("_isl.frame"), F.lit(False))
    return rows.withColumns(
        {
            "_m": F.when(own, F.col("_next")).otherwise(F.col("_past")),
            "_on": F.when(own & ~F.col("_next.off"), F.col("_next.frame")).otherwise(F.col("_past_on")),
        }
    )


def control_episodes(
    df: DataFrame, axis: Axis, channel: Channel | list[Channel], settings: EventSettings
) -> DataFrame:
    """Pair each on (or unbounded) event with the next off event of its run.

    The table must pass ``check_clock``.  An episode keeps null durations when one of
    its bounds was not seen.  Several channels are taken in one pass.
    """
    channels = [channel] if isinstance(channel, Channel) else channel
    return episodes_of(marked_episodes(df, axis, channels, settings), axis)


def episodes_of(rows: DataFrame, axis: Axis) -> DataFrame:
    """Episodes from the rows of ``marked_episodes``; a field's rows stay where they are."""
    by = (*axis.keys, "field")
    body = rows.filter(F.col("_ok") & (F.col("_on") >= F.col("_start.f")))
    active = ~F.col("_m.off")
    explains = active | (F.col("frame") <= F.col("_m.confirmed_frame"))
    point = F.struct(F.col("frame"), F.col("time_s"))
    # The row that confirms the event of the episode knows the event after it.
    heads = F.col("_event.frame") == F.col("_on")
    head = F.struct(F.col("_event.unbounded").alias("unbounded"), F.col("_after").alias("next"))
    e = (
        body.filter(explains)
        .groupBy(*by, F.col("_on").alias("start_frame"))
        .agg(
            F.max(F.when(active, F.col("_start.f"))).alias("run_start"),
            F.min_by(F.when(active, point), F.when(active, F.col("frame"))).alias("first"),
            F.max_by(F.when(active, point), F.when(active, F.col("frame"))).alias("last"),
            F.max_by(F.col("_v"), F.when(active, F.col("frame"))).alias("last_value"),
            F.max(F.when(active, F.col("_v"))).alias("peak"),
            F.max_by(point, F.when(active, F.struct(F.col("_v"), -F.col("frame")))).alias(
                "first_peak"
            ),
            F.max_by(point, F.when(active, F.struct(F.col("_v"), F.col("frame")))).alias(
                "last_peak"
            ),
            F.count(F.when(active, 1)).alias("active"),
            F.max(F.when(active, F.col("_start.edge"))).alias("at_start"),
            F.max(F.when(active, F.col("_nf").isNull())).alias("at_end"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_why")))).alias("reasons"),
            F.max(F.when(heads, head)).alias("_head"),
        )
        .filter(F.col("_head").isNotNull())
    )
    # The next event closes the episode only if it is the off event of the same run,
    # which is then the first valid frame after the last active one.
    follower = F.col("_head.next")
    ended = F.coalesce(follower["off"] & (follower["frame"] == F.col("last.frame") + 1), F.lit(False))
    left = F.col("_head.unbounded")
    span = F.col("finish_time_s") - F.col("first.time_s")
    tail = F.when(F.col("ended"), F.col("finish_time_s") - F.col("last_peak.time_s"))
    e = e.withColumns(
        {
            "ended": ended,
            "finish_frame": F.when(ended, follower["frame"]).otherwise(F.col("last.frame")),
            "finish_time_s": F.when(ended, follower["time_s"]).otherwise(F.col("last.time_s")),
            "finish_value": F.when(ended, follower["value"]).otherwise(F.col("last_value")),
        }
    ).withColumn("tail", tail)
    left_reason = F.when(F.col("at_start"), "session_start").otherwise("evidence_gap")
    right_reason = F.when(F.col("at_end"), "session_end").otherwise("evidence_gap")
    return e.select(
        *axis.keys,
        F.concat("field", F.lit("-episode-"), F.col("first.frame")).alias("id"),
        "field",
        F.concat("field", F.lit("-run-"), F.col("run_start")).alias("run_id"),
        F.col("first.frame").alias("start_frame"),
        F.col("first.time_s").alias("start_time_s"),
        F.col("finish_frame").alias("end_frame"),
        F.col("finish_time_s").alias("end_time_s"),
        left.alias("left_truncated"),
        (~F.col("ended")).alias("right_truncated"),
        F.array_compact(
            F.array(F.when(left, left_reason), F.when(~F.col("ended"), right_reason))
        ).alias("truncation_reasons"),
        F.col("reasons"),
        F.when(~left & F.col("ended"), span).alias("duration_s"),
        span.alias("observed_span_s"),
        F.col("peak").alias("observed_peak"),
        F.col("first_peak.frame").alias("first_peak_frame"),
        F.col("last_peak.frame").alias("last_peak_frame"),
        F.when(~left, F.col("first_peak.time_s") - F.col("first.time_s")).alias(
            "time_to_first_peak_s"
        ),
        F.col("tail").alias("terminal_tail_s"),
        F.when(F.col("tail") > 0, (F.col("finish_value") - F.col("peak")) / F.col("tail")).alias(
            "terminal_tail_slope"
        ),
        F.lit(None).cast("double").alias("release_onset_s"),
        (F.col("active") + F.col("ended").cast("int")).alias("sample_count"),
    )


def resumptions(episodes: DataFrame, axis: Axis) -> DataFrame:
    """Successive episodes of one field in one evidence run."""
    along = Axis((*axis.keys, "field", "run_id"), ("start_frame",), axis.width)
    nxt = F.struct(F.col("id"), F.col("start_time_s"))
    rows = scan(episodes, along, _n=Lead(nxt)).filter(F.col("_n").isNotNull())
    return rows.select(
        *axis.keys,
        "field",
        F.col("id").alias("previous_episode_id"),
        F.col("_n.id").alias("next_episode_id"),
        F.col("end_time_s").alias("off_time_s"),
        F.col("_n.start_time_s").alias("on_time_s"),
        (F.col("_n.start_time_s") - F.col("end_time_s")).alias("inactive_interval_s"),
    )


def overlap_intervals(first: DataFrame, second: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Common part of two kinds of episodes; touching ends do not count."""
    span = ("start_time_s", "end_time_s")
    pairs = overlap_join(first, second, keys, span, span)
    start = F.greatest(F.col("l.start_time_s"), F.col("r.start_time_s"))
    end = F.least(F.col("l.end_time_s"), F.col("r.end_time_s"))
    limited = [F.col(f"{s}.{c}_truncated") for s in "lr" for c in ("left", "right")]
    return pairs.filter(start < end).select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        F.col("l.id").alias("first_episode_id"),
        F.col("r.id").alias("second_episode_id"),
        start.alias("start_time_s"),
        end.alias("end_time_s"),
        (end - start).alias("observed_duration_s"),
        (limited[0] | limited[1] | limited[2] | limited[3]).alias("boundary_limited"),
    )
