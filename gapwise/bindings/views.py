"""The driver's tables read as signals.  One hour is one unit of ``time_s``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.channel import Channel
from gapwise.operators.runs import EventSettings
from gapwise.ordered import Axis, Lag, Least, group_rows, materialize, plan_axis, row_number, scan

# Thresholds scaled to the sparse test stream.
SETTINGS = EventSettings(on=60.0, off=30.0, persistence=6.0, max_gap=24.0)
CROSSING = 50.0
MAX_RATE, MAX_RATE_GAP = 5.0, 24.0
FILL_GAP = 24.0
LABEL_COUNT = 3
LAP_HOURS = 240.0
POSITION_GAP, TIME_GAP, GRID_STEP = 0.1, 48.0, 0.05
MATCH_WINDOW = 6.0
FRAME_TIME = 1.0

BRAKE = Channel("brake", "v", "q")
THROTTLE = Channel("throttle", "k")
GEAR = Channel("gear", "gear")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def kept(self) -> Views:
        """These views over a signal that is written once, for jobs that read it many times."""
        self.sig0 = materialize(self.sig0)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        ts = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").withColumn("us", ts)

    @cached_property
    def _event_axis(self) -> Axis:
        return plan_axis(self.events, ("user_id",), ("us", "event_id"))

    @cached_property
    def axis(self) -> Axis:
        """Whole sessions, or chunks of frames if one session is too large for a task."""
        wide = float(group_rows(self.spark)) if self._event_axis.chunked else None
        return Axis(("session_id",), ("frame",), wide)

    @cached_property
    def sig0(self) -> DataFrame:
        rows = scan(self.events, self._event_axis, _rn=row_number(), _t0=Least(F.col("us")))
        missing = F.col("event_type") == "error"
        quality = F.when(missing, "missing").when(F.col("event_type") == "signup", "held")
        k = F.get_json_object("props", "$.k").cast("double")
        return rows.select(
            F.col("user_id").alias("session_id"),
            "event_id",
            (F.col("_rn") - 1).alias("frame"),
            ((F.col("us") - F.col("_t0")) / 3.6e9).alias("time_s"),
            "event_type",
            "value",
            F.when(~missing, F.least(F.col("value"), F.lit(100.0))).alias("v"),
            quality.otherwise("observed").alias("q"),
            k.alias("k"),
        )

    @cached_property
    def sig(self) -> DataFrame:
        frame, time = F.col("frame"), F.col("time_s")
        step = F.floor(frame / 8).cast("int")
        raw = F.when(F.col("event_id") % 11 == 0, step + 3).otherwise(step)
        return self.sig0.filter(F.col("event_id") % 17 != 0).select(
            "*",
            (F.floor(F.col("k") / 17).cast("int") + 1).alias("gear"),
            F.when(F.col("event_id") % 13 != 0, raw).alias("raw_lap"),
            F.floor(time / LAP_HOURS).cast("int").alias("lap_number"),
            ((time - LAP_HOURS * F.floor(time / LAP_HOURS)) / LAP_HOURS).alias("s"),
        )

    @cached_property
    def laps(self) -> DataFrame:
        return self.sig.select(
            "session_id",
            "event_id",
            "frame",
            "time_s",
            "lap_number",
            "s",
            F.col("k").alias("throttle"),
            F.col("v").alias("brake"),
            F.col("value").alias("speed"),
            ((F.col("k") - 50) / 50).alias("steering"),
            "q",
            F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 2).cast("int")).alias("tc"),
            F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 7 % 2).cast("int")).alias("abs"),
        )

    @cached_property
    def lap_starts(self) -> DataFrame:
        """Laps with ``starts``: the first row of a lap after another lap."""
        rows = scan(self.laps, self.axis, _pl=Lag(F.col("lap_number")))
        changed = F.coalesce(F.col("lap_number") != F.col("_pl"), F.lit(False))
        return rows.withColumn("starts", changed)

    @cached_property
    def boundaries(self) -> DataFrame:
        return self.lap_starts.filter("starts").select(
            "session_id",
            "frame",
            "time_s",
            F.col("_pl").alias("from_lap"),
            F.col("lap_number").alias("to_lap"),
        )

    @cached_property
    def obs(self) -> DataFrame:
        def side(field, value, quality):
            return F.struct(
                F.lit(field).alias("field"),
                value.cast("double").alias("value"),
                quality.alias("quality"),
                value.cast("double").cast("string").alias("raw_value"),
                F.array().cast("array<string>").alias("reasons"),
            )

        both = F.array(
            side("brake", F.col("v"), F.col("q")),
            side("throttle", F.col("k"), F.lit("observed")),
        )
        return self.sig.select(
            "session_id", "event_id", "frame", "time_s", F.inline(both)
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return self.sig.select("session_id").distinct()

    @cached_property
    def spans(self) -> DataFrame:
        # One span a day, as many as the session has days.
        last = self.sig.groupBy("session_id").agg(F.floor(F.max("time_s") / 24).cast("int").alias("last"))
        state = F.element_at(F.array(*map(F.lit, ("visible", "absent", "unknown"))), F.col("i") % 3 + 1)
        return last.select("session_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).select(
            "session_id",
            F.lit("brake").alias("field"),
            (F.col("i") * 24.0).alias("start_s"),
            (F.col("i") * 24.0 + 12.0).alias("end_s"),
            state.alias("state"),
            F.lit("reviewer").alias("reviewer"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        # Frames of ``sig0`` have no holes, so they name every zone up to the last one.
        ends = self.sig.groupBy("session_id").agg(F.floor(F.max("frame") / 10).alias("last"))
        tens = self.sig0.select("session_id", F.floor(F.col("frame") / 10).alias("i")).distinct()
        rows = tens.join(ends, "session_id").filter("i <= last")
        return rows.select(
            "session_id",
            F.concat(F.lit("z"), F.col("i")).alias("id"),
            F.concat(F.lit("Zone "), F.col("i")).alias("label"),
            (F.col("i") * 10).alias("start_frame"),
            (F.col("i") * 10 + 10).alias("end_frame"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        # Frames 5 to 20 of every 25, to the end of the session.
        last = self.sig.groupBy("session_id").agg(F.max("frame").alias("last")).filter("last >= 5")
        first = F.explode(F.sequence(F.lit(5).cast("long"), F.col("last"), F.lit(25).cast("long")))
        rows = last.select("session_id", "last", first.alias("frame_lo"))
        return rows.select("session_id", "frame_lo", F.least(F.col("frame_lo") + 15, "last").alias("frame_hi"))


# The same views as SQL common table expressions.
SIG = """WITH sig0 AS (
  SELECT user_id AS session_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS time_s,
         event_type, value,
         CASE WHEN event_type = 'error' THEN NULL ELSE least(value, 100.0) END AS v,
         CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'held'
              ELSE 'observed' END AS q,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
), sig AS (
  SELECT *, CAST(floor(k / 17) AS INT) + 1 AS gear,
         CASE WHEN event_id % 13 = 0 THEN NULL
              WHEN event_id % 11 = 0 THEN CAST(floor(frame / 8) AS INT) + 3
              ELSE CAST(floor(frame / 8) AS INT) END AS raw_lap,
         CAST(floor(time_s / 240) AS INT) AS lap_number,
         (time_s - 240 * floor(time_s / 240)) / 240 AS s
  FROM sig0 WHERE event_id % 17 <> 0
)"""

LAPS = SIG + """, laps AS (
  SELECT session_id, event_id, frame, time_s, lap_number, s, k AS throttle, v AS brake,
         value AS speed, (k - 50) / 50 AS steering, q,
         CASE WHEN event_id % 3 <> 0 THEN event_id % 2 END AS tc,
         CASE WHEN event_id % 5 <> 0 THEN event_id % 7 % 2 END AS abs
  FROM sig
)"""

BOUNDARIES = LAPS + """, boundaries AS (
  SELECT session_id, frame, time_s, pl AS from_lap, lap_number AS to_lap
  FROM (SELECT *, lag(lap_number) OVER (PARTITION BY session_id ORDER BY frame) AS pl FROM laps)
  WHERE lap_number <> pl
)"""

OBS = SIG + """, obs AS (
  SELECT session_id, event_id, frame, time_s, 'brake' AS field, v AS value, q AS quality FROM sig
  UNION ALL
  SELECT session_id, event_id, frame, time_s, 'throttle', k, 'observed' FROM sig
)"""

SPANS_CTE = """, spans AS (
  SELECT session_id, 'brake' AS field, i * 24.0 AS start_s, i * 24.0 + 12.0 AS end_s,
         CASE i % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'absent' ELSE 'unknown' END AS state
  FROM (SELECT session_id, unnest(range(CAST(floor(max(time_s) / 24) AS BIGINT) + 1)) AS i FROM sig GROUP BY session_id)
)"""

ZONES_CTE = """, zones AS (
  SELECT session_id, 'z' || i AS id, i * 10 AS start_frame, i * 10 + 10 AS end_frame
  FROM (SELECT session_id, unnest(range(max(frame) // 10 + 1)) AS i FROM sig GROUP BY session_id)
)"""

SEGMENTS_CTE = """, segments AS (
  SELECT session_id, lo AS frame_lo, least(lo + 15, m) AS frame_hi
  FROM (SELECT session_id, max(frame) AS m, unnest(range(5, max(frame) + 1, 25)) AS lo FROM sig GROUP BY session_id)
)"""
