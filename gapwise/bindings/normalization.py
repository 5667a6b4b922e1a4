"""Queries on text readings, flags and normalized samples."""

from pyspark.sql import functions as F

from gapwise.bindings.registry import register
from gapwise.bindings.views import LAPS, OBS, SIG, Views
from gapwise.functions import scalars as S
from gapwise.operators import normalize as N
from gapwise.sources.tables import with_envelope


@register(
    "opt_number",
    """WITH t AS (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL
                   ELSE ' ' || CAST(value AS VARCHAR) END AS text FROM events
)
--
SELECT event_id, CAST(nullif(trim(text), '') AS DOUBLE) AS as_float,
       CAST(trunc(CAST(nullif(trim(text), '') AS DOUBLE)) AS INT) AS as_int,
       trunc(CAST(nullif(trim(text), '') AS DOUBLE)) <> 0 AS as_bool
FROM t""",
    "as_float",
)
def opt_number(v: Views):
    text = F.when(F.col("event_id") % 5 == 0, "  ").when(
        F.col("event_id") % 5 != 1, F.concat(F.lit(" "), F.col("value").cast("string"))
    )
    return v.table("events").select(
        "event_id",
        S.opt_float(text).alias("as_float"),
        S.opt_int(text).alias("as_int"),
        S.opt_bool(text).alias("as_bool"),
    )


@register(
    "lap_time_seconds",
    """
--
SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(second(ts) AS DOUBLE)
       ELSE minute(ts) * 60 + (epoch_us(ts) // 1000 % 60000) / 1000.0 END AS seconds
FROM events""",
    "seconds",
)
def lap_time_seconds(v: Views):
    text = (
        F.when(F.col("event_id") % 7 == 0, " ")
        .when(F.col("event_id") % 7 == 1, F.second("ts").cast("string"))
        .otherwise(F.date_format("ts", "m:ss.SSS"))
    )
    return v.table("events").select("event_id", S.lap_time_seconds(text).alias("seconds"))


@register(
    "extract_lap_time",
    r"""WITH t AS (
  SELECT event_id, 'LAP ' || minute(ts) || ':' || lpad(second(ts)::VARCHAR, 2, '0') || '.'
         || left(lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0'), 1 + (event_id % 3)::INT) || ' x' AS text
  FROM events
), p AS (
  SELECT event_id, lpad(regexp_extract(text, '(\d{1,2}):(\d{2})\.(\d{1,3})', 1), 2, '0') AS m,
         regexp_extract(text, '(\d{1,2}):(\d{2})\.(\d{1,3})', 2) AS s,
         rpad(regexp_extract(text, '(\d{1,2}):(\d{2})\.(\d{1,3})', 3), 3, '0') AS ms FROM t
), q AS (
  SELECT *, m::INT * 60 + s::INT + ms::INT / 1000.0 AS total FROM p
)
--
SELECT event_id, CASE WHEN total BETWEEN 20 AND 600 THEN m || ':' || s || '.' || ms END AS lap_time,
       CASE WHEN total BETWEEN 20 AND 600 THEN total END AS seconds
FROM q""",
    "seconds",
)
def extract_lap_time(v: Views):
    millis = F.date_format("ts", "SSS")
    part = F.substring(millis, F.lit(1), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit("LAP "), F.date_format("ts", "m:ss."), part, F.lit(" x"))
    shown = S.extract_lap_time(text)
    return v.table("events").select(
        "event_id", shown.alias("lap_time"), S.strict_lap_time_seconds(shown).alias("seconds")
    )


def _hint_text():
    return (
        F.when(F.col("event_id") % 10 == 0, "broken")
        .when(F.col("event_id") % 7 == 0, F.concat(F.lit("s:"), F.col("event_type")))
        .when(F.col("event_id") % 9 == 0, "")
        .otherwise(F.concat(F.lit("s: held;speed_kmh:"), F.when(F.col("event_id") % 2 == 0, "missing")
                            .otherwise("anomalous"), F.lit(";s:observed")))
    )


@register(
    "parse_quality_hints",
    """
--
SELECT event_id,
       CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 7 = 0 THEN event_type
            WHEN event_id % 9 = 0 THEN NULL ELSE 'observed' END AS s_flag,
       CASE WHEN event_id % 10 = 0 OR event_id % 7 = 0 OR event_id % 9 = 0 THEN NULL
            WHEN event_id % 2 = 0 THEN 'missing' ELSE 'anomalous' END AS speed_flag,
       CASE WHEN event_id % 10 = 0 THEN 'hint_without_separator'
            WHEN event_id % 7 = 0 THEN 'unknown_quality_flag' END AS problem
FROM events""",
)
def parse_quality_hints(v: Views):
    rows = v.table("events").withColumn("text", _hint_text())
    hints = S.quality_hints(F.col("text"))
    return rows.select(
        "event_id",
        hints["s"].alias("s_flag"),
        hints["speed_kmh"].alias("speed_flag"),
        S.hint_problem(F.col("text")).alias("problem"),
    )


@register(
    "parse_reasons",
    """
--
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN event_type
                 ELSE 'late;' || event_type END AS reasons
FROM events""",
)
def parse_reasons(v: Views):
    kind = F.col("event_type")
    text = (
        F.when(F.col("event_id") % 6 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit(" ;"), kind, F.lit(";; ")))
        .otherwise(F.concat(F.lit("late ; "), kind))
    )
    return v.table("events").select("event_id", S.parse_reasons(text).alias("reasons"))


def raw_records(v: Views):
    """The signal as flat text records with doubts of every kind."""
    e = F.col("event_id")
    number = F.col("value").cast("string")
    return v.sig.select(
        "session_id",
        "event_id",
        F.col("frame").cast("string").alias("frame"),
        F.col("time_s").cast("string").alias("time"),
        F.col("lap_number").cast("string").alias("lap_number"),
        F.lit("2:18.123").alias("lap_time"),
        F.when(e % 23 == 0, "").otherwise(number).alias("speed"),
        F.when(e % 19 == 0, " ").otherwise(F.col("gear").cast("string")).alias("gear"),
        F.when(e % 37 == 0, "101.5").otherwise(F.col("k").cast("string")).alias("throttle"),
        F.col("v").cast("string").alias("brake"),
        ((F.col("k") - 50) / 45).cast("string").alias("steering"),
        F.when(e % 3 == 0, "").otherwise((e % 2).cast("string")).alias("tc_active"),
        F.when(e % 5 == 0, "held").alias("_h"),
        F.when(e % 41 == 0, "1.25").otherwise(F.col("s").cast("string")).alias("s_fused"),
        F.when(e % 4 == 0, "").when(e % 4 == 1, "fused").otherwise("observed").alias("s_source"),
        F.when(F.col("q") == "observed", "").otherwise(F.concat(F.lit("brake_pct:"), F.col("q")))
        .alias("quality_hint"),
        F.lit("").alias("field_reasons"),
        F.lit("a;b").alias("s_reasons"),
    ).drop("_h")


NORMALIZED = SIG + """, n AS (
  SELECT session_id, frame, time_s, lap_number, 138.123::DOUBLE AS lap_time_s,
         CASE WHEN event_id % 41 = 0 THEN 1.25 ELSE s END AS s,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE value END AS speed_kmh,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE gear END AS gear,
         CASE WHEN event_id % 37 = 0 THEN 101.5 ELSE k END AS throttle_pct,
         v AS brake_pct, (k - 50) / 45 AS steering,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 <> 0 END AS tc_active,
         q, event_id
  FROM sig
), flags AS (
  SELECT *, CASE WHEN s NOT BETWEEN 0 AND 1 THEN 'anomalous' WHEN event_id % 4 = 1 THEN 'fused'
                 WHEN event_id % 4 = 0 THEN 'observed' ELSE 'observed' END AS s_quality,
         CASE WHEN speed_kmh IS NULL THEN 'missing' WHEN speed_kmh NOT BETWEEN 0 AND 400
              THEN 'anomalous' ELSE 'observed' END AS speed_quality,
         CASE WHEN throttle_pct NOT BETWEEN 0 AND 100 THEN 'anomalous' ELSE 'observed' END
           AS throttle_quality,
         CASE WHEN q <> 'observed' THEN q WHEN brake_pct IS NULL THEN 'missing' ELSE 'observed' END
           AS brake_quality,
         CASE WHEN steering NOT BETWEEN -1 AND 1 THEN 'anomalous' ELSE 'observed' END
           AS steering_quality,
         concat_ws(';', CASE WHEN speed_kmh NOT BETWEEN 0 AND 400
                             THEN 'speed_kmh outside [0, 400]' END,
                   CASE WHEN s NOT BETWEEN 0 AND 1 THEN 's outside [0, 1]' END,
                   CASE WHEN throttle_pct NOT BETWEEN 0 AND 100
                        THEN 'throttle_pct outside [0, 100]' END,
                   CASE WHEN steering NOT BETWEEN -1 AND 1 THEN 'steering outside [-1, 1]' END)
           AS anomalies
  FROM n
)"""


@register(
    "normalize_records",
    NORMALIZED + """
--
SELECT session_id, frame, time_s, lap_number, lap_time_s, s, speed_kmh, gear, throttle_pct,
       brake_pct, steering, tc_active, s_quality, speed_quality, throttle_quality, brake_quality,
       steering_quality, anomalies
FROM flags""",
    "time_s lap_time_s s speed_kmh throttle_pct brake_pct steering",
)
def normalize_records(v: Views):
    rows = N.normalize(raw_records(v), N.Limits())
    q = F.col("field_quality")
    return rows.select(
        "session_id", "frame", "time_s", "lap_number", "lap_time_s", "s", "speed_kmh", "gear",
        "throttle_pct", "brake_pct", "steering", "tc_active",
        q["s"].alias("s_quality"), q["speed_kmh"].alias("speed_quality"),
        q["throttle_pct"].alias("throttle_quality"), q["brake_pct"].alias("brake_quality"),
        q["steering"].alias("steering_quality"), "anomalies",
    )


@register(
    "pack_quality",
    NORMALIZED + """
--
SELECT session_id, frame,
       'abs_active:missing;brake_pct:' || brake_quality || ';gear:' ||
       CASE WHEN gear IS NULL THEN 'missing' ELSE 'observed' END || ';lap_number:observed;'
       || 'lap_time_s:observed;s:' || s_quality || ';speed_kmh:' || speed_quality || ';steering:'
       || steering_quality || ';tc_active:' ||
       CASE WHEN tc_active IS NULL THEN 'missing' ELSE 'observed' END || ';throttle_pct:'
       || throttle_quality AS quality_hint, '{}' AS field_reasons, 'a;b' AS s_reasons
FROM flags""",
)
def pack_quality(v: Views):
    packed = N.pack_quality(N.normalize(raw_records(v), N.Limits()))
    return packed.select("session_id", "frame", "quality_hint", "field_reasons", "s_reasons")


@register(
    "reject_nonfinite_modern",
    SIG + """
--
SELECT session_id, 'non_finite:speed' AS rule, CAST(frame AS VARCHAR) AS key FROM sig
WHERE event_id % 29 = 0
UNION ALL
SELECT session_id, 'non_finite:brake', CAST(frame AS VARCHAR) FROM sig WHERE event_id % 31 = 0""",
)
def reject_nonfinite_modern(v: Views):
    rows = raw_records(v).withColumns(
        {
            "speed": F.when(F.col("event_id") % 29 == 0, "NaN").otherwise(F.col("speed")),
            "brake": F.when(F.col("event_id") % 31 == 0, "-Infinity").otherwise(F.col("brake")),
        }
    )
    return N.record_violations(rows, ("session_id",))


@register(
    "parse_field_reasons",
    """
--
SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2, 3) THEN '' ELSE 'late;' || event_type END
         AS brake_reasons,
       event_id % 8 IN (1, 2, 3) AS invalid
FROM events""",
)
def parse_field_reasons(v: Views):
    kind = F.col("event_type")
    good = F.to_json(F.create_map(F.lit("brake"), F.array(F.lit("late"), kind)))
    text = (
        F.when(F.col("event_id") % 8 == 0, "")
        .when(F.col("event_id") % 8 == 1, '["late"]')
        .when(F.col("event_id") % 8 == 2, '{"brake": "late"}')
        .when(F.col("event_id") % 8 == 3, '{"brake": [1]}')
        .otherwise(good)
    )
    rows = v.table("events").withColumn("text", text)
    invalid = N.reasons_invalid(F.col("text"))
    empty = F.array().cast("array<string>")
    parsed = F.coalesce(N.parse_field_reasons(F.col("text"))["brake"], empty)
    return rows.select(
        "event_id", F.when(invalid, empty).otherwise(parsed).alias("brake_reasons"),
        invalid.alias("invalid"),
    )


SPEED_SQL = r"""SELECT {key} AS id, '{origin}' AS origin,
       CASE WHEN regexp_full_match(trim(t), '[0-9]+') AND try_cast(trim(t) AS HUGEINT) <= 400
            THEN try_cast(trim(t) AS INT) END AS value,
       CASE WHEN t IS NULL OR trim(t) = '' THEN 'missing'
            WHEN regexp_full_match(trim(t), '[0-9]+') AND try_cast(trim(t) AS HUGEINT) <= 400 THEN 'observed'
            ELSE 'anomalous' END AS quality, t AS raw_value,
       CASE WHEN t IS NULL OR trim(t) = '' THEN 'speed_ocr_missing'
            WHEN NOT regexp_full_match(trim(t), '[0-9]+') THEN 'speed_ocr_invalid'
            WHEN try_cast(trim(t) AS HUGEINT) > 400 THEN 'speed_out_of_range' ELSE '' END AS reasons
FROM (SELECT *, {text} AS t FROM {table})"""
PART_TEXT = (
    "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN ' ' || p_size "
    "WHEN 2 THEN '' || (p_partkey * 7) ELSE '' END"
)
ORDER_TEXT = "CASE WHEN o_orderkey % 3 = 0 THEN left(o_orderpriority, 1) ELSE o_orderpriority END"


def _part_text():
    key = F.col("p_partkey")
    return (
        F.when(key % 4 == 0, F.col("p_brand"))
        .when(key % 4 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string")))
        .when(key % 4 == 2, (key * 7).cast("string"))
        .otherwise("")
    )


def _order_text():
    first = F.substring("o_orderpriority", 1, 1)
    return F.when(F.col("o_orderkey") % 3 == 0, first).otherwise(F.col("o_orderpriority"))


def _texts(v: Views):
    parts = v.table("part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("origin"),
                                   _part_text().alias("t"))
    orders = v.table("orders").select(F.col("o_orderkey").alias("id"),
                                      F.lit("orders").alias("origin"), _order_text().alias("t"))
    return parts.unionByName(orders)


def _classified(v: Views, classify):
    return _texts(v).select("id", "origin", classify(F.col("t")).alias("r")).select(
        "id", "origin", "r.*"
    )


def _both_tables(sql: str) -> str:
    return "\n--\n" + " UNION ALL ".join(
        sql.format(key=key, origin=table, text=text, table=table)
        for key, table, text in (
            ("p_partkey", "part", PART_TEXT), ("o_orderkey", "orders", ORDER_TEXT))
    )


@register("classify_speed_text", _both_tables(SPEED_SQL))
def classify_speed_text(v: Views):
    return _classified(v, S.classify_speed_text)


@register(
    "classify_gear_text",
    _both_tables("""SELECT {key} AS id, '{origin}' AS origin,
       CASE WHEN t IN ('1', '2', '3', '4', '5', '6') THEN t::INT END AS value,
       CASE WHEN t IN ('1', '2', '3', '4', '5', '6') THEN 'observed' ELSE 'missing' END AS quality,
       t AS raw_value,
       CASE WHEN t IN ('1', '2', '3', '4', '5', '6') THEN '' WHEN t IN ('N', 'R')
            THEN 'unsupported_gear_symbol' WHEN t = '' THEN 'gear_ocr_missing'
            ELSE 'gear_ocr_invalid' END AS reasons
FROM (SELECT *, {text} AS t FROM {table})"""),
)
def classify_gear_text(v: Views):
    return _classified(v, S.classify_gear_text)


@register(
    "classify_lap_text",
    _both_tables("""SELECT {key} AS id, '{origin}' AS origin,
       CASE WHEN regexp_full_match(trim(t), '[0-9]+') AND try_cast(trim(t) AS HUGEINT) <= 999
            THEN try_cast(trim(t) AS INT) END AS value,
       CASE WHEN regexp_full_match(trim(t), '[0-9]+') AND try_cast(trim(t) AS HUGEINT) <= 999 THEN 'observed'
            ELSE 'missing' END AS quality, t AS raw_value,
       CASE WHEN regexp_full_match(trim(t), '[0-9]+') AND try_cast(trim(t) AS HUGEINT) <= 999 THEN ''
            WHEN trim(t) = '' THEN 'lap_ocr_missing' ELSE 'lap_ocr_invalid' END AS reasons
FROM (SELECT *, {text} AS t FROM {table})"""),
)
def classify_lap_text(v: Views):
    return _classified(v, S.classify_lap_text)


@register(
    "salvage_digits",
    _both_tables("""SELECT {key} AS id, '{origin}' AS origin,
       CASE WHEN try_cast(regexp_replace(t, '[^0-9]', '', 'g') AS HUGEINT) BETWEEN 0 AND 400
            THEN regexp_replace(t, '[^0-9]', '', 'g')::INT END AS value
FROM (SELECT *, {text} AS t FROM {table})"""),
)
def salvage_digits(v: Views):
    return _texts(v).select("id", "origin", S.salvage_digits(F.col("t"), 0, 400).alias("value"))


@register(
    "last_observed_time",
    OBS + """
--
SELECT session_id, frame, field,
       last_value(CASE WHEN quality = 'observed' THEN time_s END IGNORE NULLS)
         OVER (PARTITION BY session_id, field ORDER BY frame) AS last_observed_time_s
FROM obs""",
    "last_observed_time_s",
)
def last_observed_time(v: Views):
    rows = N.last_observed_time(v.obs, v.axis)
    return rows.select("session_id", "frame", "field", "last_observed_time_s")


@register(
    "wrapped_delta",
    LAPS + """, d AS (
  SELECT session_id, frame, s - lag(s) OVER (PARTITION BY session_id ORDER BY frame) AS x FROM laps
), w AS (
  SELECT session_id, frame, x - floor(x) AS t FROM d WHERE x IS NOT NULL
)
--
SELECT session_id, frame, CASE WHEN t > 0.5 THEN t - 1 ELSE t END AS delta FROM w""",
    "delta",
)
def wrapped_delta(v: Views):
    from gapwise.ordered import Lag, scan

    rows = scan(v.laps, v.axis, _p=Lag(F.col("s"))).filter(F.col("_p").isNotNull())
    return rows.select(
        "session_id", "frame", S.wrapped_delta(F.col("s"), F.col("_p")).alias("delta")
    )


@register(
    "segment_relative_time",
    LAPS + """
--
SELECT session_id, frame, lap_number, time_s - first_value(time_s)
         OVER (PARTITION BY session_id, lap_number ORDER BY frame) AS segment_time_s
FROM laps""",
    "segment_time_s",
)
def segment_relative_time(v: Views):
    rows = N.segment_relative_time(v.laps, v.axis, "lap_number")
    return rows.select("session_id", "frame", "lap_number", "segment_time_s")


@register(
    "with_envelope",
    SIG + """
--
SELECT session_id, frame, time_s, 'telemetry-v2' AS schema_version,
       CAST(session_id AS VARCHAR) AS source_id, 'profile' AS profile,
       session_id * 10.0 + time_s AS source_time_s
FROM sig""",
    "time_s source_time_s",
)
def envelope(v: Views):
    rows = v.sig.withColumn("start_s", F.col("session_id") * 10.0)
    rows = with_envelope(rows, "telemetry-v2", "profile", "start_s")
    return rows.select("session_id", "frame", "time_s", "schema_version", "source_id", "profile",
                       "source_time_s")


@register(
    "json_clean",
    """
--
SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS reading,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS other
FROM events""",
    "reading other",
)
def json_clean(v: Views):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    e = F.col("event_id")
    rows = v.table("events").select(
        "event_id",
        F.when(e % 7 == 0, nan).when(e % 7 == 1, -inf).otherwise(F.col("value")).alias("reading"),
        F.when(e % 5 == 0, inf).otherwise(F.col("value") * 2).alias("other"),
    )
    return N.json_clean(rows)
