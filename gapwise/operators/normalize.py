"""From flat records to canonical samples; values are kept, doubts are flagged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.channel import finite
from gapwise.functions import scalars as S
from gapwise.ordered import Axis, Last, Lag, scan
from gapwise.schema import PROGRESS_SOURCES


@dataclass(frozen=True)
class Limits:
    speed_min: float = 0
    speed_max: float = 400
    pedal_min: float = 0
    pedal_max: float = 100


# Numeric columns of a modern record.
MODERN_NUMBERS = (
    "frame", "time", "lap_number", "raw_lap_number", "speed", "gear", "throttle", "brake",
    "steering", "tc_active", "abs_active", "track_position", "s_fused", "s_odometry",
    "s_visual", "s_uncertainty",
)
PROGRESS_COLUMNS = ("s_fused", "s_source")


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def is_modern(df: DataFrame) -> bool:
    return any(c in df.columns for c in (*PROGRESS_COLUMNS, "quality_hint"))


def record_violations(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that may not be normalized: bad hints, reasons, sources and non-finite numbers."""
    rules: list[tuple[str, Column]] = []
    if is_modern(df):
        for name in MODERN_NUMBERS:
            number = _text(df, name).try_cast("double")
            shown = number.isNotNull() & ~finite(number)
            rules.append((f"non_finite:{name}", shown))
        # A clock text has a colon; only a plain number can be non-finite.
        lap = F.trim(_text(df, "lap_time")).try_cast("double")
        rules.append(("non_finite:lap_time", lap.isNotNull() & ~finite(lap)))
    rules.append(("invalid_quality_hint", S.hint_problem(_text(df, "quality_hint")).isNotNull()))
    rules.append(("invalid_field_reasons", reasons_invalid(_text(df, "field_reasons"))))
    source = F.trim(_text(df, "s_source"))
    rules.append(("unknown_s_source", (source != "") & ~source.isin(*PROGRESS_SOURCES)))
    checks = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in rules]
    )
    hits = F.filter(checks, lambda r: r["hit"])
    return df.select(*keys, "frame", F.explode(hits).alias("_r")).select(
        *keys,
        F.col("_r.rule").alias("rule"),
        F.col("frame").cast("string").alias("key"),
    )


def parse_field_reasons(text: Column) -> Column:
    parsed = F.from_json(text, "map<string,array<string>>")
    empty = F.from_json(F.lit("{}"), "map<string,array<string>>")
    return F.when(text.isNull() | (text == ""), empty).otherwise(parsed)


def reasons_invalid(text: Column) -> Column:
    """Not a JSON object of string lists; numbers and nulls in the lists do not count as strings."""
    given = text.isNotNull() & (text != "")
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    fields = F.from_json(text, "map<string,string>")
    listed = F.transform(F.map_values(fields), lambda v: F.schema_of_variant(F.try_parse_json(v)))
    fine = F.forall(listed, lambda k: k.isin("ARRAY<STRING>", "ARRAY<VOID>"))
    # An empty list has type ARRAY<VOID>; so does a list of nulls, told apart by its text.
    nulls = F.exists(F.map_values(fields), lambda v: v.rlike(r"^\[\s*null"))
    is_object = kind.startswith("OBJECT") & ~F.coalesce(nulls, F.lit(False))
    return given & ~F.coalesce(is_object & fine, F.lit(False))


def normalize(df: DataFrame, limits: Limits, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Canonical samples; an out-of-range value stays and its flag becomes anomalous."""
    modern = any(c in df.columns for c in PROGRESS_COLUMNS)
    percent = S.opt_float(_text(df, "track_position"))
    rows = df.select(
        *keys,
        S.opt_float(_text(df, "frame")).cast("long").alias("frame"),
        S.opt_float(_text(df, "time")).alias("time_s"),
        S.opt_int(_text(df, "lap_number")).alias("lap_number"),
        S.lap_time_seconds(_text(df, "lap_time")).alias("lap_time_s"),
        (S.opt_float(_text(df, "s_fused")) if modern else percent / 100.0).alias("s"),
        S.opt_float(_text(df, "speed")).alias("speed_kmh"),
        S.opt_int(_text(df, "gear")).alias("gear"),
        S.opt_float(_text(df, "throttle")).alias("throttle_pct"),
        S.opt_float(_text(df, "brake")).alias("brake_pct"),
        S.opt_float(_text(df, "steering")).alias("steering"),
        S.opt_bool(_text(df, "tc_active")).alias("tc_active"),
        S.opt_bool(_text(df, "abs_active")).alias("abs_active"),
        S.quality_hints(_text(df, "quality_hint")).alias("_hints"),
        parse_field_reasons(_text(df, "field_reasons")).alias("field_reasons"),
        S.opt_float(_text(df, "s_odometry")).alias("s_odometry"),
        S.opt_float(_text(df, "s_visual")).alias("s_visual"),
        S.opt_float(_text(df, "s_uncertainty")).alias("s_uncertainty"),
        F.when(~S.blank(_text(df, "s_source")), F.trim(_text(df, "s_source"))).alias("s_source"),
        S.parse_reasons(_text(df, "s_reasons")).alias("s_reasons"),
    )
    fields = (
        "lap_number", "lap_time_s", "s", "speed_kmh", "gear", "throttle_pct", "brake_pct",
        "steering", "tc_active", "abs_active",
    )
    ranges = {
        "speed_kmh": (limits.speed_min, limits.speed_max),
        "s": (0, 1),
        "throttle_pct": (limits.pedal_min, limits.pedal_max),
        "brake_pct": (limits.pedal_min, limits.pedal_max),
        "steering": (-1, 1),
    }
    outside = {
        f: F.coalesce(~F.col(f).between(lo, hi) | F.isnan(f), F.lit(False))
        for f, (lo, hi) in ranges.items()
    }
    flags = []
    for field in fields:
        base = F.when(F.col(field).isNull(), "missing").otherwise("observed")
        flag = F.coalesce(F.col("_hints")[field], base)
        if field == "s":
            flag = F.coalesce(F.col("s_source"), flag)
        if field in outside:
            flag = F.when(outside[field], "anomalous").otherwise(flag)
        flags += [F.lit(field), flag]
    others = F.map_filter(F.col("_hints"), lambda k, _: ~k.isin(*fields))
    anomalies = [
        F.when(outside[f], F.lit(f"{f} outside [{lo:g}, {hi:g}]")) for f, (lo, hi) in ranges.items()
    ]
    return rows.withColumns(
        {
            "field_quality": F.map_concat(F.create_map(*flags), others),
            "anomalies": F.array_compact(F.array(*anomalies)),
        }
    ).drop("_hints")


def last_observed_time(df: DataFrame, axis: Axis, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """The newest time at which the field was observed; an own value wins."""
    seen = F.when(F.col("quality") == "observed", F.col("time_s"))
    rows = scan(df, axis.within(*by), _seen=Last(seen))
    own = F.col("last_observed_time_s") if "last_observed_time_s" in df.columns else F.lit(None)
    return rows.withColumn("last_observed_time_s", F.coalesce(own, F.col("_seen"))).drop("_seen")


def pack_quality(df: DataFrame) -> DataFrame:
    """Maps and arrays of a sample as the packed text columns of the flat record."""
    return df.withColumns(
        {
            "quality_hint": S.pack_hints(F.col("field_quality")),
            "field_reasons": F.to_json("field_reasons"),
            "s_reasons": F.array_join("s_reasons", ";"),
        }
    ).drop("field_quality")


def segment_relative_time(df: DataFrame, axis: Axis, segment: str) -> DataFrame:
    """Time since the first row of the segment."""
    along = axis.within(segment)
    rows = scan(df, along, _p=Lag(F.lit(True)))
    rows = scan(rows, along, _t0=Last(F.when(F.col("_p").isNull(), F.col("time_s"))))
    return rows.withColumn("segment_time_s", F.col("time_s") - F.col("_t0")).drop("_p", "_t0")


def json_clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in floating})
