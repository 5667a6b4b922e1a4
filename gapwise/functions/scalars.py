"""Column functions on text, numbers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapwise.schema import QUALITY

# Limits and patterns of the readings.
SPEED_RANGE = (0, 400)
LAP_RANGE = (0, 999)
GEARS = ("1", "2", "3", "4", "5", "6")
GEAR_SYMBOLS = ("N", "R")
LAP_TIME_RANGE_S = (20.0, 600.0)
LAP_TIME_PATTERN = r"(\d{1,2}):(\d{2})\.(\d{1,3})"
STRICT_LAP_TIME_PATTERN = r"^(\d{2}):(\d{2})\.(\d{3})"


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text.cast("string")) == "")


def opt_float(text: Column) -> Column:
    """Blank is null; any other text must be a number (an ANSI cast fails on it)."""
    return F.when(~blank(text), F.trim(text.cast("string")).cast("double"))


def opt_int(text: Column) -> Column:
    """Blank is null; a fraction is cut off towards zero."""
    return opt_float(text).cast("int")


def opt_bool(text: Column) -> Column:
    return opt_int(text) != 0


def lap_time_seconds(text: Column) -> Column:
    """``minutes:seconds`` or plain seconds; blank is null."""
    trimmed = F.trim(text)
    parts = F.split(trimmed, ":", 2)
    clock = F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("double")
    return F.when(blank(text), F.lit(None)).when(
        trimmed.contains(":"), clock
    ).otherwise(trimmed.cast("double"))


def extract_lap_time(text: Column) -> Column:
    """The first clock reading in a text as ``MM:SS.mmm``, if it lasts a plausible time."""
    minutes, seconds, millis = (F.regexp_extract(text, LAP_TIME_PATTERN, i) for i in (1, 2, 3))
    padded = F.rpad(millis, 3, "0")
    total = minutes.try_cast("int") * 60 + seconds.try_cast("int")
    total = total + padded.try_cast("int") / 1000
    shown = F.concat(F.lpad(minutes, 2, "0"), F.lit(":"), seconds, F.lit("."), padded)
    return F.when((minutes != "") & total.between(*LAP_TIME_RANGE_S), shown)


def strict_lap_time_seconds(text: Column) -> Column:
    """Seconds of a text that begins with ``MM:SS.mmm``; anything else is null."""
    minutes, seconds, millis = (
        F.regexp_extract(text, STRICT_LAP_TIME_PATTERN, i).try_cast("int") for i in (1, 2, 3)
    )
    return minutes * 60 + seconds + millis / 1000.0


def _hint_items(text: Column) -> Column:
    items = F.when(~blank(text), F.split(text, ";")).otherwise(F.array().cast("array<string>"))
    return F.transform(items, lambda item: F.split(item, ":", 2))


def quality_hints(text: Column) -> Column:
    """``field:flag;...`` as a map; a later item replaces an earlier one."""
    pairs = F.filter(_hint_items(text), lambda p: F.size(p) == 2)
    names = F.transform(pairs, lambda p: F.trim(p[0]))
    flags = F.transform(pairs, lambda p: F.trim(p[1]))
    # Duplicate keys are an error for map builders, so take each name's last place.
    unique = F.array_distinct(names)
    last = F.transform(
        unique,
        lambda n: F.get(
            flags, F.size(flags) - F.array_position(F.reverse(names), n).cast("int")
        ),
    )
    return F.map_from_arrays(unique, last)


def hint_problem(text: Column) -> Column:
    """Why a quality hint is not acceptable, or null."""
    items = _hint_items(text)
    flags = [F.lit(q) for q in QUALITY]
    return F.when(
        F.exists(items, lambda p: F.size(p) != 2), F.lit("hint_without_separator")
    ).when(
        F.exists(items, lambda p: ~F.trim(F.get(p, F.lit(1))).isin(*flags)),
        F.lit("unknown_quality_flag"),
    )


def parse_reasons(text: Column) -> Column:
    """``a;b`` as an array without blanks."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _reading(value: Column, quality: Column, raw: Column, reason: Column) -> Column:
    return F.struct(
        value.alias("value"),
        quality.alias("quality"),
        raw.alias("raw_value"),
        F.array_compact(F.array(reason)).alias("reasons"),
    )


def classify_speed_text(raw: Column) -> Column:
    """A speed reading from literal text; refused text is kept beside the reason."""
    text = F.trim(raw)
    digits = F.coalesce(text.rlike("^[0-9]+$"), F.lit(False))
    number = F.when(digits, text).try_cast("decimal(38,0)")
    inside = F.coalesce(number.between(*SPEED_RANGE), F.lit(False))
    quality = F.when(blank(raw), "missing").when(inside, "observed").otherwise("anomalous")
    reason = (
        F.when(blank(raw), "speed_ocr_missing")
        .when(~digits, "speed_ocr_invalid")
        .when(~inside, "speed_out_of_range")
    )
    return _reading(F.when(inside, number.cast("int")), quality, raw, reason)


def classify_gear_text(raw: Column) -> Column:
    known = F.coalesce(raw.isin(*GEARS), F.lit(False))
    value = F.when(known, raw).try_cast("int")
    reason = (
        F.when(known, F.lit(None))
        .when(raw.isin(*GEAR_SYMBOLS), "unsupported_gear_symbol")
        .when(raw.isNull() | (raw == ""), "gear_ocr_missing")
        .otherwise("gear_ocr_invalid")
    )
    return _reading(value, F.when(known, "observed").otherwise("missing"), raw, reason)


def classify_lap_text(raw: Column) -> Column:
    text = F.trim(raw)
    number = F.when(text.rlike("^[0-9]+$"), text).try_cast("decimal(38,0)")
    inside = F.coalesce(number.between(*LAP_RANGE), F.lit(False))
    reason = (
        F.when(inside, F.lit(None))
        .when(blank(raw), "lap_ocr_missing")
        .otherwise("lap_ocr_invalid")
    )
    value = F.when(inside, number.cast("int"))
    return _reading(value, F.when(inside, "observed").otherwise("missing"), raw, reason)


def salvage_digits(raw: Column, low: int, high: int) -> Column:
    """All digits of a text as one number, if it lies in the range."""
    number = F.regexp_replace(raw, "[^0-9]", "").try_cast("decimal(38,0)")
    return F.when(number.between(low, high), number.cast("int"))


def wrapped_delta(value: Column, reference: Column) -> Column:
    """Circular difference of normalized positions in (-0.5, 0.5]."""
    turn = F.pmod(value - reference, F.lit(1.0))
    return F.when(turn > 0.5, turn - 1.0).otherwise(turn)


def pack_hints(quality: Column) -> Column:
    """A quality map as ``field:flag;...`` in field order."""
    entries = F.array_sort(F.map_entries(quality))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
