"""Reading and writing of session tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.channel import finite
from gapwise.functions import scalars as S
from gapwise.operators import checks
from gapwise.operators.normalize import Limits, normalize
from gapwise.schema import (
    ANNOTATIONS, LEGACY_COLUMNS, LITERAL_COLUMNS, MANIFEST, MODERN_COLUMNS, OBSERVATION_LINE,
    SAMPLE_LINE,
)

SCHEMA_VERSION = "telemetry-v2"


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below a path by the column names in their first line.

    A header is the line that names the frame beside known columns only, so a filter finds it
    wherever a file is split.  One row per file comes to the driver, which lists files anyway.
    """
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.translate(c, '"\r', "")))
    lines = spark.read.text(path).select(cells.alias("names"), F.col("_metadata.file_path").alias("file"))
    heads = lines.filter(F.array_contains("names", "frame") & F.array_contains("names", "time")).distinct()
    found: dict[tuple[str, ...], list[str]] = {}
    for row in heads.collect():
        found.setdefault(tuple(row.names), []).append(row.file)
    return found


def _typed(n: str, known: bool, extra: tuple[str, ...]) -> Column:
    value = F.col(f"`{n}`") if known else F.lit(None).cast("string")
    if n in extra:
        return value.alias(n)
    if n in LITERAL_COLUMNS:
        return F.coalesce(value, F.lit("")).alias(n)
    if n == "lap_time":
        return F.when(~S.blank(value), value).alias(n)
    if n == "frame":
        return S.opt_float(value).cast("long").alias(n)
    return (S.opt_int(value) if n in ("lap_number", "gear", "raw_lap_number") else S.opt_float(value)).alias(n)


def read_csv_records(spark: SparkSession, path: str, extra: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Flat records of any mix of files: each file's columns are found by the names in its header.

    Literal columns stay text as written, numbers are cast, blank is null.  A column that a file
    does not have is null there, a literal one is empty; columns nobody knows are left out.
    """
    names = (*extra, *LEGACY_COLUMNS, *MODERN_COLUMNS)
    empty = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parts = [spark.createDataFrame([], empty).select(*(_typed(n, True, extra) for n in names))]
    for header, files in sorted(csv_headers(spark, path).items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
        raw = spark.read.schema(schema).option("enforceSchema", False).option("escape", '"').csv(files, header=True)
        parts.append(raw.select(*(_typed(n, n in header, extra) for n in names)))
    return reduce(DataFrame.unionByName, parts)


def read_legacy_samples(spark: SparkSession, path: str, limits: Limits | None) -> DataFrame:
    """Canonical samples from flat records; the limits must be given."""
    if limits is None:
        raise ValueError("flat records need explicit limits")
    return normalize(read_csv_records(spark, path), limits)


def read_session(spark: SparkSession, path: str, *, limits: Limits | None = None) -> dict[str, DataFrame]:
    """``manifest``, ``samples``, ``observations`` and ``violations`` of session folders, or of flat records.

    A path that ends in ``.csv`` is the legacy form: samples by the given limits, no observations, and
    manifests of the version "legacy".  Else the folder holds ``manifest.json``, ``samples.jsonl`` and
    ``observations.jsonl``, each a file or a folder of files.
    """
    if path.rstrip("/").lower().endswith(".csv"):
        samples = read_legacy_samples(spark, path, limits)
        manifest = samples.groupBy("session_id").agg(F.lit("legacy").alias("schema_version"), F.count(F.lit(1)).alias("frame_count"))
        return {"manifest": manifest, "samples": samples, "observations": None, "violations": None}
    manifest, laps, unsupported = read_manifest(spark, f"{path}/manifest.json")
    lines = read_sample_lines(spark, f"{path}/samples.jsonl")
    seen = read_observation_lines(spark, f"{path}/observations.jsonl")
    expected = manifest.select(
        F.col("session_id"), "schema_version", F.col("session_id").alias("source_id"), "source_sha256", "profile", "start_s", "frame_count"
    )
    own = F.col("source_id").alias("session_id")
    lines, seen = lines.select(own, "*"), seen.select(own, "*")
    found = checks.check_envelope(lines, ("session_id",), expected)
    found = found.unionByName(checks.check_observation_envelope(seen, ("session_id",), expected))
    found = found.unionByName(checks.check_row_counts(lines, seen, expected, ("session_id",)))
    return {
        "manifest": manifest,
        "laps": laps,
        "samples": lines.select("session_id", "source_time_s", "sample.*"),
        "observations": _long_observations(seen),
        "violations": found.unionByName(unsupported),
    }


def read_samples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Sample lines: the envelope's identity beside the fields of the sample."""
    lines = spark.read.schema(SAMPLE_LINE).option("allowNonNumericNumbers", False).json(path)
    return lines.select(F.col("source_id").alias("session_id"), "source_time_s", "sample.*")


def read_sample_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_LINE).option("allowNonNumericNumbers", False).json(path)


def read_observation_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION_LINE).option("allowNonNumericNumbers", False).json(path)


def _long_observations(lines: DataFrame) -> DataFrame:
    rows = lines.select(
        F.col("source_id").alias("session_id"),
        "frame",
        "time_s",
        F.explode("observations").alias("field", "o"),
    )
    return rows.select("session_id", "frame", "time_s", "field", "o.*")


def read_observations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Observation lines in long form: one row per frame and field."""
    return _long_observations(read_observation_lines(spark, path))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests, their lap transitions in long form, and those of an unknown version.

    One document per line, or one per file.
    """
    documents = spark.read.schema(MANIFEST).json(path)
    good = documents.filter(F.col("schema_version") == SCHEMA_VERSION)
    head = good.select(
        F.col("source_id").alias("session_id"), "schema_version", "profile", "frame_count",
        F.col("source.sha256").alias("source_sha256"),
        F.col("source.size_bytes").alias("source_size_bytes"),
        F.col("clip_origin.start_s").alias("start_s"),
    )
    laps = good.select(F.col("source_id").alias("session_id"), F.inline("lap_transitions"))
    known = F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False))
    bad = documents.filter(~known).select(
        F.col("source_id").alias("session_id"),
        F.lit("unsupported_schema_version").alias("rule"),
        F.col("schema_version").alias("key"),
    )
    return head, laps, bad


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Annotation documents as tables: frames, passages, windows, visibility, target segments and lap reviews.

    One document per line, or one (indented or not) per file in a folder of ``.json`` files.
    """
    reader = spark.read.schema(ANNOTATIONS)
    documents = reader.option("multiLine", path.rstrip("/").endswith(".json") or "*" in path).json(path)
    source = F.col("source_sha256").alias("session_id")
    parts = {
        part: documents.select(source, F.inline(part))
        for part in ("frames", "passages", "windows", "visibility", "evaluation_segments")
    }
    review = documents.filter(F.col("lap_review").isNotNull())
    return parts | {"lap_review": review.select(source, "lap_review.*")}


def with_envelope(
    df: DataFrame, schema_version: str, profile: str, start_s, source: str = "session_id"
) -> DataFrame:
    """Identity columns and the time in the source: clip start plus relative time."""
    start = F.col(start_s) if isinstance(start_s, str) else F.lit(float(start_s))
    return df.withColumns(
        {
            "schema_version": F.lit(schema_version),
            "source_id": F.col(source).cast("string"),
            "profile": F.lit(profile),
            "source_time_s": start + F.col("time_s"),
        }
    )


def _holds_non_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value, or anything inside it, is NaN or an infinity; ``None`` where none can be."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~finite(value)
    if isinstance(kind, T.StructType):
        inner = [_holds_non_finite(value.getField(f.name), f.dataType) for f in kind.fields]
        inner = [c for c in inner if c is not None]
        return F.coalesce(reduce(or_, inner), F.lit(False)) if inner else None
    if isinstance(kind, T.ArrayType):
        if _holds_non_finite(value, kind.elementType) is None:
            return None
        return F.coalesce(F.exists(value, lambda x: _holds_non_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        parts = ((F.map_keys(value), kind.keyType), (F.map_values(value), kind.valueType))
        inner = [_holds_non_finite(v, T.ArrayType(t)) for v, t in parts]
        inner = [c for c in inner if c is not None]
        return reduce(or_, inner) if inner else None
    return None


def non_finite_rows(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with NaN or an infinity in a column, also deep inside it, one row per column."""
    found = [(f.name, _holds_non_finite(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    items = F.array(
        *[F.when(bad, F.lit(name)) for name, bad in found if bad is not None]
        or [F.lit(None).cast("string")]
    )
    rows = df.select(*keys, F.explode(F.array_compact(items)).alias("key"))
    return rows.withColumn("rule", F.lit("not_finite"))


def write_session(
    df: DataFrame, destination: str, *, form: str = "parquet", by: tuple[str, ...] = ("session_id",)
) -> None:
    """Write a new session table; never replaces one and refuses NaN and infinities.

    ``by`` become folders.  With very many sessions pass a coarser column.
    """
    if form not in ("parquet", "json", "csv"):
        raise ValueError(f"unsupported form: {form}")
    if non_finite_rows(df, ()).limit(1).count():
        raise ValueError("non-finite numbers cannot be written")
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    if form == "json":
        writer = writer.option("ignoreNullFields", False)
    if by:
        writer = writer.partitionBy(*by)
    writer.format(form).save(destination)
