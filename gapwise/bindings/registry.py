"""Registered queries: a Spark function on a data folder, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Both engines round a tie their own way; a tiny shift moves short decimals off the ties.
SHIFT = 3e-10


def presentable(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits and string arrays joined, for comparison by value."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column + F.lit(SHIFT), DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ";")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def register(name: str, sql: str | None = None, rounded: str = ""):
    """Register ``function(views) -> DataFrame``; ``rounded`` names the double columns of the SQL."""

    def keep(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from gapwise.bindings.views import Views

            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return presentable(function(Views(spark, folder)))

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = [f"round({c} + {SHIFT}, {DIGITS}) + 0.0 AS {c}" for c in rounded.split()]
            head = f"SELECT * REPLACE ({', '.join(parts)})" if parts else "SELECT *"
            # ``--`` on its own line parts the common table expressions from the result.
            with_part, _, body = sql.rpartition("\n--\n")
            ORACLES[name] = f"{with_part}\n{head} FROM (\n{body.strip()}\n) AS result"
        return function

    return keep
