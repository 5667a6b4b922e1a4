"""How a measured field is read: its value, its quality flag and its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """True only for a non-null number that is neither NaN nor infinite."""
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.coalesce(number.isNotNull() & ~bad, F.lit(False))


@dataclass(frozen=True)
class Channel:
    """Column names (or expressions) of one field; without a quality it is always observed."""

    field: str
    value: str | Column
    quality: str | Column | None = None
    reasons: str | Column | None = None

    @staticmethod
    def _read(part) -> Column:
        return F.col(part) if isinstance(part, str) else part

    def flag(self) -> Column:
        return F.lit("observed") if self.quality is None else self._read(self.quality)

    def v(self) -> Column:
        return self._read(self.value)

    def fresh(self) -> Column:
        """Observed, present and finite."""
        observed = F.coalesce(self.flag() == "observed", F.lit(False))
        return observed & finite(self.v())

    def valid(self, low: float = 0.0, high: float = 100.0) -> Column:
        """Fresh and inside the closed range."""
        return self.fresh() & F.coalesce(self.v().between(low, high), F.lit(False))

    def why(self) -> Column:
        if self.reasons is None:
            return F.array().cast("array<string>")
        return F.coalesce(self._read(self.reasons), F.array().cast("array<string>"))

    @classmethod
    def of_sample(cls, field: str) -> Channel:
        """A field of the canonical sample table."""
        return cls(
            field,
            F.col(field),
            F.col("field_quality")[field],
            F.col("field_reasons")[field],
        )
