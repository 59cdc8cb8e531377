"""Date/time parts (session time zone is pinned to UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import fixed_values as FV


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_ts(x) -> Column:
    """Lenient timestamp parse: strings that do not parse become NULL."""
    c = _c(x)
    return F.coalesce(F.try_to_timestamp(c.cast("string")), c.cast("string").try_cast("timestamp"))


def parse_text_date(x, formats: list[str] = FV.TEXT_DATE_FORMATS) -> Column:
    """Timestamp of a text date: the first format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(_c(x)), F.lit(f)) for f in formats])


def hour_of(x) -> Column:
    return F.hour(_c(x))


def weekday_name(x) -> Column:
    """Full English weekday name ("Monday")."""
    return F.date_format(_c(x), "EEEE")


def weekday_index(x) -> Column:
    """Monday = 0 … Sunday = 6 (calendar sort key)."""
    return F.weekday(_c(x))


def month_of(x) -> Column:
    return F.month(_c(x))
