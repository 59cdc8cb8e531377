"""Numeric expressions with the exact rounding/clamping rules required."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, digits: int = 2) -> Column:
    """numpy-style ``round(x, d)``: ``rint(x * 10^d) / 10^d``.

    Spark's ``round``/``bround`` work on the decimal text of the double and
    disagree with numpy on values such as 0.575; ``rint`` matches it.
    """
    scale = float(10 ** digits)
    return F.rint(_c(x) * scale) / scale


def round6(x) -> Column:
    """Stable 6-digit form for double results whose last bits depend on order."""
    return F.round(_c(x), 6)
