"""Catalyst column expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens import schema


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nullif_zero(x) -> Column:
    """``NULLIF(x, 0)``: ANSI mode raises on x/0, so every divisor goes through this."""
    x = _c(x)
    return F.when(x != 0, x)


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``; null when the divisor is zero or null."""
    return _c(num) / nullif_zero(den)


def clean_number(x) -> Column:
    """Published-cell cleaner: trim, drop ``,`` and ``$``, suppression markers and
    unparsable text become null (never zero), ``NaN`` text becomes null."""
    raw = F.trim(_c(x).cast("string"))
    stripped = F.translate(raw, ",$", "")
    parsed = stripped.try_cast("double")
    return (
        F.when(raw.isNull() | raw.isin(*schema.SUPPRESSION_MARKERS), F.lit(None))
        .when(F.isnan(parsed), F.lit(None))
        .otherwise(parsed)
        .cast("double")
    )


def pick_percentile(percentile) -> Column:
    """Simple CASE over the five wage columns; an unknown label gives null."""
    p = _c(percentile) if not isinstance(percentile, str) or percentile not in \
        schema.PERCENTILE_TO_COLUMN else F.lit(percentile)
    expr = None
    for label, column in schema.PERCENTILE_TO_COLUMN.items():
        expr = (F.when(p == label, F.col(column)) if expr is None
                else expr.when(p == label, F.col(column)))
    return expr


def exact_sum(x) -> Column:
    """Sum in fixed point, independent of partitioning or merge order, converted once to
    double. Eighteen decimals keep every digit that a double of 0.01 or more prints; a total
    of 1e20 or more fails as an overflow (ANSI) rather than being cut."""
    return F.sum(_c(x).cast("decimal(38,18)")).cast("double")


def exact_mean(x) -> Column:
    """Mean whose sum is exact (see :func:`exact_sum`); one IEEE division."""
    return exact_sum(x) / F.count(_c(x)).cast("double")
