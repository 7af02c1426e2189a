"""Plain-language formatting as column expressions (used inside the findings).

Money rounds half away from zero (decimal HALF_UP), ``$1.5M`` above a million,
``$13k`` from ten thousand, whole dollars below. Ordinals follow English
(11th-13th are ``th``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _half_up(x: Column, places: int) -> Column:
    # decimal rounding in Spark is HALF_UP, i.e. half away from zero for negatives too
    return F.round(x.cast("decimal(38,10)"), places)


def money_text(x) -> Column:
    v = _c(x).cast("double")
    mag = F.abs(v)
    millions = F.concat(F.lit("$"), F.format_number(_half_up(v / 1_000_000, 1), 1), F.lit("M"))
    thousands = F.concat(F.lit("$"), F.format_number(_half_up(v / 1_000, 0), 0), F.lit("k"))
    units = F.concat(F.lit("$"), F.format_number(_half_up(v, 0), 0))
    return (F.when(v.isNull(), F.lit(None))
            .when(mag >= 1_000_000, millions)
            .when(mag >= 10_000, thousands)
            .otherwise(units))


def ordinal_text(n) -> Column:
    n = _c(n).cast("long")
    suffix = (F.when((n % 100 >= 10) & (n % 100 <= 20), F.lit("th"))
              .when(n % 10 == 1, F.lit("st"))
              .when(n % 10 == 2, F.lit("nd"))
              .when(n % 10 == 3, F.lit("rd"))
              .otherwise(F.lit("th")))
    return F.concat(n.cast("string"), suffix)


def plural_text(n, singular: str, plural: str | None = None) -> Column:
    return F.when(F.round(_c(n).cast("double"), 0) == 1, F.lit(singular)).otherwise(
        F.lit(plural or singular + "s"))


def percent_text(x, places: int = 0) -> Column:
    """``{x:.0%}`` equivalent: the share times 100, rounded half-to-even on the
    binary value as Python's format does."""
    return F.concat(F.format_number(_c(x).cast("double") * 100, places), F.lit("%"))
