"""Exact rounding for rates, averages and scaled values.

The analysis rounds exact numeric quotients half away from zero. Doing that
on doubles differs between engines (``round(1.005, 2)``), and a decimal
division followed by ``round`` rounds twice. Here every rounded quotient is
computed on integers: ``h = (2*m*|num| + den) div (2*den)`` is the quotient
scaled by ``m = 10**digits`` and rounded half up, and the result is
``h / m`` as a double, i.e. the double nearest to the exact rounded decimal.

``num`` must be integral (integer, or decimal with scale 0) and ``den`` a
positive integer; a zero or NULL denominator gives NULL instead of an error.
All helpers build JVM-side expressions; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    """Column as is, a str as a column name, anything else as a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def idiv(a, b) -> Column:
    """SQL integral division ``a div b`` (long result, truncates toward 0)."""
    return F.call_function("div", _c(a), _c(b))


def rounded_scaled(num, den, digits: int = 2) -> Column:
    """Exact ``round(num / den, digits) * 10**digits`` as a long."""
    num, den = _c(num), _c(den)
    m = 10 ** digits
    mag = idiv(F.lit(2 * m) * F.abs(num) + den, F.lit(2) * den)
    return F.when(den > 0, F.when(num < 0, -mag).otherwise(mag))


def rounded_quotient(num, den, digits: int = 2) -> Column:
    """Exact ``round(num / den, digits)`` as the nearest double."""
    return rounded_scaled(num, den, digits).cast("double") / F.lit(10 ** digits)


def percent(part, whole, digits: int = 2) -> Column:
    """``round(part / whole * 100, digits)``; NULL when ``whole`` is 0."""
    return rounded_quotient(_c(part) * F.lit(100), whole, digits)


def fraction(part, whole, digits: int = 2) -> Column:
    """``round(part / whole, digits)``; NULL when ``whole`` is 0."""
    return rounded_quotient(part, whole, digits)


def unscaled_sum(col: Column, scale: int) -> Column:
    """Exact ``sum(col) * 10**scale`` as decimal(38,0) (an aggregate)."""
    if scale == 0:
        return F.sum(col).cast("decimal(38,0)")
    return (F.sum(col) * F.lit(10 ** scale)).cast("decimal(38,0)")


def exact_avg(col: Column, scale: int, digits: int = 2) -> Column:
    """Exact ``round(avg(col), digits)`` as a double (an aggregate).

    ``scale`` is the decimal scale of ``col`` (0 for integers). NULLs are
    ignored as in ``AVG``; no non-NULL value gives NULL.
    """
    n = F.count(col)
    den = n * F.lit(10 ** scale) if scale else n
    return rounded_quotient(unscaled_sum(col, scale), den, digits)


def avg_of_scaled(scaled_values: Column, digits: int = 2) -> Column:
    """``round(avg(v), digits)`` where ``scaled_values`` = v * 10**digits as longs.

    Used to average values that were themselves already rounded to
    ``digits`` places (kept as exact integers).
    """
    return rounded_quotient(F.sum(scaled_values), F.count(scaled_values) * F.lit(10 ** digits), digits)


def round_double(x: Column, digits: int = 2) -> Column:
    """Half-up rounding of a double with plain IEEE steps (floor(x*m + 0.5)/m).

    Same operations in every engine, so the same double comes out.
    """
    m = float(10 ** digits)
    return F.floor(x * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def fixed2_text(scaled: Column) -> Column:
    """Text of a value given in hundredths, always with two decimals ('3.00')."""
    return (scaled.cast("double") / F.lit(100)).cast("decimal(38,2)").cast("string")
