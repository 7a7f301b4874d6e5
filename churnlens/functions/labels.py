"""Map-only label expressions: churn flag, age band, utilization band, RFM segment."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions import fixed


def churned_flag(attrition_flag: Column | str = "attrition_flag") -> Column:
    """1 for an attrited customer, else 0 (NULL flag counts as 0)."""
    c = F.col(attrition_flag) if isinstance(attrition_flag, str) else attrition_flag
    return F.when(c == F.lit(fixed.ATTRITED), F.lit(1)).otherwise(F.lit(0))


def _bands(value: Column, bands, cast) -> Column:
    expr = None
    for label, lo, hi in bands:
        cond = value.between(cast(lo), cast(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr  # no otherwise(): out-of-band and NULL values give NULL


def age_group(age: Column | str = "customer_age") -> Column:
    c = F.col(age) if isinstance(age, str) else age
    return _bands(c, fixed.AGE_BANDS, lambda v: F.lit(v))


def utilization_category(ratio: Column | str = "avg_utilization_ratio") -> Column:
    c = F.col(ratio) if isinstance(ratio, str) else ratio
    return _bands(c, fixed.UTILIZATION_BANDS, lambda v: F.lit(Decimal(v)))


def segment_label(r: Column | str = "r", fm: Column | str = "fm") -> Column:
    """RFM segment of a (r, fm) cell; a literal-map lookup, no shuffle."""
    rc = F.col(r) if isinstance(r, str) else r
    fc = F.col(fm) if isinstance(fm, str) else fm
    pairs = []
    for cr, cf, label in fixed.segment_cells():
        pairs += [F.lit(cr * 10 + cf), F.lit(label)]
    grid = F.create_map(*pairs)
    return grid[(rc * 10 + fc).cast("int")]


def combined_fm(f: Column | str = "f", m: Column | str = "m") -> Column:
    """``(f + m) / 2`` with integer division, as the analysis computes it."""
    from churnlens.functions.exact import idiv
    fc = F.col(f) if isinstance(f, str) else f
    mc = F.col(m) if isinstance(m, str) else m
    return idiv(fc + mc, F.lit(2)).cast("int")
