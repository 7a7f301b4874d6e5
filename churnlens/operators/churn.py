"""Churn KPIs and churn rates by any dimensions and filter.

All of these are one partial/final aggregate; rates use the exact integer
rounding of :mod:`churnlens.functions.exact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions import fixed
from churnlens.functions.exact import fixed2_text, fraction, idiv, percent, rounded_scaled, unscaled_sum
from churnlens.functions.labels import churned_flag


def _attrited() -> Column:
    return F.col("attrition_flag") == F.lit(fixed.ATTRITED)


def _spend(df: DataFrame, months: int) -> tuple[Column, Column]:
    """(aggregate, hundredths of millions) of SUM(total_trans_amt) / months / 1,000,000.

    Follows the column's type as SQL does: the sum of an INTEGER column is an integer and its quotients
    are cut off; the sum of a BIGINT or decimal column is numeric and the quotient is rounded."""
    dtype = df.schema["total_trans_amt"].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.sum("total_trans_amt"), idiv(idiv(F.col("s"), F.lit(months)), F.lit(1000000)) * 100
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    return unscaled_sum(F.col("total_trans_amt"), scale), rounded_scaled(F.col("s"), F.lit(months * 1000000 * 10 ** scale).cast("bigint"))


def kpi_text(df: DataFrame) -> DataFrame:
    """Headline KPIs formatted as text ('1.50K', '$3.76M', ...).

    Spend follows the type of its column; transactions are integers, so their months are cut off."""
    total, spend = _spend(df, 1)
    agg = df.agg(F.count("clietnum").alias("c"), total.alias("s"), F.sum("total_trans_ct").alias("t"))
    return agg.select(
        F.concat(fixed2_text(rounded_scaled(F.col("c"), F.lit(1000))), F.lit("K")).alias("total_customers"),
        F.concat(F.lit("$"), fixed2_text(spend), F.lit("M")).alias("total_spend"),
        F.concat(F.lit("$"), fixed2_text(_spend(df, 12)[1]), F.lit("M")).alias("total_monthly_spend"),
        F.concat(fixed2_text(rounded_scaled(idiv(F.col("t"), F.lit(12)), F.lit(1000))), F.lit("K"))
         .alias("total_monthly_transactions"),
    )


def kpi_numeric(df: DataFrame) -> DataFrame:
    """Headline KPIs as numbers, plus the percentage of churned customers."""
    total, spend = _spend(df, 1)
    agg = df.agg(F.count("clietnum").alias("c"), total.alias("s"),
                 F.sum("total_trans_ct").alias("t"), F.count(F.lit(1)).alias("n"),
                 F.count(F.when(_attrited(), F.lit(1))).alias("k"))
    return agg.select(
        (rounded_scaled(F.col("c"), F.lit(1000)).cast("double") / 100).alias("total_customers"),
        (spend.cast("double") / 100).alias("total_spend"),
        (rounded_scaled(idiv(F.col("t"), F.lit(12)), F.lit(1000)).cast("double") / 100)
        .alias("total_trans_mth"),
        percent(F.col("k"), F.col("n")).alias("pct_cust_churned"),
    )


def overall_churn(df: DataFrame) -> DataFrame:
    """Churned count, total count (named total_existing), churn percentage."""
    agg = df.agg(F.sum(churned_flag()).alias("total_churned"),
                 F.sum(F.lit(1)).alias("total_existing"))
    return agg.select("total_churned", "total_existing",
                      percent(F.col("total_churned"), F.col("total_existing"))
                      .alias("overall_churn_rate"))


def churn_rate_by(df: DataFrame, dims, predicate: Column | None = None) -> DataFrame:
    """Per group of ``dims`` (after ``predicate``): total, churned and churn rate (a fraction)."""
    src = df if predicate is None else df.filter(predicate)
    return (src.groupBy(*dims)
            .agg(F.count(F.lit(1)).alias("total_customers"),
                 F.sum(churned_flag()).cast("bigint").alias("churned_customers"))
            .withColumn("churn_rate", fraction(F.col("churned_customers"), F.col("total_customers"))))


# FIXED VALUES: the five churn-rate cuts of the exploratory analysis
# (dimensions, then the row filter as inclusive BETWEEN bounds).
CHURN_CUTS = {
    "churn_by_demographics": (("gender", "income_category", "marital_status"),
                              (("customer_age", 41, 55),)),
    "churn_by_low_spend": (("months_on_book", "total_relationship_count"),
                           (("total_trans_amt", 510, 5630),)),
    "churn_by_relationship": (("months_on_book", "months_inactive"),
                              (("total_relationship_count", 3, 4),)),
    "churn_by_tenure": (("total_relationship_count", "months_inactive"),
                        (("months_on_book", 27, 41), ("total_trans_amt", 510, 5630),
                         ("total_trans_ct", 30, 90))),
    "churn_by_utilization": (("gender", "income_category"),
                             (("avg_utilization_ratio", "0.000", "0.30"), ("customer_age", 40, 55))),
}


def between_all(bounds) -> Column:
    from decimal import Decimal
    cond = None
    for col, lo, hi in bounds:
        conv = (lambda v: F.lit(Decimal(v))) if isinstance(lo, str) else F.lit
        c = F.col(col).between(conv(lo), conv(hi))
        cond = c if cond is None else cond & c
    return cond


def churn_cut(df: DataFrame, name: str) -> DataFrame:
    dims, bounds = CHURN_CUTS[name]
    return churn_rate_by(df, dims, between_all(bounds)).orderBy(F.col("total_customers").desc_nulls_first())
