"""Column profiling: previews, NULL scans, repeats, data dictionary, descriptive stats.

Every profile is one distributed aggregate (partial aggregation, then a
small final merge); exact medians come from :mod:`churnlens.operators.quantile`
instead of a value->count map per column, so they do not grow with the
number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.exact import exact_avg, rounded_quotient, round_double
from churnlens.operators.quantile import exact_medians, median_value

# The 14 numeric columns described in the cleaning analysis, in its order.
STAT_COLUMNS = (
    "customer_age", "dependent_count", "months_on_book", "total_relationship_count",
    "months_inactive", "contacts_count", "credit_limit", "total_revolving_bal",
    "avg_open_to_buy", "total_amt_change_q4_q1", "total_trans_amt", "total_trans_ct",
    "total_ct_change_q4_q1", "avg_utilization_ratio",
)

# Columns whose 3-sigma outliers the analysis calls out.
SIGMA_COLUMNS = (
    "customer_age", "months_inactive", "contacts_count", "total_amt_change_q4_q1",
    "total_trans_amt", "total_trans_ct", "total_ct_change_q4_q1",
)


def preview(df: DataFrame, n: int = 100, order_by: str = "clietnum") -> DataFrame:
    """First ``n`` rows by ``order_by`` (a distributed top-k, not a sort of everything)."""
    return df.orderBy(F.col(order_by).asc_nulls_last()).limit(n)


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """All rows where ``column`` is NULL (pushed to the scan as IsNull)."""
    return df.filter(F.col(column).isNull())


def key_quality(df: DataFrame, key: str = "clietnum") -> DataFrame:
    """One row: rows, distinct, NULL and repeated values of the key (its uniqueness, tested).

    The key is grouped first (partial aggregation absorbs a hot key), then its groups are counted."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(key).isNotNull()
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.when(known, F.lit(1))).alias("distinct_ids"),
                      F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("null_ids"),
                      F.coalesce(F.sum(F.when(known, F.col("_n") - 1)), F.lit(0)).alias("repeated_ids"))


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """One row: ``<col>_nulls`` for every column."""
    cols = list(columns or df.columns)
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.lit(0))).alias(f"{c}_nulls")
                    for c in cols])


def duplicate_values(df: DataFrame, column: str, count_name: str = "amount") -> DataFrame:
    """Values of ``column`` that occur more than once, with their counts (NULLs group together)."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
            .filter(F.col(count_name) > 1)
            .orderBy(F.col(count_name).desc_nulls_first()))


def sql_type_name(dt: T.DataType) -> str:
    """PostgreSQL-style type name, as a data dictionary lists it."""
    if isinstance(dt, T.LongType):
        return "bigint"
    if isinstance(dt, T.IntegerType):
        return "integer"
    if isinstance(dt, T.ShortType):
        return "smallint"
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, T.DecimalType):
        return f"numeric({dt.precision},{dt.scale})"
    if isinstance(dt, T.DoubleType):
        return "double precision"
    if isinstance(dt, T.FloatType):
        return "real"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return dt.simpleString()


def distinct_counts(df: DataFrame, columns=None) -> DataFrame:
    """(position, distinct_count): distinct non-NULL values of every column, position from 1.

    One unpivoted aggregate: each row gives a (position, value) pair per column, which are grouped where they are
    before they move, so a column of few values costs a task as many rows, and no hot value reaches one task; the
    groups of a position are then counted, again in part first. Values are compared as text, by which no two
    different values of a column are equal."""
    cols = list(columns or df.columns)
    pairs = [F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(cols, start=1)]
    values = df.select(F.inline(F.array(*pairs))).filter("v IS NOT NULL").groupBy("position", "v").agg(F.lit(1).alias("one"))
    return values.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))


def column_profile(df: DataFrame, table_name: str = "bank_churn") -> DataFrame:
    """Data dictionary: one row per column with its type, position, NULL / non-NULL and distinct counts.

    Names and types come from the schema (driver side, no data); the NULL counts
    are one aggregate over the table, unpivoted with ``inline``, the distinct counts another.
    """
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.col(f"`{f.name}`")).alias(f"__nn{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("column_name"),
                     F.lit(sql_type_name(f.dataType)).alias("data_type"),
                     F.lit(table_name).alias("table_name"),
                     F.lit(i + 1).alias("ordinal_position"),
                     F.col(f"__nn{i}").alias("non_null_count"),
                     (F.col("__rows") - F.col(f"__nn{i}")).alias("null_count"))
            for i, f in enumerate(fields)]
    listed = agg.select(F.inline(F.array(*rows)))
    found = distinct_counts(df).withColumnRenamed("position", "__position")
    return (listed.join(found, listed.ordinal_position == F.col("__position"), "left")
            .select(*listed.columns, F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count")))


def _scale(df: DataFrame, column: str) -> int:
    dt = df.schema[column].dataType
    return dt.scale if isinstance(dt, T.DecimalType) else 0


def column_stats(df: DataFrame, columns=STAT_COLUMNS, **tuning) -> DataFrame:
    """avg, median, sample stddev, min, max per column (long form, one row per column).

    avg: exact ``ROUND(AVG(c), 2)``; median: exact ``PERCENTILE_CONT(0.5)``;
    stddev: ``ROUND(STDDEV_SAMP(c), 2)`` (NULL for one row); all as doubles.
    """
    cols = list(columns)
    meds = exact_medians(df, cols, **tuning)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [exact_avg(x, _scale(df, c)).alias(f"a{i}"),
                 round_double(F.stddev_samp(x.cast("double"))).alias(f"s{i}"),
                 F.min(x).cast("double").alias(f"lo{i}"),
                 F.max(x).cast("double").alias(f"hi{i}")]
    agg = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"),
                     F.col(f"a{i}").alias("avg_value"),
                     F.lit(median_value(meds[c])).cast("double").alias("median_value"),
                     F.col(f"s{i}").alias("stddev_value"),
                     F.col(f"lo{i}").alias("min_value"),
                     F.col(f"hi{i}").alias("max_value"))
            for i, c in enumerate(cols)]
    return agg.select(F.inline(F.array(*rows)))


def sigma_outliers(df: DataFrame, columns=SIGMA_COLUMNS, n_sigma: float = 3.0,
                   key: str = "clietnum") -> DataFrame:
    """Rows whose value lies above mean + n_sigma * sample stddev, per column (long form).

    One aggregate gives the thresholds (two doubles per column); one more
    pass over the table emits (column, key, value) for rows above them.
    """
    cols = list(columns)
    stats = df.agg(*[e for i, c in enumerate(cols)
                     for e in (F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                               F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}"))]).collect()[0]
    hits = []
    for i, c in enumerate(cols):
        m, s = stats[f"m{i}"], stats[f"s{i}"]
        if m is None or s is None:
            continue
        thr = m + n_sigma * s
        v = F.col(c).cast("double")
        hits.append(F.when(v > F.lit(thr), F.struct(F.lit(c).alias("column_name"),
                                                    v.alias("value"))))
    schema_row = F.struct(F.lit("").alias("column_name"), F.lit(0.0).alias("value"))
    if not hits:
        return df.select(F.col(key), schema_row.alias("h")).filter(F.lit(False)) \
                 .select("h.column_name", key, "h.value")
    return (df.select(F.col(key), F.explode(F.array(*hits)).alias("h"))
            .filter(F.col("h").isNotNull())
            .select("h.column_name", key, "h.value"))


def value_spikes(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value of ``column``, the runner-up, and their count ratio (one row).

    Counting is a partial aggregate; only the two largest groups survive the
    distributed top-k, so nothing unbounded reaches one task.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top2 = counts.orderBy(F.col("n").desc(), F.col("v").asc_nulls_last()).limit(2)
    ranked = top2.withColumn("rk", F.row_number().over(
        Window.orderBy(F.col("n").desc(), F.col("v").asc_nulls_last())))
    out = ranked.agg(
        F.max(F.when(F.col("rk") == 1, F.col("v"))).alias("top_value"),
        F.max(F.when(F.col("rk") == 1, F.col("n"))).alias("top_count"),
        F.max(F.when(F.col("rk") == 2, F.col("v"))).alias("next_value"),
        F.max(F.when(F.col("rk") == 2, F.col("n"))).alias("next_count"),
    )
    return out.select(F.lit(column).alias("column_name"), "top_value", "top_count", "next_value",
                      "next_count",
                      rounded_quotient(F.col("top_count"), F.col("next_count")).alias("spike_ratio"))


__all__ = [
    "STAT_COLUMNS", "SIGMA_COLUMNS", "preview", "null_rows", "key_quality", "null_counts", "duplicate_values",
    "distinct_counts", "column_profile", "column_stats", "sigma_outliers", "value_spikes", "sql_type_name",
]
