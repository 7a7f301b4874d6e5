"""Edge fixtures on the 21-column schema (FIXTURES.md section 5)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from churnlens.functions.exact import fraction, percent, rounded_quotient
from churnlens.functions.labels import age_group, segment_label, utilization_category
from churnlens.operators import churn, clean, profile, rfm
from churnlens.sources.bank_churn import SCHEMA


def make(spark, rows):
    """Rows given as dicts of overrides on a neutral customer."""
    base = {f.name: None for f in SCHEMA.fields}
    base.update(clietnum=1, attrition_flag="Existing Customer", customer_age=45, gender="F",
                months_inactive=3, total_trans_ct=50, total_trans_amt=4, credit_limit=Decimal("100.00"))
    out = []
    for i, r in enumerate(rows):
        d = dict(base, clietnum=i + 1)
        d.update(r)
        out.append(tuple(d[f.name] for f in SCHEMA.fields))
    return spark.createDataFrame(out, SCHEMA)


def test_empty_table_rates_are_null(spark):
    df = make(spark, [])
    r = churn.overall_churn(df).collect()[0]
    assert r.total_churned is None and r.overall_churn_rate is None
    k = churn.kpi_numeric(df).collect()[0]
    assert k.pct_cust_churned is None
    assert rfm.segment_churn(rfm.segments_frame(rfm.rfm_scores(df))).count() == 0


def test_one_row(spark):
    df = make(spark, [{}])
    stats = {r.column_name: r for r in profile.column_stats(df, ["customer_age"]).collect()}
    assert stats["customer_age"].stddev_value is None
    assert stats["customer_age"].median_value == 45.0
    scored = rfm.rfm_scores(df).collect()[0]
    assert (scored.r, scored.f, scored.m) == (1, 1, 1)


def test_trans_ct_boundary(spark):
    df = make(spark, [{"total_trans_ct": 133}, {"total_trans_ct": 134}, {"total_trans_ct": None}])
    kept, removed = clean.delete_where(df, F.col("total_trans_ct") > 133)
    assert [r.total_trans_ct for r in removed.collect()] == [134]
    assert kept.count() == 2  # NULL predicate keeps the row


def test_age_bands(spark):
    ages = [25, 26, 40, 41, 55, 56, 70, 71, 73, None]
    df = make(spark, [{"customer_age": a} for a in ages])
    got = [r.g for r in df.orderBy("clietnum").select(age_group().alias("g")).collect()]
    assert got == [None, "Younger", "Younger", "Middle Aged", "Middle Aged", "Older", "Older",
                   None, None, None]


def test_utilization_bands(spark):
    vals = ["0", ".333", ".334", ".667", ".668", ".999", "1.000", None]
    df = make(spark, [{"avg_utilization_ratio": Decimal(v) if v else None} for v in vals])
    got = [r.u for r in df.orderBy("clietnum").select(utilization_category().alias("u")).collect()]
    assert got == ["Low Use", "Low Use", "Medium Use", "Medium Use", "High Use", "High Use",
                   None, None]


def test_half_up_rounding(spark):
    df = spark.createDataFrame([(1, 8), (1, 200), (3, 8), (5, 1000), (-1, 8)], "k long, n long")
    got = df.select(fraction("k", "n").alias("f"), percent("k", "n").alias("p"),
                    rounded_quotient(F.col("k"), F.col("n"), 1).alias("q")).collect()
    assert [r.f for r in got] == [0.13, 0.01, 0.38, 0.01, -0.13]
    assert [r.p for r in got] == [12.5, 0.5, 37.5, 0.5, -12.5]
    assert got[0].q == 0.1


def test_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0)], "k long, n long")
    assert df.select(percent("k", "n").alias("p")).collect()[0].p is None


def test_every_grid_cell_labelled(spark):
    df = spark.createDataFrame([(r, fm) for r in range(1, 6) for fm in range(1, 6)], "r int, fm int")
    labels = [x.s for x in df.select(segment_label().alias("s")).collect()]
    assert None not in labels and len(set(labels)) == 11


def test_duplicate_and_null_keys_drop_in_attributes(spark):
    df = make(spark, [{}, {}, {"clietnum": None}])
    rows = rfm.rfm_attributes(rfm.rfm_scores(df)).collect()
    assert len(rows) == 2  # NULL id leaves, as in the join on the id


@pytest.mark.parametrize("n", [99, 100, 101])
def test_percentile_bucket_100_presence(spark, n):
    df = make(spark, [{"months_inactive": i} for i in range(n)])
    kept, removed = clean.trim_top_percentile(df, "months_inactive")
    assert removed.count() == (0 if n < 100 else 1)


def test_nulls_fill_top_bucket(spark):
    rows = [{"total_amt_change_q4_q1": None if i < 5 else Decimal(i)} for i in range(100)]
    df = make(spark, rows)
    kept, removed = clean.trim_top_percentile(df, "total_amt_change_q4_q1")
    assert removed.count() == 0  # bucket 100 holds only a NULL


@pytest.mark.parametrize("kind,total,month", [("int", "$3.00M", "$0.00M"), ("bigint", "$3.76M", "$0.31M"), ("decimal(14,2)", "$3.76M", "$0.31M")])
def test_spend_follows_the_column_type(spark, kind, total, month):
    df = make(spark, [{"total_trans_amt": 3757670}]).withColumn("total_trans_amt", F.col("total_trans_amt").cast(kind))
    r = churn.kpi_text(df).collect()[0]
    assert (r.total_spend, r.total_monthly_spend) == (total, month)


def test_custom_columns_and_bucket_count(spark):
    df = make(spark, [{"total_trans_amt": i, "total_revolving_bal": 12 * (10 - i)} for i in range(10)])
    segs = rfm.segments_frame(rfm.rfm_scores(df, monetary="total_revolving_bal"))
    assert sorted(r.monetary for r in segs.collect()) == [float(i) for i in range(1, 11)]
    with pytest.raises(ValueError):
        rfm.segments_frame(rfm.rfm_scores(df, k=10))


def test_row_filter_and_null_order(spark):
    df = make(spark, [{"gender": "M" if i % 2 else "F", "months_inactive": None if i < 3 else i} for i in range(10)])
    segs = rfm.segments_frame(rfm.rfm_scores(df))
    assert sum(r.total_segment for r in rfm.segment_churn(segs, F.col("gender") == "M").collect()) == 5
    got = [r.average_recency for r in rfm.rfm_averages(segs).collect()]
    assert got == sorted(got, key=lambda x: (x is not None, -(x or 0)))


def test_key_quality(spark):
    df = make(spark, [{"clietnum": 7}, {"clietnum": 7}, {"clietnum": None}, {"clietnum": None}, {}])
    r = profile.key_quality(df).collect()[0]
    assert (r.total_rows, r.distinct_ids, r.null_ids, r.repeated_ids) == (5, 2, 2, 1)
