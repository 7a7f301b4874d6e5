"""The one-row-per-customer ``bank_churn`` table.

The analysis runs on a 21-column customer table. The test data does not
contain it, so it is derived deterministically from ``customer``,
``nation``, ``region``, ``orders`` and ``lineitem`` (rules in FIXTURES.md
section 2). The derivation is two aggregations and a few joins:

* ``lineitem`` is pre-aggregated to one count per order (map-side partial
  aggregation), joined to ``orders`` on the order key, and everything per
  customer is computed in ONE ``groupBy(o_custkey)`` (partial aggregation
  absorbs a customer that owns a third of all orders);
* ``nation`` / ``region`` are tiny dimension tables; no broadcast hint is
  given, so Catalyst broadcasts them only under its size threshold;
* the customer side joins the per-customer aggregate on the customer key.

``bank_churn()`` materializes the result once per session as parquet in the
shared checkpoint folder (``spark.checkpoint.dir``), so every report reads
a short lineage with column pruning and filter pushdown, and a lost
executor only re-reads files.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions import fixed
from churnlens.functions.exact import idiv
from churnlens.session import scratch_path
from churnlens.sources.tables import read_table

TABLE = "bank_churn"
KEY = "clietnum"

SCHEMA = T.StructType([
    T.StructField("clietnum", T.LongType()),
    T.StructField("attrition_flag", T.StringType()),
    T.StructField("customer_age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("dependent_count", T.IntegerType()),
    T.StructField("education_level", T.StringType()),
    T.StructField("marital_status", T.StringType()),
    T.StructField("income_category", T.StringType()),
    T.StructField("card_category", T.StringType()),
    T.StructField("months_on_book", T.IntegerType()),
    T.StructField("total_relationship_count", T.IntegerType()),
    T.StructField("months_inactive", T.IntegerType()),
    T.StructField("contacts_count", T.IntegerType()),
    T.StructField("credit_limit", T.DecimalType(12, 2)),
    T.StructField("total_revolving_bal", T.IntegerType()),
    T.StructField("avg_open_to_buy", T.DecimalType(12, 2)),
    T.StructField("total_amt_change_q4_q1", T.DecimalType(10, 3)),
    T.StructField("total_trans_amt", T.LongType()),
    T.StructField("total_trans_ct", T.IntegerType()),
    T.StructField("total_ct_change_q4_q1", T.DecimalType(10, 3)),
    T.StructField("avg_utilization_ratio", T.DecimalType(5, 3)),
])
COLUMNS = tuple(f.name for f in SCHEMA.fields)

# FIXED VALUES of the derivation (FIXTURES.md section 2)
SNAPSHOT_MONTH = 2001 * 12 + 8
CHURN_BALANCE = 700          # c_acctbal below this -> attrited
CREDIT_BASE = 11000
REVOLVING_MOD = 2518
MARITAL_BY_KEY_MOD_3 = ("Married", "Single", "Unknown")
INCOME_BY_SEGMENT = {
    "AUTOMOBILE": "Less than $40K",
    "BUILDING": "$40K - $60K",
    "FURNITURE": "$60K - $80K",
    "HOUSEHOLD": "$80K - $120K",
}
INCOME_OTHER = "$120K +"


def _pick(index: F.Column, labels) -> F.Column:
    expr = None
    for i, label in enumerate(labels):
        cond = index == F.lit(i)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def per_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ``o_custkey`` with every order-derived measure."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                        "o_totalprice", "o_orderdate", "o_orderpriority")
    lines = (read_table(spark, sf_dir, "lineitem", "l_orderkey")
             .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")))
    o = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    price = F.floor("o_totalprice").cast("bigint")
    quarter = F.quarter("o_orderdate")
    month_idx = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_ord"),
        F.sum(price).alias("sum_price"),
        F.sum(F.when(quarter == 1, price).otherwise(F.lit(0).cast("bigint"))).alias("a1"),
        F.sum(F.when(quarter == 4, price).otherwise(F.lit(0).cast("bigint"))).alias("a4"),
        F.count(F.when(quarter == 1, 1)).alias("c1"),
        F.count(F.when(quarter == 4, 1)).alias("c4"),
        F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("n_p"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"),
        F.countDistinct("o_orderpriority").alias("n_prio"),
        F.min(month_idx).alias("m_first"),
        F.max(month_idx).alias("m_last"),
        F.sum("n_lines").alias("n_line"),
    )


def derive_bank_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy derivation of the 21-column table from the driver tables."""
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal",
                          "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    oa = per_customer_orders(spark, sf_dir)

    c = (customer
         .join(nation, customer.c_nationkey == nation.n_nationkey)
         .join(region, nation.n_regionkey == region.r_regionkey)
         .join(oa, customer.c_custkey == oa.o_custkey, "left"))

    k = F.col("c_custkey")
    bal = F.col("c_acctbal").cast("decimal(12,2)")
    revolving = ((k * 37) % REVOLVING_MOD).cast("int")
    has_orders = F.col("n_ord") > 0
    income = F.when((k % 11) == 0, F.lit("Unknown"))
    for seg, label in INCOME_BY_SEGMENT.items():
        income = income.when(F.col("c_mktsegment") == seg, F.lit(label))
    income = income.otherwise(F.lit(INCOME_OTHER))

    def ratio3(num, den, cond, dtype):
        return F.when(cond, idiv(num, den).cast("double") / F.lit(1000)).cast(dtype)

    cols = {
        "clietnum": k.cast("bigint"),
        "attrition_flag": F.when(F.col("c_acctbal") < CHURN_BALANCE, F.lit(fixed.ATTRITED))
                           .otherwise(F.lit(fixed.EXISTING)),
        "customer_age": (F.lit(26) + (k * 7) % 48).cast("int"),
        "gender": F.when(F.col("c_nationkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")),
        "dependent_count": (F.col("c_nationkey") % 6).cast("int"),
        "education_level": _pick(k % 7, fixed.EDUCATION_LEVELS),
        "marital_status": _pick(k % 3, MARITAL_BY_KEY_MOD_3),
        "income_category": income,
        "card_category": F.col("r_name"),
        "months_on_book": idiv(F.lit(SNAPSHOT_MONTH) - F.col("m_first"), F.lit(2)).cast("int"),
        "total_relationship_count": F.col("n_prio").cast("int"),
        "months_inactive": (F.lit(SNAPSHOT_MONTH) - F.col("m_last")).cast("int"),
        "contacts_count": F.col("n_p").cast("int"),
        "credit_limit": (bal + F.lit(CREDIT_BASE)).cast("decimal(12,2)"),
        "total_revolving_bal": revolving,
        "avg_open_to_buy": (bal + F.lit(CREDIT_BASE) - revolving).cast("decimal(12,2)"),
        "total_amt_change_q4_q1": ratio3(F.lit(1000) * F.col("a4"), F.col("a1"),
                                         F.col("a1") > 0, "decimal(10,3)"),
        "total_trans_amt": idiv(F.col("sum_price"), F.lit(1000)).cast("bigint"),
        "total_trans_ct": F.coalesce(F.col("n_line"), F.lit(0)).cast("int"),
        "total_ct_change_q4_q1": ratio3(F.lit(1000) * F.col("c4"), F.col("c1") + 1,
                                        has_orders, "decimal(10,3)"),
        "avg_utilization_ratio": ratio3(F.lit(1000) * F.col("n_f"), F.col("n_ord"),
                                        has_orders, "decimal(5,3)"),
    }
    return c.select(*[cols[name].alias(name) for name in COLUMNS])


_CACHE: dict = {}
_LOCK = threading.Lock()


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Files of the source tables with their sizes and times: changes when a table is written anew."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for table in ("customer", "nation", "region", "orders", "lineitem"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        out += [(str(x.getPath()), x.getModificationTime(), x.getLen()) for x in path.getFileSystem(conf).listStatus(path)]
    return tuple(out)


def bank_churn(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """``bank_churn`` for ``sf_dir``, written to the shared folder once per session and state of the source
    files. ``materialize=False`` gives the derivation itself."""
    if not materialize:
        return derive_bank_churn(spark, sf_dir)
    key = (spark.sparkContext.applicationId, _stamp(spark, sf_dir))
    with _LOCK:
        path = _CACHE.get(key)
        if path is None:
            path = scratch_path(spark, TABLE)
            derive_bank_churn(spark, sf_dir).write.mode("overwrite").parquet(path)
            _CACHE[key] = path
    return spark.read.schema(SCHEMA).parquet(path)
