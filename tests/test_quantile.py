"""Distributed NTILE / cutoff / median against Spark's single-partition reference."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators import quantile as Q
from churnlens.operators.clean import trim_top_percentile

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("v", T.IntegerType()),
    T.StructField("d", T.DecimalType(6, 3)),
    T.StructField("s", T.StringType()),
    T.StructField("x", T.DoubleType()),
])

TUNINGS = [dict(), dict(bins=6)]
DEEP = dict(bins=2)


def table(spark, n, seed, null_frac=0.1, distinct=5):
    rnd = random.Random(seed)
    from decimal import Decimal
    rows = []
    for i in range(n):
        def maybe(v):
            return None if rnd.random() < null_frac else v
        rows.append((i * 7 + 3, maybe(rnd.randrange(distinct)),
                     maybe(Decimal(rnd.randrange(distinct * 10)) / 1000),
                     maybe(rnd.choice("abcde")), maybe(rnd.choice([0.5, -1.0, 2.25, float("nan")]))))
    return spark.createDataFrame(rows, SCHEMA)


def reference(df, name, keys, k):
    return df.withColumn(name, F.ntile(k).over(Window.orderBy(*[x.spark_order() for x in keys])))


CASES = [(n, t) for n in (0, 1, 2, 12, 99, 100, 101) for t in TUNINGS] + [(37, DEEP), (101, DEEP)]


@pytest.mark.parametrize("n,tuning", CASES)
def test_ntile_matches_window(spark, n, tuning):
    df = table(spark, n, seed=n)
    specs = [
        Q.NtileSpec("a", [Q.asc("v"), Q.asc("id")], 5),
        Q.NtileSpec("b", [Q.desc("v"), Q.asc("id")], 5),
        Q.NtileSpec("c", [Q.asc("d"), Q.desc("id")], 100),
        Q.NtileSpec("e", [Q.desc("s", nulls_first=False), Q.asc("v"), Q.asc("id")], 7),
        Q.NtileSpec("g", [Q.asc("x"), Q.asc("id")], 4),
    ]
    got = Q.with_ntiles(df, specs, **tuning)
    ref = df
    for s in specs:
        ref = reference(ref, s.name + "_r", s.keys, s.k)
    joined = got.join(ref.select("id", *[s.name + "_r" for s in specs]), "id")
    assert joined.count() == n
    for s in specs:
        assert joined.filter(F.col(s.name) != F.col(s.name + "_r")).count() == 0, s.name


def test_ntile_with_where_and_groups(spark):
    df = table(spark, 60, seed=7)
    keys = [Q.asc("v"), Q.asc("id")]
    got = Q.with_ntiles_by(df, "s", [Q.NtileSpec("q", keys, 3)], bins=3)
    w = Window.partitionBy("s").orderBy(*[k.spark_order() for k in keys])
    ref = df.withColumn("q_r", F.ntile(3).over(w))
    j = got.join(ref.select("id", "q_r"), "id")
    assert j.filter(~F.col("q").eqNullSafe(F.col("q_r"))).count() == 0


def test_one_value_holds_most_rows(spark):
    """A value that fills a third (here: most) of the table resolves without a window."""
    rows = [(i, 1 if i % 3 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v int")
    spec = Q.RankSpec([Q.asc("v")], lambda n: [0, 150, 299])
    b = Q.select_ranks(df, [spec], bins=4)[0].boundaries
    ordered = sorted(v for _, v in rows)
    assert [Q._raw(x.norm, df.schema["v"]) for x in b] == [ordered[0], ordered[150], ordered[299]]


@pytest.mark.parametrize("n,null_frac", [(50, 0.0), (99, 0.0), (100, 0.0), (101, 0.05),
                                         (250, 0.0), (250, 0.005), (250, 0.05)])
def test_top_percentile_cutoff_matches_semi_join(spark, n, null_frac):
    df = table(spark, n, seed=n + int(null_frac * 1000), null_frac=null_frac, distinct=40)
    kept, removed = trim_top_percentile(df, "v", bins=3)
    bucket = df.withColumn("p", F.ntile(100).over(Window.orderBy(F.col("v").asc_nulls_last())))
    top = bucket.filter("p = 100").select("v").distinct()
    ref_removed = df.join(top, "v", "left_semi")
    assert sorted(r.id for r in removed.collect()) == sorted(r.id for r in ref_removed.collect())
    assert kept.count() + removed.count() == n


def test_exact_medians(spark):
    df = table(spark, 41, seed=3, distinct=11)
    med = Q.exact_medians(df, ["v", "d", "x"], bins=3)
    ref = df.agg(F.percentile("v", 0.5), F.percentile(F.col("d").cast("double"), 0.5)).collect()[0]
    assert Q.median_value(med["v"]) == ref[0]
    assert abs(Q.median_value(med["d"]) - ref[1]) < 1e-12


def test_ntile_starts():
    assert Q.ntile_starts(12, 5) == [3, 6, 8, 10]     # sizes 3,3,2,2,2
    assert Q.ntile_starts(3, 5) == [1, 2]             # only buckets 1..3 exist
    assert Q.ntile_starts(0, 5) == []
    assert Q.ntile_starts(101, 100)[-1] == 100        # bucket 100 holds the last row


def test_no_single_partition_exchange(spark):
    """The scored plan must not contain a global window (Exchange SinglePartition)."""
    df = table(spark, 30, seed=1)
    out = Q.with_ntiles(df, [Q.NtileSpec("a", [Q.asc("v"), Q.asc("id")], 5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_global_ntile_convenience(spark):
    df = table(spark, 23, seed=5)
    keys = [Q.desc("v"), Q.asc("id")]
    got = Q.global_ntile(df, "t", keys, 4)
    ref = reference(df, "t_r", keys, 4)
    j = got.join(ref.select("id", "t_r"), "id")
    assert j.filter(F.col("t") != F.col("t_r")).count() == 0


def _sizes(df, col):
    return sorted(r["count"] for r in df.groupBy(col).count().collect())


@pytest.mark.parametrize("rows,k", [
    ([(i // 10, "x") for i in range(100)], 4),            # ten copies of every row
    ([(1, "x")] * 50 + [(i, "y") for i in range(51)], 7),  # one id on half the rows
    ([(None, "x")] * 13 + [(i, None) for i in range(20)], 5),
    ([(1, "x")] * 9, 4),
])
def test_bucket_sizes_with_repeated_rows(spark, rows, k):
    df = spark.createDataFrame(rows, "id long, s string")
    got = Q.with_ntiles(df, [Q.NtileSpec("t", [Q.asc("id")], k), Q.NtileSpec("u", [Q.desc("s")], k)])
    ref = df.withColumn("t", F.ntile(k).over(Window.orderBy("id")))
    assert _sizes(got, "t") == _sizes(ref, "t") and _sizes(got, "u") == _sizes(ref, "t")
    assert sorted(map(str, got.select("id", "s").collect())) == sorted(map(str, df.collect()))
    pairs = sorted((r["t"], r["id"] is None, r["id"] or 0) for r in got.collect())
    assert [p[1:] for p in pairs] == sorted(p[1:] for p in pairs)


def test_rank_of_rows_that_change_on_disk(spark, tmp_path):
    """Nothing is remembered between calls: a folder written anew gives new buckets."""
    path = str(tmp_path / "t")
    for shift in (0, 1000):
        spark.range(100).selectExpr(f"id + {shift} AS id").write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)
        got = Q.with_ntiles(spark.read.parquet(path), [Q.NtileSpec("t", [Q.asc("id")], 4)])
        assert _sizes(got, "t") == [25] * 4


@pytest.mark.parametrize("k,keys", [(5, 1), (100, 1), (5, 3), (100, 3)])
def test_few_scans_and_no_single_partition_of_rows(spark, monkeypatch, k, keys):
    df = spark.range(300_000).selectExpr("id", "id * 7919 % 1000 AS a", "CAST(id * 31 % 100003 AS INT) AS b", "CAST(id % 97 AS DECIMAL(9,2)) AS c")
    scans, plain = [], type(df).collect

    def seen(self):
        plan = self._jdf.queryExecution().executedPlan().toString()
        scans.append(plan)
        return plain(self)
    monkeypatch.setattr(type(df), "collect", seen)
    got = Q.with_ntiles(df, [Q.NtileSpec(f"t{c}", [Q.asc(c), Q.asc("id")], k) for c in "abc"[:keys]])
    monkeypatch.undo()
    assert len(scans) <= 8
    assert not any("SinglePartition" in p or "Window" in p for p in scans)
    assert _sizes(got, "ta") == [300_000 // k] * k


def test_where_restricts_the_ordered_rows(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 2)
    got = Q.with_ntiles(df, [Q.NtileSpec("t", [Q.asc("id")], 5)], where=F.col("g") == 1)
    assert got.filter("g = 0 AND t IS NOT NULL").count() == 0
    assert _sizes(got.filter("g = 1"), "t") == [5] * 5
