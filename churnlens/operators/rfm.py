"""RFM scoring, segment labels and the segment reports.

Recency = months inactive (scored DESC: 1 = longest inactive), frequency =
transaction count, monetary = transaction amount; each is a quintile
``NTILE(5)`` over the whole table with ties broken by the customer id.

Plan shape, designed for a table with billions of customers:

* the three quintiles come from :func:`churnlens.operators.quantile.with_ntiles`:
  boundaries are selected exactly in a few small jobs, then r, f and m are
  plain column expressions; no global sort, no single-partition window;
* the analysis joins the scores back to the table on the customer id and
  groups by every selected column; with a unique id that is the identity,
  so the columns are simply carried along (no self-join, no shuffle);
* where ids repeat, m rows of an id meet m scores in that join. The ``_joined``
  forms give its result from what an id has: distinct attributes and distinct
  scores, each with its rows, are counted per id apart, and the report multiplies
  the counts, so no report makes the m x m rows;
* labels and bands are map-only expressions; every report is one partial
  aggregate over at most 11 segments (or 25 grid cells);
* ``segment_reports`` makes one aggregate at the grain that all four reports
  share, written once, and each report rolls it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import fixed
from churnlens.functions.exact import avg_of_scaled, exact_avg, percent, rounded_quotient, rounded_scaled
from churnlens.functions.labels import (age_group, churned_flag, combined_fm, segment_label,
                                        utilization_category)
from churnlens.operators.quantile import NtileSpec, asc, desc, with_ntiles, with_ntiles_by
from churnlens.session import scratch_path


RECENCY, FREQUENCY, MONETARY, TIE = "months_inactive", "total_trans_ct", "total_trans_amt", "clietnum"


def score_specs(k: int = fixed.RFM_BUCKETS, recency: str = RECENCY, frequency: str = FREQUENCY,
                monetary: str = MONETARY, tie: str = TIE, then: tuple = ()) -> list[NtileSpec]:
    """``then``: columns that order rows of equal score column and equal id (where ids repeat)."""
    last = [asc(c) for c in (tie, *then)]
    return [NtileSpec("r", [desc(recency), *last], k),
            NtileSpec("f", [asc(frequency), *last], k),
            NtileSpec("m", [asc(monetary), *last], k)]


def _marked(scored: DataFrame, k: int, recency: str, frequency: str, monetary: str, tie: str) -> DataFrame:
    """Notes on the score columns what they were made from, for the reports that follow."""
    made = {"k": k, "recency": recency, "frequency": frequency, "monetary": monetary, "tie": tie}
    return scored.withMetadata("r", {"rfm": made})


def _made_from(scored: DataFrame, grid: bool = False) -> tuple[str, str, str, str]:
    """(recency, frequency, monetary, tie) columns of a scored frame; the segment grid needs quintiles."""
    made = scored.schema["r"].metadata.get("rfm", {})
    if grid and made.get("k", fixed.RFM_BUCKETS) != fixed.RFM_BUCKETS:
        raise ValueError(f"segments are defined on {fixed.RFM_BUCKETS} buckets, scores have {made['k']}")
    return tuple(made.get(x, d) for x, d in (("recency", RECENCY), ("frequency", FREQUENCY), ("monetary", MONETARY), ("tie", TIE)))


def rfm_scores(df: DataFrame, k: int = fixed.RFM_BUCKETS, where: Column | None = None, *,
               recency: str = RECENCY, frequency: str = FREQUENCY, monetary: str = MONETARY,
               tie: str = TIE, then: tuple = (), **tuning) -> DataFrame:
    """Table plus r, f, m scores (rows outside ``where`` are dropped first, as a WHERE)."""
    src = df if where is None else df.filter(where)
    return _marked(with_ntiles(src, score_specs(k, recency, frequency, monetary, tie, then), **tuning), k, recency, frequency, monetary, tie)


def rfm_scores_by(df: DataFrame, by: str = "gender", k: int = fixed.RFM_BUCKETS, *,
                  recency: str = RECENCY, frequency: str = FREQUENCY, monetary: str = MONETARY,
                  tie: str = TIE, **tuning) -> DataFrame:
    """r, f, m scored within each value of ``by`` (any number of them)."""
    return _marked(with_ntiles_by(df, by, score_specs(k, recency, frequency, monetary, tie), **tuning), k, recency, frequency, monetary, tie)


def score_columns(scored: DataFrame) -> DataFrame:
    """The scoring CTE's columns: id, raw recency/frequency/monetary, r, f, m."""
    recency, frequency, monetary, tie = _made_from(scored)
    return scored.select(tie, F.col(recency).alias("recency"), F.col(frequency).alias("frequency"),
                         F.col(monetary).alias("monetary"), "r", "f", "m")


def _monthly(col: str) -> Column:
    """Value per month rounded to 2 places, in hundredths (exact long)."""
    return rounded_scaled(F.col(col), F.lit(fixed.MONTHS_PER_YEAR))


def segments_frame(scored: DataFrame) -> DataFrame:
    """Scored rows with every derived attribute; internal superset for all reports.

    Rows with a NULL id drop out here, as they do in the analysis' join on the id.
    """
    recency, frequency, monetary, tie = _made_from(scored, grid=True)
    return (scored.filter(F.col(tie).isNotNull())
            .withColumn("recency", F.col(recency))
            .withColumn("frequency_h", _monthly(frequency))
            .withColumn("monetary_h", _monthly(monetary))
            .withColumn("frequency", F.col("frequency_h").cast("double") / 100)
            .withColumn("monetary", F.col("monetary_h").cast("double") / 100)
            .withColumn("fm", combined_fm("f", "m"))
            .withColumn("churned_customers", churned_flag().cast("bigint"))
            .withColumn("rfm_segment", segment_label("r", "fm"))
            .withColumn("age_group", age_group("customer_age"))
            .withColumn("utilization_category", utilization_category("avg_utilization_ratio")))


ATTRIBUTE_COLUMNS = ("clietnum", "customer_age", "gender", "marital_status", "education_level",
                     "income_category", "avg_utilization_ratio", "recency", "frequency", "monetary",
                     "r", "f", "m", "fm", "churned_customers")
SEGMENT_COLUMNS = ATTRIBUTE_COLUMNS + ("rfm_segment", "age_group", "utilization_category")


def rfm_attributes(scored: DataFrame) -> DataFrame:
    return segments_frame(scored).select(*ATTRIBUTE_COLUMNS)


def rfm_segments(scored: DataFrame) -> DataFrame:
    return segments_frame(scored).select(*SEGMENT_COLUMNS)


def segment_churn(segs: DataFrame, row_filter: Column | None = None) -> DataFrame:
    """Per segment: customers, churned customers, churn percentage (0 when none churned), over the rows
    that ``row_filter`` keeps."""
    if row_filter is not None:
        segs = segs.filter(row_filter)
    return (segs.groupBy("rfm_segment")
            .agg(F.count(F.lit(1)).alias("total_segment"),
                 F.count(F.when(F.col("churned_customers") == 1, F.lit(1))).alias("total_churned"),
                 F.sum(F.when(F.col("churned_customers") == 1, F.col("churned_customers")))
                 .alias("_k"))
            .withColumn("churn_rate", F.coalesce(percent(F.col("_k"), F.col("total_segment")),
                                                 F.lit(0.0)))
            .drop("_k")
            .orderBy(F.col("churn_rate").desc_nulls_first()))


def rfm_averages(segs: DataFrame) -> DataFrame:
    """Per segment: average recency and average monthly frequency / monetary value.

    Frequency and monetary are averaged after their own rounding to cents,
    as in the analysis; every average is exact (integer sums).
    """
    return (segs.groupBy("rfm_segment")
            .agg(exact_avg(F.col("recency"), 0).alias("average_recency"),
                 avg_of_scaled(F.col("frequency_h")).alias("average_frequency"),
                 avg_of_scaled(F.col("monetary_h")).alias("average_monetary"))
            .orderBy(F.col("average_recency").desc_nulls_first(), F.col("average_frequency").asc_nulls_last(),
                     F.col("average_monetary").asc_nulls_last()))


def _at_risk_churned(segs: DataFrame) -> DataFrame:
    return segs.filter((F.col("churned_customers") == 1)
                       & F.col("rfm_segment").isin(*fixed.AT_RISK_SEGMENTS))


VITALS_KEYS = ("rfm_segment", "age_group", "utilization_category")


def segment_vitals(segs: DataFrame) -> DataFrame:
    """Churned customers of the at-risk segments with their (segment, age, use) group size.

    ``COUNT(*) OVER (PARTITION BY ...)`` would pull a hot group into one
    task; instead the group sizes are a partial aggregate (at most
    5 x 4 x 4 = 80 groups, a proven bound) broadcast back with a
    NULL-safe join.
    """
    base = _at_risk_churned(segs).select("rfm_segment", "age_group", "customer_age", "gender",
                                         "education_level", "income_category",
                                         "utilization_category")
    sizes = base.groupBy(*VITALS_KEYS).agg(F.count(F.lit(1)).alias("total_segment_count"))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in VITALS_KEYS], "total_segment_count")
    cond = None
    for k in VITALS_KEYS:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return (base.join(F.broadcast(sizes), cond, "inner")
            .drop(*[f"_{k}" for k in VITALS_KEYS]))


# FIXED VALUES: output columns of the at-risk demographic mix, with the
# category each one counts (column, value).
DEMOGRAPHIC_SHARES = (
    ("percent_males", "gender", "M"),
    ("percent_females", "gender", "F"),
    ("percent_young", "age_group", "Younger"),
    ("percent_middle_aged", "age_group", "Middle Aged"),
    ("percent_old", "age_group", "Older"),
    ("percent_low_use", "utilization_category", "Low Use"),
    ("percent_med_use", "utilization_category", "Medium Use"),
    ("percent_high_use", "utilization_category", "High Use"),
    ("percent_under_40k", "income_category", "Less than $40K"),
    ("percent_40k_60k", "income_category", "$40K - $60K"),
    ("percent_60k_80k", "income_category", "$60K - $80K"),
    ("percent_80k_120k", "income_category", "$80K - $120K"),
    ("percent_over_120k", "income_category", "$120K +"),
    ("percent_income_unknown", "income_category", "Unknown"),
    ("percent_uneducated", "education_level", "Uneducated"),
    ("percent_high_school", "education_level", "High School"),
    ("percent_college", "education_level", "College"),
    ("percent_graduate", "education_level", "Graduate"),
    ("percent_post_graduate", "education_level", "Post-Graduate"),
    ("percent_doctorate", "education_level", "Doctorate"),
    ("percent_education_unknown", "education_level", "Unknown"),
)


def segment_demographics(segs: DataFrame) -> DataFrame:
    """Per at-risk segment, the share (%) of its churned customers in each category.

    NULL bands stay in the denominator. One aggregate of 21 conditional counts.
    """
    agg = (_at_risk_churned(segs).groupBy("rfm_segment")
           .agg(F.count(F.lit(1)).alias("_n"),
                *[F.count(F.when(F.col(c) == F.lit(v), F.lit(1))).alias(f"_{name}")
                  for name, c, v in DEMOGRAPHIC_SHARES]))
    return agg.select("rfm_segment", *[percent(F.col(f"_{name}"), F.col("_n")).alias(name)
                                       for name, _, _ in DEMOGRAPHIC_SHARES])


def rfm_matrix(scored: DataFrame) -> DataFrame:
    """Churn percentage per (recency score, combined frequency/monetary score) cell."""
    tie = _made_from(scored, grid=True)[3]
    return (scored.filter(F.col(tie).isNotNull())
            .groupBy(F.col("r"), combined_fm("f", "m").alias("fm"))
            .agg(F.count(F.lit(1)).alias("_n"),
                 F.count(F.when(F.col("attrition_flag") == F.lit(fixed.ATTRITED), F.lit(1))).alias("_k"))
            .select("r", "fm", percent(F.col("_k"), F.col("_n")).alias("churned_percent"))
            .orderBy(F.col("churned_percent").desc_nulls_first()))


# -- reports from one aggregate ----------------------------------------------------

#: What the four reports group or select by; a bounded number of combinations (scores, bands, categories).
CUBE_KEYS = ("r", "fm", "rfm_segment", "age_group", "utilization_category", "gender", "education_level", "income_category",
             "churned_customers")
_MEASURES = ("recency", "frequency_h", "monetary_h")


def segment_cube(segs: DataFrame) -> DataFrame:
    """Customers and summed measures at the grain that all segment reports share."""
    return segs.groupBy(*CUBE_KEYS).agg(F.count(F.lit(1)).alias("n"),
                                        *[F.sum(c).alias(f"{c}_sum") for c in _MEASURES], *[F.count(c).alias(f"{c}_n") for c in _MEASURES])


def _cube_churn(cube: DataFrame) -> DataFrame:
    agg = cube.groupBy("rfm_segment").agg(F.sum("n").alias("total_segment"), F.coalesce(F.sum(F.when(F.col("churned_customers") == 1, F.col("n"))), F.lit(0)).alias("total_churned"))
    return agg.withColumn("churn_rate", F.coalesce(percent(F.col("total_churned"), F.col("total_segment")), F.lit(0.0)))


def _cube_averages(cube: DataFrame) -> DataFrame:
    mean = lambda c, scale: rounded_quotient(F.sum(f"{c}_sum").cast("decimal(38,0)"), F.sum(f"{c}_n") * scale)
    return cube.groupBy("rfm_segment").agg(mean("recency", 1).alias("average_recency"), mean("frequency_h", 100).alias("average_frequency"),
                                           mean("monetary_h", 100).alias("average_monetary"))


def _cube_demographics(cube: DataFrame) -> DataFrame:
    counted = lambda e: F.coalesce(F.sum(F.when(e, F.col("n"))), F.lit(0))
    agg = _at_risk_churned(cube).groupBy("rfm_segment").agg(F.sum("n").alias("_n"), *[counted(F.col(c) == v).alias(f"_{name}") for name, c, v in DEMOGRAPHIC_SHARES])
    return agg.select("rfm_segment", *[percent(F.col(f"_{name}"), F.col("_n")).alias(name) for name, _, _ in DEMOGRAPHIC_SHARES])


def _cube_matrix(cube: DataFrame) -> DataFrame:
    agg = cube.groupBy("r", "fm").agg(F.sum("n").alias("_n"), F.coalesce(F.sum(F.when(F.col("churned_customers") == 1, F.col("n"))), F.lit(0)).alias("_k"))
    return agg.select("r", "fm", percent(F.col("_k"), F.col("_n")).alias("churned_percent"))


def segment_reports(scored: DataFrame) -> dict[str, DataFrame]:
    """churn, averages, demographics and matrix of a scored table: one pass over it, whose aggregate is written to the
    shared folder; each report is then a roll-up of that small table."""
    path = scratch_path(scored.sparkSession, "segment-cube")
    segment_cube(segments_frame(scored)).write.parquet(path)
    cube = scored.sparkSession.read.parquet(path)
    return {"churn": _cube_churn(cube), "averages": _cube_averages(cube), "demographics": _cube_demographics(cube), "matrix": _cube_matrix(cube)}


# -- repeated ids --------------------------------------------------------------------

#: Attributes by which the analysis groups the join of table and scores.
JOINED_ATTRIBUTES = ("customer_age", "gender", "marital_status", "education_level", "income_category", "avg_utilization_ratio")
_SCORE_KEYS = ("recency", "frequency", "monetary", "r", "f", "m", "fm", "rfm_segment", "frequency_h", "monetary_h")


def _attribute_groups(scored: DataFrame, attributes: tuple) -> DataFrame:
    """(id, attributes, churned rows): the groups that the table's side of the join makes."""
    tie = _made_from(scored)[3]
    return scored.filter(F.col(tie).isNotNull()).groupBy(F.col(tie).alias("_id"), *attributes).agg(F.sum(churned_flag().cast("bigint")).alias("_churned"))


def _score_groups(scored: DataFrame) -> DataFrame:
    """(id, scores, rows): the groups that the scores' side of the join makes."""
    tie = _made_from(scored)[3]
    return segments_frame(scored).groupBy(F.col(tie).alias("_id"), *_SCORE_KEYS).agg(F.count(F.lit(1)).alias("_scores"))


def rfm_attributes_joined(scored: DataFrame, attributes: tuple = JOINED_ATTRIBUTES) -> DataFrame:
    """The join of table and scores on the id, grouped, for any ids: a row per distinct attributes and scores of an id;
    ``churned_customers`` counts the joined rows of the group that churned. Groups are made before the join, so it
    makes no more rows than it returns."""
    tie = _made_from(scored)[3]
    joined = _attribute_groups(scored, attributes).join(_score_groups(scored), "_id")
    return joined.select(F.col("_id").alias(tie), *attributes, *_SCORE_KEYS[:8], (F.col("_churned") * F.col("_scores")).alias("churned_customers"))


def _joined_counts(scored: DataFrame, attributes: tuple) -> DataFrame:
    """Per id and segment: what the joined groups add to a report, as products of counts of the two sides."""
    sides = _attribute_groups(scored, attributes).groupBy("_id").agg(
        F.count(F.lit(1)).alias("_a"), F.count(F.when(F.col("_churned") == 1, F.lit(1))).alias("_a1"))
    scores = _score_groups(scored).groupBy("_id", "rfm_segment").agg(
        F.count(F.lit(1)).alias("_s"), F.count(F.when(F.col("_scores") == 1, F.lit(1))).alias("_s1"),
        *[F.sum(c).alias(f"_{c}") for c in _MEASURES], *[F.count(c).alias(f"_{c}_n") for c in _MEASURES])
    return sides.join(scores, "_id")


def segment_churn_joined(scored: DataFrame, attributes: tuple = JOINED_ATTRIBUTES) -> DataFrame:
    """:func:`segment_churn` of the joined groups, for any ids: a group churned if exactly one of its joined rows did."""
    agg = _joined_counts(scored, attributes).groupBy("rfm_segment").agg(
        F.sum(F.col("_a") * F.col("_s")).alias("total_segment"), F.sum(F.col("_a1") * F.col("_s1")).alias("total_churned"))
    return (agg.withColumn("churn_rate", F.coalesce(percent(F.col("total_churned"), F.col("total_segment")), F.lit(0.0)))
            .orderBy(F.col("churn_rate").desc_nulls_first()))


def rfm_averages_joined(scored: DataFrame, attributes: tuple = JOINED_ATTRIBUTES) -> DataFrame:
    """:func:`rfm_averages` of the joined groups, for any ids: a score counts once per distinct attributes of its id."""
    mean = lambda c, scale: rounded_quotient(F.sum(F.col("_a") * F.col(f"_{c}")).cast("decimal(38,0)"), F.sum(F.col("_a") * F.col(f"_{c}_n")) * scale)
    return _joined_counts(scored, attributes).groupBy("rfm_segment").agg(
        mean("recency", 1).alias("average_recency"), mean("frequency_h", 100).alias("average_frequency"), mean("monetary_h", 100).alias("average_monetary"))
