"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the whole ``bank_churn`` table derived from the driver
tables of ``sf_dir`` (no row caps except the preview, whose LIMIT is the
feature).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import fixed
from churnlens.operators import churn, clean, profile, rfm
from churnlens.operators.quantile import NtileSpec, asc, desc, with_ntiles, with_ntiles_by
from churnlens.sources.bank_churn import bank_churn

Query = Callable[[SparkSession, str], DataFrame]

PERCENTILE_COLUMNS = ("customer_age", "months_inactive", "contacts_count",
                      "total_amt_change_q4_q1", "total_trans_amt", "total_ct_change_q4_q1")
TRIM_COLUMNS = PERCENTILE_COLUMNS[1:]


def _bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_churn(spark, sf_dir)


# -- profile ---------------------------------------------------------------

def preview_rows(spark, sf_dir):
    return profile.preview(_bc(spark, sf_dir), 100)


def null_rows(spark, sf_dir):
    return profile.null_rows(_bc(spark, sf_dir), "avg_utilization_ratio")


def null_rows_amt_change(spark, sf_dir):
    return profile.null_rows(_bc(spark, sf_dir), "total_amt_change_q4_q1")


def key_quality(spark, sf_dir):
    return profile.key_quality(_bc(spark, sf_dir))


def column_profile(spark, sf_dir):
    return profile.column_profile(_bc(spark, sf_dir), "bank_churn")


def null_counts(spark, sf_dir):
    return profile.null_counts(_bc(spark, sf_dir))


def duplicate_values(spark, sf_dir):
    return profile.duplicate_values(_bc(spark, sf_dir), "avg_utilization_ratio")


def column_stats(spark, sf_dir):
    return profile.column_stats(_bc(spark, sf_dir))


def sigma_outliers(spark, sf_dir):
    return profile.sigma_outliers(_bc(spark, sf_dir))


def value_spikes(spark, sf_dir):
    return profile.value_spikes(_bc(spark, sf_dir), "months_on_book")


def _percentile(column: str) -> Query:
    def q(spark, sf_dir):
        df = _bc(spark, sf_dir)
        spec = NtileSpec("percentile", [asc(column), asc("clietnum")], fixed.PERCENTILE_BUCKETS)
        return with_ntiles(df, [spec]).select(column, "percentile")
    q.__name__ = f"percentile_{column}"
    return q


# -- cleaning --------------------------------------------------------------

def _trim(column: str, part: int) -> Query:
    def q(spark, sf_dir):
        return clean.trim_top_percentile(_bc(spark, sf_dir), column)[part]
    q.__name__ = f"{'trim' if part == 0 else 'removed'}_top_percentile_{column}"
    return q


def _delete(pred, part: int) -> Query:
    def q(spark, sf_dir):
        return clean.delete_where(_bc(spark, sf_dir), pred())[part]
    return q


BUCKET = 95


def _bucket_values(spark, sf_dir, part: int):
    """Delete the rows whose value occurs in one bucket that is not the last: IN over a set, no cutoff."""
    df, column = _bc(spark, sf_dir), "total_amt_change_q4_q1"
    spec = NtileSpec("percentile", [asc(column), asc("clietnum")], fixed.PERCENTILE_BUCKETS)
    values = with_ntiles(df, [spec]).filter(F.col("percentile") == BUCKET).select(column)
    return clean.delete_where_in(df, column, values)[part]


def delete_in_bucket(spark, sf_dir):
    return _bucket_values(spark, sf_dir, 0)


def removed_in_bucket(spark, sf_dir):
    return _bucket_values(spark, sf_dir, 1)


def trim_top_half_amt_change(spark, sf_dir):
    return clean.trim_top_percentile(_bc(spark, sf_dir), "total_amt_change_q4_q1", 2)[0]


def removed_top_half_amt_change(spark, sf_dir):
    return clean.trim_top_percentile(_bc(spark, sf_dir), "total_amt_change_q4_q1", 2)[1]


def clean_table(spark, sf_dir):
    return clean.clean(_bc(spark, sf_dir)).table


def clean_step_counts(spark, sf_dir):
    return clean.clean(_bc(spark, sf_dir)).step_counts()


def clean_removed(spark, sf_dir):
    return clean.clean(_bc(spark, sf_dir)).removed_rows()


# -- churn -----------------------------------------------------------------

def kpi_text(spark, sf_dir):
    return churn.kpi_text(_bc(spark, sf_dir))


def kpi_numeric(spark, sf_dir):
    return churn.kpi_numeric(_bc(spark, sf_dir))


def overall_churn(spark, sf_dir):
    return churn.overall_churn(_bc(spark, sf_dir))


def _cut(name: str) -> Query:
    def q(spark, sf_dir):
        return churn.churn_cut(_bc(spark, sf_dir), name)
    q.__name__ = name
    return q


# -- RFM -------------------------------------------------------------------

def _scored(spark, sf_dir, where=None):
    return rfm.rfm_scores(_bc(spark, sf_dir), where=where)


def rfm_scores(spark, sf_dir):
    return rfm.score_columns(_scored(spark, sf_dir))


def rfm_scores_by_gender(spark, sf_dir):
    df = _bc(spark, sf_dir).filter(F.col("gender").isin(*fixed.GENDERS))
    scored = rfm.rfm_scores_by(df, "gender")
    return scored.select("clietnum", "gender", F.col(rfm.RECENCY).alias("recency"),
                         F.col(rfm.FREQUENCY).alias("frequency"),
                         F.col(rfm.MONETARY).alias("monetary"), "r", "f", "m")


def percentile_education_income(spark, sf_dir):
    """Percentiles ordered by text."""
    spec = NtileSpec("percentile", [desc("education_level"), asc("income_category"), asc("clietnum")], fixed.PERCENTILE_BUCKETS)
    return with_ntiles(_bc(spark, sf_dir), [spec]).select("clietnum", "percentile")


def quartile_by_tenure(spark, sf_dir):
    """Quartiles of spend within every value of months_on_book (NULL is a group)."""
    spec = NtileSpec("quartile", [desc("total_trans_amt"), asc("clietnum")], 4)
    return with_ntiles_by(_bc(spark, sf_dir), "months_on_book", [spec]).select("clietnum", "months_on_book", "quartile")


def _repeated_ids(spark, sf_dir) -> DataFrame:
    """The table with repeated ids: a tenth of the customers share their neighbour's id, and each 50th id has a row
    that repeats but for its balance."""
    df = _bc(spark, sf_dir)
    key = F.col("clietnum")
    shared = df.withColumn("clietnum", F.when(key % 10 == 1, key - 1).otherwise(key))
    again = shared.filter(key % 50 == 0).withColumn("total_revolving_bal", F.col("total_revolving_bal") + 1)
    return shared.unionByName(again)


def _scored_repeated(spark, sf_dir) -> DataFrame:
    return rfm.rfm_scores(_repeated_ids(spark, sf_dir), then=("total_trans_ct", "total_trans_amt", "months_inactive", "total_revolving_bal"))


def segment_churn_repeated_ids(spark, sf_dir):
    return rfm.segment_churn_joined(_scored_repeated(spark, sf_dir))


def rfm_averages_repeated_ids(spark, sf_dir):
    return rfm.rfm_averages_joined(_scored_repeated(spark, sf_dir))


def rfm_attributes_repeated_ids(spark, sf_dir):
    return rfm.rfm_attributes_joined(_scored_repeated(spark, sf_dir))


def segment_reports_cleaned(spark, sf_dir, table: DataFrame | None = None):
    """The four segment reports from one pass, in long form: report, place (segment or cell), measure, value."""
    reports = rfm.segment_reports(rfm.rfm_scores(_cleaned_table(spark, sf_dir, table)))
    out = None
    for name, report in reports.items():
        keys = ["r", "fm"] if name == "matrix" else ["rfm_segment"]
        place = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in keys])
        measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in report.columns if c not in keys])
        long = report.select(F.lit(name).alias("report"), place.alias("place"), F.inline(measures))
        out = long if out is None else out.unionByName(long)
    return out


def rfm_attributes(spark, sf_dir):
    return rfm.rfm_attributes(_scored(spark, sf_dir))


def rfm_segments(spark, sf_dir):
    return rfm.rfm_segments(_scored(spark, sf_dir))


def segment_vitals(spark, sf_dir):
    return rfm.segment_vitals(rfm.segments_frame(_scored(spark, sf_dir)))


def segment_churn(spark, sf_dir):
    return rfm.segment_churn(rfm.segments_frame(_scored(spark, sf_dir)))


def segment_churn_female(spark, sf_dir):
    return rfm.segment_churn(rfm.segments_frame(_scored(spark, sf_dir, F.col("gender") == "F")))


def segment_churn_male(spark, sf_dir):
    return rfm.segment_churn(rfm.segments_frame(_scored(spark, sf_dir, F.col("gender") == "M")))


# Reports on the table that the cleaning leaves; ``table`` takes one that the caller has cleaned
# already, so that several reports share one cleaning pass.

def _cleaned_table(spark, sf_dir, table: DataFrame | None) -> DataFrame:
    return clean_table(spark, sf_dir) if table is None else table


def kpi_numeric_cleaned(spark, sf_dir, table: DataFrame | None = None):
    return churn.kpi_numeric(_cleaned_table(spark, sf_dir, table))


def segment_churn_cleaned(spark, sf_dir, table: DataFrame | None = None):
    return rfm.segment_churn(rfm.segments_frame(rfm.rfm_scores(_cleaned_table(spark, sf_dir, table))))


def rfm_averages_cleaned(spark, sf_dir, table: DataFrame | None = None):
    return rfm.rfm_averages(rfm.segments_frame(rfm.rfm_scores(_cleaned_table(spark, sf_dir, table))))


def segment_demographics_cleaned(spark, sf_dir, table: DataFrame | None = None):
    return rfm.segment_demographics(rfm.segments_frame(rfm.rfm_scores(_cleaned_table(spark, sf_dir, table))))


def rfm_matrix_cleaned(spark, sf_dir, table: DataFrame | None = None):
    return rfm.rfm_matrix(rfm.rfm_scores(_cleaned_table(spark, sf_dir, table)))


def rfm_averages(spark, sf_dir):
    return rfm.rfm_averages(rfm.segments_frame(_scored(spark, sf_dir)))


def segment_demographics(spark, sf_dir):
    return rfm.segment_demographics(rfm.segments_frame(_scored(spark, sf_dir)))


def rfm_matrix(spark, sf_dir):
    return rfm.rfm_matrix(_scored(spark, sf_dir))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "preview_rows": preview_rows,
        "null_rows": null_rows,
        "null_rows_amt_change": null_rows_amt_change,
        "key_quality": key_quality,
        "column_profile": column_profile,
        "null_counts": null_counts,
        "duplicate_values": duplicate_values,
        "column_stats": column_stats,
        "sigma_outliers": sigma_outliers,
        "value_spikes": value_spikes,
    }
    for c in PERCENTILE_COLUMNS:
        q[f"percentile_{c}"] = _percentile(c)
    for c in TRIM_COLUMNS:
        q[f"trim_top_percentile_{c}"] = _trim(c, 0)
        q[f"removed_top_percentile_{c}"] = _trim(c, 1)
    q["delete_age_outlier"] = _delete(lambda: F.col("customer_age") == fixed.AGE_OUTLIER, 0)
    q["delete_ct_over"] = _delete(lambda: F.col("total_trans_ct") > fixed.TRANS_CT_LIMIT, 0)
    q["delete_ct_over_60"] = _delete(lambda: F.col("total_trans_ct") > 60, 0)
    q["delete_zero_ct_change"] = _delete(lambda: F.col("total_ct_change_q4_q1") == 0, 0)
    q["removed_zero_ct_change"] = _delete(lambda: F.col("total_ct_change_q4_q1") == 0, 1)
    q["clean_table"] = clean_table
    q["clean_step_counts"] = clean_step_counts
    q["clean_removed"] = clean_removed
    q["kpi_text"] = kpi_text
    q["kpi_numeric"] = kpi_numeric
    q["overall_churn"] = overall_churn
    for name in churn.CHURN_CUTS:
        q[name] = _cut(name)
    q.update({
        "rfm_scores": rfm_scores,
        "rfm_scores_by_gender": rfm_scores_by_gender,
        "rfm_attributes": rfm_attributes,
        "rfm_segments": rfm_segments,
        "segment_vitals": segment_vitals,
        "segment_churn": segment_churn,
        "segment_churn_female": segment_churn_female,
        "segment_churn_male": segment_churn_male,
        "segment_churn_cleaned": segment_churn_cleaned,
        "rfm_averages": rfm_averages,
        "segment_demographics": segment_demographics,
        "rfm_matrix": rfm_matrix,
        "kpi_numeric_cleaned": kpi_numeric_cleaned,
        "rfm_averages_cleaned": rfm_averages_cleaned,
        "segment_demographics_cleaned": segment_demographics_cleaned,
        "rfm_matrix_cleaned": rfm_matrix_cleaned,
        "delete_in_bucket": delete_in_bucket,
        "removed_in_bucket": removed_in_bucket,
        "trim_top_half_amt_change": trim_top_half_amt_change,
        "removed_top_half_amt_change": removed_top_half_amt_change,
        "percentile_education_income": percentile_education_income,
        "quartile_by_tenure": quartile_by_tenure,
        "segment_churn_repeated_ids": segment_churn_repeated_ids,
        "rfm_averages_repeated_ids": rfm_averages_repeated_ids,
        "rfm_attributes_repeated_ids": rfm_attributes_repeated_ids,
        "segment_reports_cleaned": segment_reports_cleaned,
    })
    return q
