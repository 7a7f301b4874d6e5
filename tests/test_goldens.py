"""Golden values at sf0.01 (FIXTURES.md section 4) and invariants of the reports."""

import pytest
from pyspark.sql import functions as F

from churnlens.functions import fixed
from churnlens.operators import churn, clean, rfm
from churnlens.sources.bank_churn import bank_churn
from tests.conftest import SF01

SEGMENTS_ALL = {
    "About to sleep": (68, 9, 13.24), "At risk": (137, 18, 13.14), "Can't lose them": (53, 7, 13.21),
    "Champions": (184, 30, 16.30), "Engaged": (234, 34, 14.53), "Hibernating": (77, 13, 16.88),
    "Lost": (122, 18, 14.75), "Need Attention": (214, 36, 16.82), "Potential": (269, 42, 15.61),
    "Promising": (104, 13, 12.50), "Recent Customers": (38, 7, 18.42),
}
SEGMENTS_FEMALE = {"Champions": (92, 19, 20.65), "Hibernating": (30, 6, 20.00), "Lost": (64, 11, 17.19)}
SEGMENTS_MALE = {"Recent Customers": (16, 4, 25.00), "At risk": (67, 10, 14.93)}


@pytest.fixture(scope="module")
def bc(spark):
    return bank_churn(spark, SF01)


@pytest.fixture(scope="module")
def segs(bc):
    return rfm.segments_frame(rfm.rfm_scores(bc))


def as_map(df):
    return {r["rfm_segment"]: (r["total_segment"], r["total_churned"], r["churn_rate"])
            for r in df.collect()}


def test_overall_churn(bc):
    r = churn.overall_churn(bc).collect()[0]
    assert (r.total_churned, r.total_existing, r.overall_churn_rate) == (227, 1500, 15.13)


def test_kpi_text(bc):
    r = churn.kpi_text(bc).collect()[0]
    assert r.total_customers == "1.50K"
    assert r.total_spend == "$3.76M"


def test_segment_churn_all(segs):
    got = as_map(rfm.segment_churn(segs))
    assert got == SEGMENTS_ALL


@pytest.mark.parametrize("gender,expected", [("F", SEGMENTS_FEMALE), ("M", SEGMENTS_MALE)])
def test_segment_churn_by_gender(bc, gender, expected):
    got = as_map(rfm.segment_churn(rfm.segments_frame(
        rfm.rfm_scores(bc, where=F.col("gender") == gender))))
    for k, v in expected.items():
        assert got[k] == v


def test_rfm_averages(segs):
    got = {r.rfm_segment: (r.average_recency, r.average_frequency, r.average_monetary)
           for r in rfm.rfm_averages(segs).collect()}
    assert got["Champions"] == (1.84, 4.77, 300.60)
    assert got["Lost"] == (22.73, 1.82, 112.64)
    assert got["At risk"] == (13.42, 4.20, 258.57)


def test_segment_demographics(segs):
    got = {r.rfm_segment: (r.percent_males, r.percent_low_use)
           for r in rfm.segment_demographics(segs).collect()}
    assert got["At risk"] == (55.56, 72.22)
    assert got["Need Attention"] == (44.44, 50.00)
    assert got["Promising"] == (46.15, 61.54)


def test_demographic_shares_sum_to_100(segs):
    for r in rfm.segment_demographics(segs).collect():
        assert abs(r.percent_males + r.percent_females - 100) <= 0.01


def test_segment_counts_sum_to_rows(segs, bc):
    assert sum(v[0] for v in as_map(rfm.segment_churn(segs)).values()) == bc.count()


def test_matrix_has_25_cells(bc):
    assert rfm.rfm_matrix(rfm.rfm_scores(bc)).count() == 25


def test_quintile_sizes_differ_by_at_most_one(bc):
    scored = rfm.rfm_scores(bc)
    for c in ("r", "f", "m"):
        sizes = [r["count"] for r in scored.groupBy(c).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_cleaning_step_counts(bc):
    rows = clean.clean(bc).step_counts().orderBy("step").collect()
    assert [r.rows_left for r in rows] == [1500, 1469, 1454, 1421, 1421, 1407, 1407, 1388, 1247]
    assert all(r.rows_removed >= 0 for r in rows)


def test_kept_and_removed_partition_the_input(bc):
    for col in ("months_inactive", "total_trans_amt"):
        kept, removed = clean.trim_top_percentile(bc, col)
        assert kept.count() + removed.count() == bc.count()
        assert kept.join(removed, "clietnum").count() == 0


def test_cleaned_table_rows(bc):
    cl = clean.clean(bc)
    assert cl.table.count() == 1247
    assert cl.removed_rows().count() == 1500 - 1247


def test_grid_covers_every_cell_once():
    cells = list(fixed.segment_cells())
    assert len(cells) == 25 and len({(r, fm) for r, fm, _ in cells}) == 25
    assert len(fixed.SEGMENT_LABELS) == 11
