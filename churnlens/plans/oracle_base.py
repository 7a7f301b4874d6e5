"""DuckDB SQL building blocks for the oracle queries.

Every oracle text starts with :data:`BANK_CHURN_CTE`, the FIXTURES.md
section 2 derivation written directly in SQL (separate order and line
aggregates, as the fixture describes them, so it cross-checks the fused
Spark derivation), followed by the query's own CTEs.
"""

from __future__ import annotations

BANK_CHURN_CTE = """
WITH oa AS (
    SELECT o_custkey AS ck,
           COUNT(*) AS n_ord,
           CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) // 1000 AS amt_k,
           CAST(SUM(CASE WHEN quarter(o_orderdate) = 1 THEN CAST(FLOOR(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS a1,
           CAST(SUM(CASE WHEN quarter(o_orderdate) = 4 THEN CAST(FLOOR(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS a4,
           COUNT(*) FILTER (WHERE quarter(o_orderdate) = 1) AS c1,
           COUNT(*) FILTER (WHERE quarter(o_orderdate) = 4) AS c4,
           COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
           COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
           COUNT(DISTINCT o_orderpriority) AS n_prio,
           MIN(year(o_orderdate) * 12 + month(o_orderdate)) AS m_first,
           MAX(year(o_orderdate) * 12 + month(o_orderdate)) AS m_last
    FROM orders
    GROUP BY o_custkey
),
la AS (
    SELECT o_custkey AS ck, COUNT(*) AS n_line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_custkey
),
bank_churn AS (
    SELECT
        CAST(c_custkey AS BIGINT) AS clietnum,
        CASE WHEN c_acctbal < 700 THEN 'Attrited Customer' ELSE 'Existing Customer' END AS attrition_flag,
        CAST(26 + (c_custkey * 7) % 48 AS INTEGER) AS customer_age,
        CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CAST(c_nationkey % 6 AS INTEGER) AS dependent_count,
        CASE c_custkey % 7 WHEN 0 THEN 'Uneducated' WHEN 1 THEN 'High School' WHEN 2 THEN 'College'
             WHEN 3 THEN 'Graduate' WHEN 4 THEN 'Post-Graduate' WHEN 5 THEN 'Doctorate'
             WHEN 6 THEN 'Unknown' END AS education_level,
        CASE c_custkey % 3 WHEN 0 THEN 'Married' WHEN 1 THEN 'Single' WHEN 2 THEN 'Unknown' END AS marital_status,
        CASE WHEN c_custkey % 11 = 0 THEN 'Unknown'
             WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Less than $40K'
             WHEN c_mktsegment = 'BUILDING' THEN '$40K - $60K'
             WHEN c_mktsegment = 'FURNITURE' THEN '$60K - $80K'
             WHEN c_mktsegment = 'HOUSEHOLD' THEN '$80K - $120K'
             ELSE '$120K +' END AS income_category,
        r_name AS card_category,
        CAST((2001 * 12 + 8 - m_first) // 2 AS INTEGER) AS months_on_book,
        CAST(n_prio AS INTEGER) AS total_relationship_count,
        CAST(2001 * 12 + 8 - m_last AS INTEGER) AS months_inactive,
        CAST(n_p AS INTEGER) AS contacts_count,
        CAST(CAST(c_acctbal AS DECIMAL(12,2)) + 11000 AS DECIMAL(12,2)) AS credit_limit,
        CAST((c_custkey * 37) % 2518 AS INTEGER) AS total_revolving_bal,
        CAST(CAST(c_acctbal AS DECIMAL(12,2)) + 11000 - (c_custkey * 37) % 2518 AS DECIMAL(12,2)) AS avg_open_to_buy,
        CAST(CASE WHEN a1 > 0 THEN CAST((1000 * a4) // a1 AS DOUBLE) / 1000 END AS DECIMAL(10,3)) AS total_amt_change_q4_q1,
        CAST(amt_k AS BIGINT) AS total_trans_amt,
        CAST(COALESCE(n_line, 0) AS INTEGER) AS total_trans_ct,
        CAST(CASE WHEN n_ord > 0 THEN CAST((1000 * c4) // (c1 + 1) AS DOUBLE) / 1000 END AS DECIMAL(10,3)) AS total_ct_change_q4_q1,
        CAST(CASE WHEN n_ord > 0 THEN CAST((1000 * n_f) // n_ord AS DOUBLE) / 1000 END AS DECIMAL(5,3)) AS avg_utilization_ratio
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN oa ON c_custkey = oa.ck
    LEFT JOIN la ON c_custkey = la.ck
)"""


def with_cte(body: str) -> str:
    """``body`` may start with ``, name AS (...)`` to add CTEs, then a SELECT."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return BANK_CHURN_CTE + sep + body


def rq(num: str, den: str, digits: int = 2) -> str:
    """SQL for the exact half-away-from-zero ``round(num / den, digits)`` as DOUBLE."""
    m = 10 ** digits
    return (f"CAST(sign({num}) * ((2 * {m} * abs({num}) + ({den})) // NULLIF(2 * ({den}), 0)) AS DOUBLE)"
            f" / {m}")


def pct(part: str, whole: str, digits: int = 2) -> str:
    return rq(f"(100 * ({part}))", whole, digits)


def frac(part: str, whole: str, digits: int = 2) -> str:
    return rq(f"({part})", whole, digits)


def avg_exact(col: str, scale: int = 0, digits: int = 2) -> str:
    """Exact ROUND(AVG(col), digits) as DOUBLE (aggregate)."""
    s = f"CAST(SUM({col}) * {10 ** scale} AS HUGEINT)" if scale else f"CAST(SUM({col}) AS HUGEINT)"
    n = f"COUNT({col}) * {10 ** scale}" if scale else f"COUNT({col})"
    return rq(s, n, digits)


def round_double(x: str, digits: int = 2) -> str:
    m = float(10 ** digits)
    return f"CAST(FLOOR(({x}) * {m} + 0.5) AS DOUBLE) / {m}"
