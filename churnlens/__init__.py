"""churnlens: customer churn profiling, cleaning and RFM segmentation on Spark.

Every operator takes and returns Spark DataFrames over a one-row-per-customer
table (the ``bank_churn`` schema in :mod:`churnlens.sources.bank_churn`).

Subpackages
-----------
sources    reading the input tables and deriving ``bank_churn``
functions  column-expression helpers: exact rounding, bands, segment labels
operators  profile, quantile (distributed NTILE / exact order statistics),
           clean, churn, rfm
plans      the registry of named queries and their DuckDB oracle SQL
streaming  incremental form of the churn-rate aggregate
"""

__version__ = "0.1.0"
