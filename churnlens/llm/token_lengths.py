"""Token counts from an exact length histogram.

Documents are encoded once; every task sends its histogram (encoded length ->
documents), and the histograms are added. All questions about lengths are then
answered from the histogram: suffix sums give, for every length L that occurs,
the documents and tokens at least that long, the tokens left if every document
is cut at L, and the quantile at which L stands. The sums run in two steps, by
groups of lengths and then inside a group, so no task takes all lengths. Any
other limit (``limit_answers``) and any quantile (``quantile_answers``) is answered
from the histogram as well.

Defined results: null and empty texts have length 0 and count as documents.
Empty table: empty result. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lengths per group of the suffix sums.
GROUP = 4096


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """length, n_docs over all documents (token counts of the rank file's byte-level BPE)."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        pairs = (line.split() for line in ranks.value.splitlines() if line)
        coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                n = len(coder.encode_ordinary(text.decode("utf-8", "replace"))) if text else 0
                seen[n] = seen.get(n, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def length_answers(histogram: DataFrame) -> DataFrame:
    """Per length: n_docs, docs_from and tokens_from (at least as long), truncated_tokens (all documents cut
    there), quantile (share of documents at most as long).

    The histogram (a row per length) is checkpointed: both steps of the sums read it, texts are encoded once."""
    histogram = histogram.checkpoint()
    rows = histogram.withColumn("g", F.floor(F.col("length") / GROUP)).withColumn("t", F.col("length") * F.col("n_docs"))
    groups = rows.groupBy("g").agg(F.sum("n_docs").alias("gn"), F.sum("t").alias("gt"))
    after = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("g", F.coalesce(F.sum("gn").over(after), F.lit(0)).alias("an"), F.coalesce(F.sum("gt").over(after), F.lit(0)).alias("at"),
                           F.sum("gn").over(whole).alias("all_n"), F.sum("gt").over(whole).alias("all_t"))
    down = Window.partitionBy("g").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sn", F.sum("n_docs").over(down)).withColumn("st", F.sum("t").over(down)).join(groups, "g")
    docs_from, tokens_from = F.col("sn") + F.col("an"), F.col("st") + F.col("at")
    return rows.select("length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
                       (F.col("all_t") - tokens_from + F.col("length") * docs_from).alias("truncated_tokens"),
                       ((F.col("all_n") - docs_from + F.col("n_docs")) / F.col("all_n")).alias("quantile"))


def limit_answers(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per limit, whether a document has that length or not: docs_from and tokens_from (at least as long), truncated_tokens
    (all documents cut there), quantile (share of documents at most as long)."""
    n, length, limit = F.col("n_docs"), F.col("length"), F.col("limit")
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))]).cast("array<long>")).alias("limit")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return histogram.select("length", "n_docs", asked).groupBy("limit").agg(
        total(F.when(length >= limit, n)).alias("docs_from"), total(F.when(length >= limit, length * n)).alias("tokens_from"),
        F.sum(F.least(length, limit) * n).alias("truncated_tokens"), (total(F.when(length <= limit, n)) / F.sum(n)).alias("quantile"))


def quantile_answers(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """Per asked quantile: length, the least that at least this share of the documents do not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(quantiles))]).cast("array<double>")).alias("asked")
    return (length_answers(histogram).select("length", "quantile", asked).filter("quantile >= asked")
            .groupBy(F.col("asked").alias("quantile")).agg(F.min("length").alias("length")))
