"""The corpus pipeline: five stages of training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and rereads it as the next stage's input.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnlens.llm import bpe_index, kneser_ney, patience_lines, simhash_groups, template_windows  # noqa: E402
from churnlens.llm.catalog import ready  # noqa: E402
from churnlens.llm.chunks import named_again, plain_names  # noqa: E402
from churnlens.session import scratch_path  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    ready(spark)
    return kneser_ney.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; n_chars follows the text. A document
    of which no word is left goes."""
    ready(spark)
    plain, name = plain_names(docs)
    text, chars = F.col(f"`{name['text']}`"), name["n_chars"]
    out = patience_lines.without_common_blocks(plain, name["doc_id"], name["text"])
    out = out.withColumn(chars, F.when(F.col("_l_removed") > 0, F.length(text)).otherwise(F.col(f"`{chars}`")))
    emptied = (F.col("_l_removed") > 0) & ~text.rlike(r"[^\x20\x09-\x0D]")
    return named_again(out.filter(~F.coalesce(emptied, F.lit(False))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    ready(spark)
    return simhash_groups.one_of_each(docs, width=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    ready(spark)
    return template_windows.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    import public_tokenizers
    ready(spark)
    out = bpe_index.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Perplexity, patience diff, XXH64 and BPE have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = scratch_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
