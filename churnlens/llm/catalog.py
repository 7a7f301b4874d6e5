"""The queries opN_<name> over the driver's tables: thin forms of the operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import sql
from churnlens.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def ready(spark: SparkSession) -> None:
    """Lets Python workers of this session import this package from the driver's place for it (on a
    cluster the package comes with --py-files or the image), and sets a checkpoint folder where none is."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    shared_dir(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(remainder: int, parts: int):
    """Whether an id is in the fold; a NULL id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == remainder, F.lit(False))


def op1_patience_lines(spark, sf_dir):
    from churnlens.llm.patience_lines import without_common_blocks
    out = without_common_blocks(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_line_crf(spark, sf_dir):
    from churnlens.llm.line_crf import classify
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(docs, labels, train=~_fold(0, 5))
    return out.select("doc_id", _fold(0, 5).alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


def op3_simhash(spark, sf_dir):
    from churnlens.llm.simhash_groups import near_duplicate_components
    out = near_duplicate_components(documents(spark, sf_dir), width=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_kneser_ney(spark, sf_dir):
    from churnlens.llm.kneser_ney import quality
    return quality(documents(spark, sf_dir))


def op5_token_lengths(spark, sf_dir):
    import public_tokenizers

    from churnlens.llm.token_lengths import length_answers, length_histogram
    histogram = length_histogram(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return length_answers(histogram)


def op6_substring_sketch(spark, sf_dir):
    from churnlens.llm.substring_sketch import remove_repeated_windows
    out = remove_repeated_windows(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_string_kernel(spark, sf_dir):
    from churnlens.llm.string_kernel import identify
    out = identify(documents(spark, sf_dir), train=~_fold(2, 4))
    return out.select("doc_id", _fold(2, 4).alias("held_out"), "lang_pred", "score")


def op8_bpe_index(spark, sf_dir):
    import public_tokenizers

    from churnlens.llm.bpe_index import encode_decode
    out = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_template_windows(spark, sf_dir):
    from churnlens.llm.template_windows import contaminated
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_substring_bwt(spark, sf_dir):
    from churnlens.llm.substring_bwt import remove_repeated_bytes
    out = remove_repeated_bytes(documents(spark, sf_dir), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_groups(spark, sf_dir):
    from churnlens.llm.spelling_groups import spelling_groups, vocabulary
    return spelling_groups(vocabulary(documents(spark, sf_dir))).select("word", "form", "root", "n", "n_near", "form_n")


def op12_source_mix(spark, sf_dir):
    from churnlens.llm.source_mix import mix
    out = mix(documents(spark, sf_dir), keep=["doc_id"]).rows
    return out.select("doc.doc_id", "size", "source_size", "target", "taken")


def op13_seekable_fim(spark, sf_dir):
    from churnlens.llm.seekable_fim import fill_in_middle, seekable
    from churnlens.llm.chunks import written
    docs = documents(spark, sf_dir)
    out = fill_in_middle(written(seekable(docs), "fim-store"), outputs=False)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def pipeline(spark, sf_dir):
    import corpus_pipeline
    ready(spark)
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_patience_lines, op2_line_crf, op3_simhash, op4_kneser_ney, op5_token_lengths, op6_substring_sketch,
        op7_string_kernel, op8_bpe_index, op9_template_windows, op10_substring_bwt,
        op11_spelling_groups, op12_source_mix, op13_seekable_fim, pipeline)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
