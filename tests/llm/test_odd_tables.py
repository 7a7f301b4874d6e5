"""Every operator and every stage on a table with clashing columns, NULLs, repeated rows and a very long text, and on an empty one."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlens.llm import (catalog, line_crf, source_mix, string_kernel)

#: Names that the operators use inside.
CLASHES = ("k", "y", "r", "h", "g", "d", "fp", "part", "chunk", "keys", "words", "word", "sig", "size", "key", "run", "holder", "doc", "rid",
           "_s_id", "_s_rid", "_q_text", "_q_lang", "_q_kept", "_l_gone", "_l_id", "_l_removed", "_b_text", "_b_items", "0", "1", "a.b")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)


def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n"]) for _ in range(n))
    long_text = text(700_000)[:5_000_000]
    shared = text(150)
    texts = [None, "", " \n\t", long_text, shared, shared, shared + " " + text(60), "<P> " + text(70), "1 2 3", "é" * 300]
    texts += [text(rng.randint(1, 300)) for _ in range(25)]
    extra = lambda i: [-(i % 7) if c not in ("_s_id", "k") else -5 for c in CLASHES]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", None]), len(t or ""), *extra(i)) for i, t in enumerate(texts)]
    out += [(None, shared, "en", "a", 0, *extra(0)), (None, None, None, None, None, *([None] * len(CLASHES))), out[6], out[6], out[12]]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """An input folder whose documents are the odd table."""
    catalog.ready(spark)
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "Anna sold 12 crates of apples last year and 7 crates of pears in the same shop, how many crates is that?"), (2, ""), (3, None)],
                          "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory, folder):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{path}/{name}.parquet")
    return path


BY_DOCUMENT = [n for n in catalog.queries() if n.startswith("op") and n not in ("op5_token_lengths", "op11_spelling_groups")]


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n.startswith("op")))
def test_operators_on_odd_rows(spark, folder, name):
    out = catalog.queries()[name](spark, folder).collect()
    if name in BY_DOCUMENT:
        assert len(out) == len(rows())
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in rows())
    if name in ("op2_line_crf", "op7_string_kernel"):
        assert all(isinstance(r["held_out"], bool) for r in out)


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n.startswith("op")))
def test_operators_on_empty_tables(spark, empty_folder, name):
    assert catalog.queries()[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, folder, empty_folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    if name == "encoding":
        assert out.count() == len(rows())
    else:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before = {str(r[:1] + r[2:4] + r[5:]) for r in rows()}      # what a stage keeps it keeps as it was, but for text and n_chars
        got = [str(tuple(r)[:1] + tuple(r)[2:4] + tuple(r)[5:]) for r in out.collect()]
        assert got and set(got) <= before
    assert stage(spark, spark.read.parquet(f"{empty_folder}/documents.parquet"), empty_folder).count() == 0


def test_one_id_on_all_training_rows(spark):
    """Language: every language is learned though all its rows have one id, or are one row."""
    catalog.ready(spark)
    words = {"aa": "karo tima lupo sena", "bb": "wxyz qqvw zzxk vvyq", "cc": "einer zweier dreier vierer"}
    rows = [(7, f"{text} {text[: i % 9 + 1]} {text}", lang) for lang, text in words.items() for i in range(6000)]
    rows += [(8, "ööö äää üüü ööä", "dd")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    out = string_kernel.identify(docs, train=F.lit(True)).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in out} == {"aa": 6000, "bb": 6000, "cc": 6000, "dd": 6000}


def test_training_lines_are_bounded(spark):
    catalog.ready(spark)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('line of text ', id, '\\n'), IF(id % 2 = 0, 10, 3)) AS text", "id AS k", "id AS y")
    labels = spark.range(300).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    field = line_crf.fit(docs, labels, F.lit(True), "doc_id", "text", "quality", 4000, max_lines=100)
    assert field is not None
    assert line_crf.fit(docs, labels, F.lit(True), "doc_id", "text", "quality", 4000, max_lines=16) is None
    assert line_crf.classify(docs, labels, train=F.lit(True)).count() == 300


def test_mix_keeps_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = source_mix.mix(docs)
    assert mixed.rows.select("doc.*").columns == docs.columns
    assert source_mix.mixed_texts(mixed).count() > 0
