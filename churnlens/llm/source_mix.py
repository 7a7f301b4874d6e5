"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets. Sources are ranked by name and weigh 1, 2, 3, repeating; a target is the smaller of ``MAX_EPOCHS`` times the
source's size and level x weight, with the one level at which all targets add up to the total (the limit of sharing
the excess again and again). Ratios size / weight are sorted, running totals give the level in one step.

Selection. A source is repeated in whole epochs as long as its target holds it; of the rest every document has the
key -ln(u) / weight (u a hash of seed, id and text; weight its quality), and documents are taken in ascending order of
key until the words add up. Where that happens is found by counting: the keys of a source are cut into ranges, one
map-side combined aggregate sums the words of every range, running totals over sorted ranges name the one in which
the budget ends, and so on until a range has at most ``RANGE_DOCS`` documents, which are sorted and added up one by
one. A row then needs its source's cut key alone: below it the document is taken whole, above it not, and documents that have the cut key
(one, or equal rows) share what is left in proportion to their size, so a source misses its target by less than one
word a document of that key. No source, however large, is sorted in one task, and only per-source figures are joined.

Odd input: NULL and empty texts have size 0 and take nothing; a NULL doc_id is an id of its own; equal rows have equal keys
and are treated alike, so no order among them matters; the NULL source is the last; input columns stay under a struct,
so no name clashes. An empty table gives an empty result; all sizes 0 give targets 0. Reruns agree on any cluster:
nothing depends on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.chunks import written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 12
#: Documents of one source, or sources, that are sorted together at most; a wider range is counted in bins first.
RANGE_DOCS = 2_000
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def letter_quality(text: str = "text") -> Column:
    """A quality weight from the text alone: the share of bytes that are letters of any script, spaces or plain
    punctuation, to the fourth power, from 0.01 to 1. Symbols and digits lower it; an empty text has 0.01."""
    t = F.coalesce(F.col(text), F.lit(""))
    odd = F.octet_length(t) - F.octet_length(F.translate(t, "0123456789#*$%&|<>=+_~^{}[]\\/@", ""))
    share = 1 - odd / F.greatest(F.octet_length(t), F.lit(1))
    return F.when(F.octet_length(t) == 0, F.lit(0.01)).otherwise(F.greatest(F.pow(share, F.lit(4.0)), F.lit(0.01)))


# -- running totals of any number of rows -----------------------------------------

def running_totals(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds per name the total of its expression over all rows before this one in ``order`` (a total order), in two steps:
    inside sorted parts of some thousands of rows, then over the parts' totals."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // RANGE_DOCS))
    dealt = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in order]).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "mix-parts")               # the borders of parts are sampled: hold them
    totals = dealt.groupBy("_part").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = totals.select("_part", *[F.coalesce(F.sum(n).over(before), zero).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(e).over(inside), zero).alias(f"_in_{n}") for n, e in sums.items()]).join(totals, "_part")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return out.select(*kept, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size), one row a source, the NULL source included."""
    n = len(weights)
    one = F.lit(1).cast("long")
    ranked = running_totals(sizes, ["source"], {"rank": one})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % n + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), "rank"), "mix-weights")
    whole = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, all_weight = int(whole["t"] or 0), int(whole["w"] or 0)
    full = F.lit(max_epochs).cast("long") * F.col("source_size")
    # sources in ascending order of the level that fills them: as long as the level is above, they are full
    ratio = ranked.withColumn("ratio", full / F.col("weight"))
    before = running_totals(ratio, ["ratio", "rank"], {"full_before": full, "weight_before": F.col("weight")})
    level = (F.lit(float(total)) - F.col("full_before")) / (F.lit(float(all_weight)) - F.col("weight_before"))
    # the first source that the rest's level does not fill fixes that level
    found = before.filter(F.col("ratio") >= level).agg(F.min_by(level, F.struct("ratio", "rank")).alias("level")).first()["level"] if all_weight else None
    share = F.lit(float(found if found is not None else 0.0)) * F.col("weight")
    return ranked.select("source", "source_size", "weight", F.least(full.cast("double"), share).alias("target"))


# -- selection -----------------------------------------------------------------------

@dataclass
class Mix:
    """``rows``: docs (struct of the input columns), size, source_size, target, epochs, taken."""
    rows: DataFrame
    sources: DataFrame


def _uniform(seed: int) -> Column:
    """A number strictly between 0 and 1 from seed, id and text; equal rows have equal numbers."""
    h = F.xxhash64(F.lit(seed), F.col("doc.doc_id").cast("string"), F.col("doc.doc_id").isNull(), F.col("doc.text"), F.col("doc.text").isNull())
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, keep: list[str] | None = None) -> Mix:
    """How many words the mix takes of every document. ``quality``: positive weight of a document (an expression on the
    columns of ``docs``); ``keep``: columns that the result's struct ``doc`` carries (all by default)."""
    kept = list(docs.columns) if keep is None else keep
    w = F.greatest(F.coalesce(letter_quality() if quality is None else quality, F.lit(0.01)), F.lit(1e-9))
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "doc_id", "text", "source"])]).alias("doc"), word_count().alias("size"), w.alias("w"))
    key = -F.log(_uniform(seed)) / F.col("w")
    rows = read.select(F.struct(*[F.col(f"doc.`{c}`") for c in kept]).alias("doc"), F.col("doc.source").alias("source"), "size", key.alias("key"))
    rows = written(rows, "mix-rows")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.min("key").alias("low"), F.max("key").alias("high"))
    per = written(per, "mix-sources")
    sources = targets(per.select("source", "source_size"), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs).cast("long"))).otherwise(F.lit(0).cast("long"))
    same = per.source.eqNullSafe(F.col("_source"))
    renamed = sources.select(F.col("source").alias("_source"), "target")
    per = per.join(renamed, same).drop("_source").withColumn("epochs", epochs)
    per = written(per.withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))), "mix-budgets")

    # Where the words of each source reach what is left, by counting: a range of keys is cut into bins, one aggregate
    # sums them, and the bin with the budget's end is the next range, until it has few documents or one key.
    budgets = per.filter("left > 0").select("source", "left", F.col("low").alias("lo"), F.col("high").alias("hi"), F.lit(0).cast("long").alias("before"), "docs")
    wide = (F.col("docs") > RANGE_DOCS) & (F.col("hi") > F.col("lo"))
    state = written(budgets, "mix-range")
    while not state.filter(wide).isEmpty():
        inside = _in_range(rows, state.filter(wide))
        at = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        sums = inside.groupBy("source", at.alias("bin")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.min("key").alias("lo"), F.max("key").alias("hi"),
            F.first("left").alias("left"), F.first("before").alias("base"))
        chosen = _first_over(sums, "bin").select("source", "left", "lo", "hi", "before", "docs")
        state = written(chosen.unionByName(state.filter(~wide)), "mix-range")
    keys = _in_range(rows, state).groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("before").alias("base"))
    cuts = _first_over(keys, "key").select(F.col("source").alias("_source"), F.col("key").alias("cut"), (F.col("left") - F.col("before")).alias("rest"), F.col("words").alias("cut_words"))
    per = written(per.join(cuts, per.source.eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-cuts")

    joined = rows.join(per.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "cut", "rest", "cut_words"), rows.source.eqNullSafe(F.col("_source")))
    extra = (F.when(F.col("key") < F.col("cut"), F.col("size"))
             .when(F.col("key") == F.col("cut"), F.expr("CAST(floor(CAST(size AS DECIMAL(38,0)) * rest / cut_words) AS BIGINT)")).otherwise(F.lit(0)))
    taken = F.col("epochs") * F.col("size") + F.coalesce(extra, F.lit(0)).cast("long")
    return Mix(joined.select("doc", "size", "source_size", "target", "epochs", taken.alias("taken")), sources)


def _in_range(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows whose key lies in their source's range [lo, hi]."""
    state = state.withColumnRenamed("source", "_source")
    return rows.join(state, rows.source.eqNullSafe(F.col("_source")) & F.col("key").between(F.col("lo"), F.col("hi"))).drop("_source")


def _first_over(sums: DataFrame, by: str) -> DataFrame:
    """Per source, the first row in order of ``by`` with which the running total of words (from ``base``) reaches
    ``left``, and the total ``before`` it. The rows are aggregates: bins, or the distinct keys of one range."""
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.sum("words").over(upto) + F.col("base")).withColumn("before", F.col("upto") - F.col("words"))
    return run.filter((F.col("upto") >= F.col("left")) & (F.col("before") < F.col("left")) & (F.col("words") > 0))


def mixed_texts(mixed: Mix) -> DataFrame:
    """The mix itself: the columns of the documents, ``epoch`` from 1, and ``text`` cut after the words taken in that
    epoch (white space before a word stays with it). Documents that the mix does not take have no row."""
    rows = mixed.rows.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    mine = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(mine == F.col("size"), F.col("doc.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), mine.cast("int")), ""))
    columns = [c for c in rows.schema["doc"].dataType.names if c != "text"]
    return rows.select(*[F.col(f"doc.`{c}`") for c in columns], "epoch", text.alias("text"), mine.alias("words"))
