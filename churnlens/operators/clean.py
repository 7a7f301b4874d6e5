"""Cleaning: deletes by predicate, top-percentile trimming, the ordered pipeline.

A DELETE becomes a pair of DataFrames, (kept, removed). A row is removed
only where the predicate is TRUE; FALSE and NULL keep it, as in SQL.

"Delete every row whose value occurs in the last NTILE(100) bucket" is
rewritten to ``value >= cutoff`` where ``cutoff`` is the smallest value in
that bucket (:func:`churnlens.operators.quantile.top_bucket_cutoff`): the
same rows, found with a distributed selection rather than a global sort,
and applied as a literal filter that reaches the parquet scan.

The pipeline keeps each step's removal predicate with literal cutoffs, so
the cleaned table is the input plus a handful of pushed-down filters (short
lineage, nothing to checkpoint), and per-step counts are one aggregate.

Its cutoffs need few scans: after one aggregate of bounds, every scan counts
the largest values of ALL columns still to be trimmed over the rows that are
left so far. The next cutoff is exact in it if its bin holds one value; the
counts of the later columns tell where to look next, in bins narrow enough to
be exact when their turn comes.

A delete by any set of values is a semi and an anti join (SQL's IN: a NULL on
either side matches nothing, so such rows stay).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import fixed
from churnlens.operators.quantile import number_value, single_number, top_bucket_cutoff

#: Bins in which one scan counts the largest values of a column.
TAIL_BINS = 8192


def kept_by(predicate: Column) -> Column:
    """TRUE exactly where a DELETE with ``predicate`` keeps the row (FALSE or NULL).

    Written as ``NOT p OR p IS NULL`` (never NULL itself) rather than
    ``NOT coalesce(p, false)`` so that Catalyst can push it into the scan.
    """
    return ~predicate | predicate.isNull()


def delete_where(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) for ``DELETE ... WHERE predicate``; a filter drops NULL, as DELETE does."""
    return df.filter(kept_by(predicate)), df.filter(predicate)


def delete_where_in(df: DataFrame, column: str, values) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) for ``DELETE ... WHERE column IN (values)``; values: a DataFrame of one column, or a list.

    IN is TRUE only where the value equals one of the set: rows with a NULL stay, a NULL in the set removes
    nothing, an empty set removes nothing. The set is made distinct first; Spark broadcasts it only if its size
    is under the session's threshold, else both sides are shuffled by value, and a hot value is split by AQE."""
    name = "__in"
    while name in df.columns:
        name += "_"
    if isinstance(values, DataFrame):
        if len(values.columns) != 1:
            raise ValueError(f"IN takes one column, got {values.columns}")
        listed = values.select(values[values.columns[0]].alias(name))
    else:
        dtype = df.schema[column].dataType
        listed = df.sparkSession.createDataFrame([(v,) for v in values], f"`{name}` {dtype.simpleString()}")
    listed = listed.filter(F.col(name).isNotNull()).distinct()
    same = F.col(f"`{column}`") == F.col(name)
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def top_percentile_predicate(df: DataFrame, column: str, k: int = fixed.PERCENTILE_BUCKETS,
                             **tuning) -> Column:
    """Predicate of ``column IN (values in the last NTILE(k) bucket)``."""
    cutoff = top_bucket_cutoff(df, column, k, **tuning)
    if cutoff is None:
        return F.lit(False)
    return F.col(column) >= F.lit(cutoff).cast(df.schema[column].dataType)


def trim_top_percentile(df: DataFrame, column: str, k: int = fixed.PERCENTILE_BUCKETS,
                        **tuning) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) after deleting rows whose value falls in the top 1/k bucket."""
    return delete_where(df, top_percentile_predicate(df, column, k, **tuning))


@dataclass(frozen=True)
class Step:
    name: str
    column: str
    kind: str            # "equals", "greater", "top_percentile"
    value: object = None


# FIXED VALUES: the cleaning steps, in the order they run.
CLEANING_STEPS = (
    Step("customer_age = 73", "customer_age", "equals", fixed.AGE_OUTLIER),
    Step("months_inactive top percentile", "months_inactive", "top_percentile"),
    Step("contacts_count top percentile", "contacts_count", "top_percentile"),
    Step("total_amt_change_q4_q1 top percentile", "total_amt_change_q4_q1", "top_percentile"),
    Step("total_trans_amt top percentile", "total_trans_amt", "top_percentile"),
    Step("total_trans_ct > 133", "total_trans_ct", "greater", fixed.TRANS_CT_LIMIT),
    Step("total_ct_change_q4_q1 top percentile", "total_ct_change_q4_q1", "top_percentile"),
    Step("total_ct_change_q4_q1 = 0", "total_ct_change_q4_q1", "equals", 0),
)


def step_predicate(df: DataFrame, step: Step, **tuning) -> Column:
    c = F.col(step.column)
    if step.kind == "equals":
        return c == F.lit(step.value)
    if step.kind == "greater":
        return c > F.lit(step.value)
    if step.kind == "top_percentile":
        return top_percentile_predicate(df, step.column, **tuning)
    raise ValueError(step.kind)


@dataclass
class Cleaning:
    source: DataFrame
    steps: tuple
    removals: list = field(default_factory=list)   # predicate per step (TRUE = removed there)

    def kept_after(self, i: int) -> Column:
        """TRUE for rows still present after the first ``i`` steps."""
        cond = F.lit(True)
        for r in self.removals[:i]:
            cond = cond & kept_by(r)
        return cond

    @property
    def table(self) -> DataFrame:
        return self.source.filter(self.kept_after(len(self.removals)))

    def removed_rows(self) -> DataFrame:
        """Every removed row with the step that removed it (like RETURNING * per step)."""
        step = None
        for i, (s, r) in enumerate(zip(self.steps, self.removals), start=1):
            step = (F.when(r, F.lit(i)) if step is None else step.when(r, F.lit(i)))
        name = None
        for i, s in enumerate(self.steps, start=1):
            name = (F.when(F.col("step") == i, F.lit(s.name)) if name is None
                    else name.when(F.col("step") == i, F.lit(s.name)))
        out = self.source.withColumn("step", step.cast("int")).filter(F.col("step").isNotNull())
        return out.select("step", name.alias("step_name"), *self.source.columns)

    def step_counts(self) -> DataFrame:
        """rows_left / rows_removed after each step, from ONE aggregate over the input."""
        aggs = [F.count(F.lit(1)).alias("k0")]
        for i in range(1, len(self.removals) + 1):
            aggs.append(F.count(F.when(self.kept_after(i), F.lit(1))).alias(f"k{i}"))
        agg = self.source.agg(*aggs)
        rows = [F.struct(F.lit(0).alias("step"), F.lit("start").alias("step_name"),
                         F.col("k0").alias("rows_left"), F.lit(0).cast("bigint").alias("rows_removed"))]
        for i, s in enumerate(self.steps, start=1):
            rows.append(F.struct(F.lit(i).alias("step"), F.lit(s.name).alias("step_name"),
                                 F.col(f"k{i}").alias("rows_left"),
                                 (F.col(f"k{i - 1}") - F.col(f"k{i}")).alias("rows_removed")))
        return agg.select(F.inline(F.array(*rows)))


@dataclass
class _Tail:
    """The part of a column's values that the next scan counts in bins."""
    column: str
    number: str          # SQL of the value as an integer
    low: int
    high: int

    def width(self, bins: int) -> int:
        return max(1, -(-(self.high - self.low + 1) // bins))

    def slot(self, bins: int) -> str:
        """SQL: bin of the row; -1 below, -2 NULL, ``bins`` above."""
        v, low, high = self.number, f"CAST({self.low} AS DECIMAL(20,0))", f"CAST({self.high} AS DECIMAL(20,0))"
        place = f"CAST((CAST({v} AS DECIMAL(20,0)) - {low}) div {self.width(bins)} AS BIGINT)" if self.high - self.low >= 2 ** 62 else f"({v} - ({self.low})) div {self.width(bins)}"
        return f"CASE WHEN {v} IS NULL THEN -2L WHEN {v} < {low} THEN -1L WHEN {v} > {high} THEN {bins}L ELSE {place} END"


def _tail_counts(df: DataFrame, tails: list[_Tail], bins: int) -> list[dict[int, tuple]]:
    """Per tail: slot -> (rows, smallest, largest value). One aggregate over the table."""
    each = [F.struct(F.lit(i).alias("i"), F.expr(t.slot(bins)).alias("slot"), F.expr(t.number).alias("v")) for i, t in enumerate(tails)]
    rows = df.select(F.inline(F.array(*each))).groupBy("i", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out: list[dict[int, tuple]] = [{} for _ in tails]
    for r in rows.collect():
        out[r["i"]][r["slot"]] = (r["n"], r["lo"], r["hi"])
    return out


def _from_top(counts: dict[int, tuple], wanted: int, bins: int) -> tuple | None:
    """The bin that holds the ``wanted``-th value from the top of the bins; None if it lies below them."""
    for slot in sorted((s for s in counts if 0 <= s < bins), reverse=True):
        wanted -= counts[slot][0]
        if wanted <= 0:
            return counts[slot]
    return None


def _counted_cutoffs(cl: Cleaning, k: int, bins: int) -> None:
    """All steps of ``cl``; each scan serves the step at hand and looks ahead for the later ones."""
    df = cl.source
    columns = [s.column for s in cl.steps if s.kind == "top_percentile"]
    number = {c: single_number(df, c) for c in columns}
    ends = df.groupBy(F.lit("all")).agg(*[f(F.expr(number[c])).alias(f"{x}{i}") for i, c in enumerate(columns) for f, x in ((F.min, "lo"), (F.max, "hi"))]).collect()
    bounds = [(ends[0][f"lo{i}"], ends[0][f"hi{i}"]) if ends else (None, None) for i in range(len(columns))]
    waiting = [_Tail(c, number[c], lo, hi) if lo is not None else None for c, (lo, hi) in zip(columns, bounds)]
    whole = list(bounds)
    done = 0
    for step in cl.steps:
        if step.kind != "top_percentile":
            cl.removals.append(step_predicate(df, step))
            continue
        left, cutoff = df.filter(cl.kept_after(len(cl.removals))), None
        while waiting[done] is not None:
            asked = [i for i in range(done, len(columns)) if waiting[i] is not None]
            counts = _tail_counts(left, [waiting[i] for i in asked], bins)
            tail, mine = waiting[done], counts[0]
            n = sum(c[0] for c in mine.values())
            wanted = n // k - mine.get(-2, (0,))[0]        # NULLs sort last: they fill the last bucket first
            for i, c in zip(asked[1:], counts[1:]):        # look ahead: the top values, with room for what still goes
                t, seen = waiting[i], _from_top(c, 4 * (n // k) - c.get(bins, (0,))[0], bins)
                if seen is not None and t.width(bins) > 1:
                    waiting[i] = _Tail(t.column, t.number, seen[1], whole[i][1])
            if wanted <= 0:
                break
            above = mine.get(bins, (0,))[0]
            hit = _from_top(mine, wanted - above, bins)
            if above >= wanted:                            # the rank is above the bins, or below them: look there
                waiting[done] = _Tail(tail.column, tail.number, tail.high + 1, whole[done][1])
            elif hit is None:
                waiting[done] = _Tail(tail.column, tail.number, whole[done][0], tail.low - 1)
            elif hit[1] == hit[2]:
                cutoff = hit[1]
                break
            else:
                waiting[done] = _Tail(tail.column, tail.number, hit[1], hit[2])
        done += 1
        fld = df.schema[step.column]
        cl.removals.append(F.lit(False) if cutoff is None else F.col(step.column) >= F.lit(number_value(cutoff, fld)).cast(fld.dataType))


def clean(df: DataFrame, steps=CLEANING_STEPS, k: int = fixed.PERCENTILE_BUCKETS, bins: int = TAIL_BINS) -> Cleaning:
    """Run the ordered deletes; each cutoff is computed on the table left by earlier steps."""
    cl = Cleaning(df, tuple(steps))
    trimmed = [s.column for s in steps if s.kind == "top_percentile"]
    if trimmed and all(single_number(df, c) for c in trimmed):
        _counted_cutoffs(cl, k, bins)
        return cl
    for step in steps:                                     # text or wide keys: one selection a step
        current = df.filter(cl.kept_after(len(cl.removals)))
        cl.removals.append(step_predicate(current, step, k=k) if step.kind == "top_percentile" else step_predicate(current, step))
    return cl
