"""Global NTILE, top-percentile cutoffs and exact medians by counting selection.

``NTILE(k) OVER (ORDER BY ...)`` with no PARTITION BY makes Spark move the
whole table into a single task. The bucket of a row only depends on the k-1
rows where buckets start, so those are found exactly, and every row gets its
bucket from them by a map-only expression.

Selection. Sort keys become dimensions that order as the key does: 64-bit
integers (a NULL flag, then the value) or, for text, the text itself. One
aggregate gives the row count and the bounds of every dimension. Then, round
by round, each range that holds a wanted rank is cut into bins of equal width
on its first dimension that varies, and ONE aggregate over the table counts the
rows of all bins of all specs, with each bin's smallest and largest value. The
rank falls into one bin, which is the next range. Text is cut six bytes at a
time from the first byte in which the range's smallest and largest text differ,
so neither plan nor rounds follow its length. When the ranges of a spec hold
few rows and one rank each, those rows are read and the rank is looked up.

Cost of a round. A row finds its range through the rounds before it: one
division for its bin and one look-up of the bin in a constant array a round,
whatever the number of ranges or ranks. The number of rounds follows the width of
the keys (about log(range)/log(bins) a key), not rows, ranks or specs, and a value
that fills a third of the table resolves like any other. Only counters and the
few rows of the last ranges reach the driver, both bounded. There is no sample,
no sort and no window. Labels walk the same arrays, and only rows of a last
range are compared with its boundary.

Ordering follows SQL: each :class:`SortKey` has a direction and a NULL
placement (PostgreSQL defaults: ASC NULLS LAST, DESC NULLS FIRST). Rows whose
sort keys tie across a bucket boundary are told apart by a hash of all their
columns, and rows that are equal in every column are counted out, so bucket
sizes never differ by more than one.
"""

from __future__ import annotations

import datetime
import json
import math
import os.path
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of one range at least, and of all open ranges of a spec together.
RANGE_BINS = 256
ROUND_BINS = 8192
#: Copies of equal rows written by one task when a run of them is split.
RUN_COPIES = 1_000_000
#: A group of at most this many rows, or this share of the table, is numbered by a window of its own.
GROUP_ROWS, GROUP_SHARE = 1_000_000, 4096


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True
    nulls_first: bool | None = None  # None: ASC -> NULLS LAST, DESC -> NULLS FIRST

    @property
    def nulls_go_first(self) -> bool:
        return (not self.ascending) if self.nulls_first is None else self.nulls_first

    def spark_order(self) -> Column:
        c = F.col(_ident(self.column))
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_go_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_go_first else c.desc_nulls_last()


def asc(column: str, nulls_first: bool | None = None) -> SortKey:
    return SortKey(column, True, nulls_first)


def desc(column: str, nulls_first: bool | None = None) -> SortKey:
    return SortKey(column, False, nulls_first)


@dataclass(frozen=True)
class _Dim:
    """A column expression (SQL text, never NULL) that orders as a part of a sort key: 64-bit integers or text."""
    sql: str
    ascending: bool
    text: bool = False


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# -- keys as dimensions ----------------------------------------------------------

def _double_sql(c: str) -> list[str]:
    """A double as (signed exponent, signed mantissa); NaN is above all, as in SQL."""
    x = f"coalesce(CAST({c} AS DOUBLE), 0.0D)"
    plain = f"({x} <> 0.0D AND NOT isnan({x}) AND abs({x}) <> double('Infinity'))"
    e = f"least(greatest(floor(log2(abs({x}))), -1074L), 1023L)"
    return [f"CASE WHEN {plain} THEN CAST(signum({x}) AS BIGINT) * ({e} + 2000L) WHEN isnan({x}) THEN 100000L "
            f"WHEN {x} = 0.0D THEN 0L ELSE CAST(signum({x}) AS BIGINT) * 50000L END",
            f"CASE WHEN {plain} THEN CAST({x} / pow(2.0D, {e}) * 9007199254740992.0D AS BIGINT) ELSE 0L END"]


def _double_of(exponent: int, mantissa: int) -> float:
    if exponent in (100000, 50000, -50000):
        return {100000: math.nan, 50000: math.inf, -50000: -math.inf}[exponent]
    return math.ldexp(float(mantissa), abs(exponent) - 2000 - 53) if exponent else 0.0


def _value_sql(c: str, dtype: T.DataType) -> list[str]:
    """The value as 64-bit integers in lexicographic order (NULL if the value is); [] for text."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return [f"CAST({c} AS BIGINT)"]
    if isinstance(dtype, T.DecimalType):
        if dtype.precision <= 18:
            return [f"CAST({c} * {10 ** dtype.scale} AS BIGINT)"]
        digits = f"CAST(replace(CAST({c} AS STRING), '.', '') AS DECIMAL(38,0))"
        limb = "CAST('1{}' AS DECIMAL(38,0))"
        high, low = limb.format("0" * 26), limb.format("0" * 13)
        return [f"({digits} div {high})", f"CAST(({digits} div {low}) % {low} AS BIGINT)" if dtype.precision <= 31
                else f"CAST(({digits} % {high}) div {low} AS BIGINT)", f"CAST({digits} % {low} AS BIGINT)"]
    if isinstance(dtype, T.DateType):
        return [f"CAST(unix_date({c}) AS BIGINT)"]
    if isinstance(dtype, T.TimestampType):
        return [f"unix_micros({c})"]
    if isinstance(dtype, T.FractionalType):
        return _double_sql(c)
    return []


def _dims(df: DataFrame, keys: list[SortKey]) -> list[_Dim]:
    fields = {f.name: f for f in df.schema.fields}
    dims: list[_Dim] = []
    for k in keys:
        f = fields[k.column]
        c = _ident(k.column)
        if f.nullable:  # flag 1 marks NULL; NULLs first means flag descending
            dims.append(_Dim(f"CAST({c} IS NULL AS BIGINT)", not k.nulls_go_first))
        values = _value_sql(c, f.dataType)
        dims += [_Dim(f"coalesce({v}, 0L)" if f.nullable else v, k.ascending) for v in values]
        if not values:
            dims.append(_Dim(f"coalesce(CAST({c} AS STRING), '')", k.ascending, True))
    return dims


def single_number(df: DataFrame, column: str) -> str | None:
    """SQL of a column's value as ONE 64-bit integer that orders as it does (NULL if it is), if its type has one."""
    values = _value_sql(_ident(column), df.schema[column].dataType)
    return values[0] if len(values) == 1 else None


def number_value(number: int, fld: T.StructField):
    """The value that :func:`single_number` made a number of."""
    return _raw((0, number) if fld.nullable else (number,), fld)


def _raw(value: tuple, field: T.StructField):
    """The value of a single sort key from its dimensions."""
    if field.nullable:
        if value[0]:
            return None
        value = value[1:]
    d = field.dataType
    if isinstance(d, T.BooleanType):
        return bool(value[0])
    if isinstance(d, T.IntegralType):
        return value[0]
    if isinstance(d, T.DecimalType):
        whole = value[0] if len(value) == 1 else value[0] * 10 ** 26 + value[1] * 10 ** 13 + value[2]
        return Decimal(whole).scaleb(-d.scale)
    if isinstance(d, T.DateType):
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=value[0])
    if isinstance(d, T.TimestampType):
        return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=value[0])
    if isinstance(d, T.FractionalType):
        return _double_of(*value)
    return value[0]


def _lit(v: int) -> str:
    return f"{v}L" if v > -(2 ** 63) else "(-9223372036854775807L - 1L)"


# -- ranges and the arrays that lead to them ----------------------------------------

#: Bytes of text that one cut tells apart.
_PIECE = 6


def _piece(text: bytes, at: int) -> int:
    """Six bytes of a text from ``at`` as an integer, then how many there are; orders as the texts do."""
    some = text[at: at + _PIECE]
    return int.from_bytes(some.ljust(_PIECE, b"\0"), "big") * 8 + len(some)


def _piece_column(text: Column, at: Column) -> Column:
    raw = text.cast("binary")
    some = F.substring(raw, (at + 1).cast("int"), F.lit(_PIECE))
    return F.conv(F.rpad(F.hex(some), 2 * _PIECE, "0"), 16, 10).cast("long") * 8 + F.octet_length(some)


def _quotient(a: int, b: int) -> int:
    """``a div b`` as SQL has it (toward zero), b > 0."""
    return a // b if a >= 0 else -(-a // b)


class _Range:
    """Rows that share the leading dimensions ``fixed``, with the bounds of the next one."""

    def __init__(self, spec: int, dims: list[_Dim], fixed: tuple, low, high, bounds: list, offset: int, rows: int, targets: list[int]):
        self.spec, self.offset, self.rows, self.targets = spec, offset, rows, targets
        while low == high:                # one value: go on to the next dimension
            fixed = (*fixed, low)
            if len(fixed) == len(dims):
                break
            low, high = bounds[len(fixed)]
        self.fixed = fixed
        self.open = len(fixed) < len(dims)
        if not self.open:
            return
        self.dim = dims[len(fixed)]
        self.low, self.high = low, high
        self.at = 0
        if self.dim.text:
            low, high = low.encode("utf-8", "surrogatepass"), high.encode("utf-8", "surrogatepass")
            self.at = len(os.path.commonprefix([low, high]))
            low, high = _piece(low, self.at), _piece(high, self.at)
        self.cut_low, self.cut_high = low, high

    def cut(self, bins: int) -> None:
        self.width = max(1, (self.cut_high - self.cut_low) // bins)
        self.first = _quotient(self.cut_low, self.width)
        self.slots = _quotient(self.cut_high, self.width) - self.first + 1


def _array(values: list[int]) -> Column:
    """A constant array of integers; the optimizer folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _pick(values: list[int], at: Column) -> Column:
    return F.lit(values[0]).cast("long") if len(set(values)) == 1 else F.get(_array(values), at.cast("int"))


def _done(label: int) -> int:
    """Code of rows whose label is known."""
    return -1 - 2 * label


def _leaf(number: int) -> int:
    """Code of rows that are compared with the boundary of a last range."""
    return -2 - 2 * number


class _Level:
    """One round: its ranges (of all specs) and, per slot, the code of what comes next (a range of the next round, or as above)."""

    def __init__(self, ranges: list[_Range], places: dict[str, int], dims: list[list[_Dim]]):
        self.ranges = ranges
        self.base, total = [], 0
        for r in ranges:
            self.base.append(total)
            total += r.slots
        self.next = [_done(0)] * total
        # which stored column (per spec) holds the dimension of a range
        self.place = [places[r.spec, len(r.fixed)] for r in ranges]
        self.texts = any(r.dim.text for r in ranges)

    def value(self, node: Column, columns: list[Column], text: bool) -> Column | None:
        """The long (or text) that the row's range is cut by."""
        mine = sorted({p for p, r in zip(self.place, self.ranges) if r.dim.text == text})
        if not mine:
            return None
        if len(set(self.place)) == 1:
            return columns[mine[0]]
        which = _pick(self.place, node)
        out = None
        for p in mine:
            out = F.when(which == p, columns[p]) if out is None else out.when(which == p, columns[p])
        return out

    def slot(self, node: Column, columns: list[Column]) -> Column:
        plain, text = self.value(node, columns, False), self.value(node, columns, True)
        if text is not None:
            piece = _piece_column(text, _pick([r.at for r in self.ranges], node))
            plain = piece if plain is None else F.coalesce(plain, piece)
        quotient = F.call_function("div", plain, _pick([r.width for r in self.ranges], node)) if any(r.width > 1 for r in self.ranges) else plain
        return quotient + _pick([b - r.first for b, r in zip(self.base, self.ranges)], node)


def _walk(rows: DataFrame, node: str, levels: list[_Level], columns: list[Column]) -> DataFrame:
    """Replaces the code in column ``node`` by the one behind all ``levels``; steps are separate projections, so
    that nothing is computed twice."""
    for level in levels:
        at = F.col(node)
        rows = rows.withColumn(node, F.when(at >= 0, level.slot(at, columns)).otherwise(at))
        rows = rows.withColumn(node, F.when(at >= 0, F.get(_array(level.next), at.cast("int"))).otherwise(at))
    return rows


# -- selection ---------------------------------------------------------------

@dataclass
class RankSpec:
    """Rows ordered by ``keys`` (restricted to ``where``); find the rows at ``ranks(n)`` (0-based, ascending)."""
    keys: list[SortKey]
    ranks: Callable[[int], list[int]]
    where: Column | None = None
    whole_row: bool = False  # tell rows with equal keys apart by a hash of all columns


@dataclass
class Boundary:
    rank: int      # the rank asked for
    norm: tuple    # its row's dimensions
    first: int     # rank of the first row with these dimensions
    rows: int      # rows with these dimensions


@dataclass
class Selection:
    n: int
    dims: list[_Dim]
    boundaries: list[Boundary] = field(default_factory=list)
    search: "_Search | None" = None
    root: int = -1                # code of every row before the first round

    def position(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds column ``name``: how many boundaries are at or before the row (equal ranks counted each)."""
        return self.search.position(rows, self, name)


def _whole_row(df: DataFrame) -> _Dim:
    return _Dim(f"xxhash64({', '.join(_ident(c) for c in df.columns)})", True)


def _prunable(df: DataFrame, spec: RankSpec, ranges: list[_Range]) -> Column | None:
    """A bound on the raw first key that holds for all rows of the open ranges, if it is a number of one dimension or a date."""
    fld = df.schema[spec.keys[0].column]
    dtype = fld.dataType
    if not (isinstance(dtype, (T.IntegralType, T.DateType)) or (isinstance(dtype, T.DecimalType) and dtype.precision <= 18)):
        return None
    at, lows, highs = int(fld.nullable), [], []
    for r in ranges:
        if len(r.fixed) < at or (at and r.fixed[0] == 1):
            return None
        lows.append(r.fixed[at] if len(r.fixed) > at else r.low)
        highs.append(r.fixed[at] if len(r.fixed) > at else r.high)
    low, high = (F.lit(_raw((0, v) if fld.nullable else (v,), fld)).cast(dtype) for v in (min(lows), max(highs)))
    return (F.col(_ident(fld.name)) >= low) & (F.col(_ident(fld.name)) <= high)


#: Bytes of text that one collect may bring to the driver.
TEXT_BYTES = 16 << 20


class _Search:
    """The rounds of a selection: constant arrays that lead any row of the table to its place among the boundaries."""

    def __init__(self, df: DataFrame, specs: list[RankSpec], bins: int):
        self.df, self.specs, self.bins = df, specs, bins
        self.dims = [_dims(df, s.keys) + ([_whole_row(df)] if s.whole_row else []) for s in specs]
        self.wheres = [None if s.where is None else F.coalesce(s.where, F.lit(False)) for s in specs]
        n_long = max((sum(not d.text for d in ds) for ds in self.dims), default=0)
        n_text = max((sum(d.text for d in ds) for ds in self.dims), default=0)
        self.layout = [False] * n_long + [True] * n_text          # stored columns: is it text
        self.places: dict[tuple[int, int], int] = {}
        for i, ds in enumerate(self.dims):
            used = [0, n_long]
            for j, d in enumerate(ds):
                self.places[i, j] = used[d.text]
                used[d.text] += 1
        self.levels: list[_Level] = []
        self.leaves: list[_Range] = []

    def stored(self, i: int) -> list[Column]:
        """Spec i's dimensions in the order of the stored columns."""
        out = [F.lit("") if text else F.lit(0).cast("long") for text in self.layout]
        for j, d in enumerate(self.dims[i]):
            out[self.places[i, j]] = F.expr(d.sql)
        return out

    def spread(self, rows: DataFrame, roots: dict[int, int]) -> DataFrame:
        """One row per row and spec of ``roots``: n (its code), c0, c1, ..."""
        names = [f"c{p}" for p in range(len(self.layout))]
        each = {i: [F.lit(code).cast("long").alias("n"), *[c.alias(x) for c, x in zip(self.stored(i), names)]] for i, code in roots.items()}
        if len(each) == 1:
            (i, columns), = each.items()
            return (rows if self.wheres[i] is None else rows.filter(self.wheres[i])).select(*columns)
        structs = [F.struct(*c) if self.wheres[i] is None else F.when(self.wheres[i], F.struct(*c)) for i, c in each.items()]
        return rows.select(F.inline(F.array(*structs))).filter("n IS NOT NULL")

    def bounds(self) -> list[tuple[int, list, int]]:
        """Per spec: rows, (low, high) of every dimension, bytes of its longest text. One aggregate."""
        wanted: dict = {}

        def ask(e: Column, key: tuple) -> int:
            return wanted.setdefault(key, (len(wanted), e))[0]

        plan = []
        for i, ds in enumerate(self.dims):
            w = self.wheres[i]
            only = lambda e, w=w: e if w is None else F.when(w, e)
            mark = i if w is not None else -1
            places = [(ask(F.min(only(F.expr(d.sql))), (mark, d.sql, "lo")), ask(F.max(only(F.expr(d.sql))), (mark, d.sql, "hi"))) for d in ds]
            longest = [ask(F.max(only(F.octet_length(F.expr(d.sql)))), (mark, d.sql, "len")) for d in ds if d.text]
            plan.append((ask(F.count(only(F.lit(1))), (mark, "", "n")), places, longest))
        found = self.df.groupBy(F.lit("all")).agg(*[e.alias(f"x{k}") for k, e in wanted.values()]).collect()
        if not found:
            return [(0, [], 0) for _ in plan]
        got = lambda k: found[0][f"x{k}"]
        return [(got(n), [(got(a), got(b)) for a, b in places], max((got(x) or 0 for x in longest), default=0)) for n, places, longest in plan]

    def run(self) -> list[Selection]:
        out = [Selection(0, ds, search=self) for ds in self.dims]
        first = self.bounds()
        few = self.bins * self.bins // 2
        self.wanted: list[list[int]] = []
        now: list[_Range] = []

        def settle(i: int, ranges: list[_Range], assign: Callable) -> None:
            """Gives every range of spec i its code: a last range to be read, or a range of the next round."""
            small = min(few, max(4, TEXT_BYTES // max(1, first[i][2]))) if first[i][2] else few
            read = all(len(r.targets) == 1 for r in ranges) and sum(r.rows for r in ranges) <= small
            for r in ranges:
                if read:
                    assign(r, _leaf(len(self.leaves)))
                    self.leaves.append(r)
                else:
                    assign(r, len(now))
                    now.append(r)

        def closed(r: _Range) -> None:
            out[r.spec].boundaries += [Boundary(t, r.fixed, r.offset, r.rows) for t in r.targets]

        for i, (n, bounds, _) in enumerate(first):
            out[i].n = n
            self.wanted.append(sorted(self.specs[i].ranks(n)))
            if self.wanted[i] and not 0 <= self.wanted[i][0] <= self.wanted[i][-1] < n:
                raise ValueError(f"rank outside [0, {n})")
            if not self.wanted[i]:
                out[i].root = _done(0)
                continue
            root = _Range(i, self.dims[i], (), *bounds[0], bounds, 0, n, self.wanted[i])
            if root.open:
                settle(i, [root], lambda r, code: setattr(out[r.spec], "root", code))
            else:
                out[i].root = _done(bisect_left(self.wanted[i], n))
                closed(root)
        while now:
            ranges, now = now, []
            self._cut(ranges, first)
            level = _Level(ranges, self.places, self.dims)
            self.levels.append(level)
            stats = self._counts(level, out)
            children: dict[int, list] = {}
            for k, r in enumerate(ranges):
                before, left, all_targets = r.offset, r.targets, self.wanted[r.spec]
                slots = range(level.base[k], level.base[k] + r.slots)
                for slot in slots if r.dim.ascending else reversed(slots):
                    if slot not in stats:
                        continue
                    n, low, high = stats[slot]
                    mine = left[:bisect_left(left, before + n)]
                    left = left[len(mine):]
                    level.next[slot] = _done(bisect_left(all_targets, before + n))
                    if mine:
                        child = _Range(r.spec, self.dims[r.spec], r.fixed, low, high, first[r.spec][1], before, n, mine)
                        if child.open:
                            children.setdefault(r.spec, []).append((slot, child))
                        else:
                            closed(child)
                    before += n
            for i, mine in children.items():
                slot_of = {id(r): s for s, r in mine}
                settle(i, [r for _, r in mine], lambda r, code, at=slot_of: level.next.__setitem__(at[id(r)], code))
        if self.leaves:
            self._read(out)
        for o in out:
            o.boundaries.sort(key=lambda x: x.rank)
        return out

    def _cut(self, ranges: list[_Range], first: list) -> None:
        per: dict[int, int] = {}
        for r in ranges:
            per[r.spec] = per.get(r.spec, 0) + 1
        whole = min(ROUND_BINS, self.bins * 32, max(self.bins, 4 * ROUND_BINS // len(per)))
        for r in ranges:
            bins = max(self.bins, whole // per[r.spec])
            if r.dim.text:                      # their smallest and largest texts come to the driver
                bins = min(bins, max(2, TEXT_BYTES // (2 * max(1, first[r.spec][2]) * per[r.spec])))
            r.cut(bins)

    def _rows(self, ranges: list[_Range]) -> DataFrame:
        mine: dict[int, list[_Range]] = {}
        for r in ranges:
            mine.setdefault(r.spec, []).append(r)
        bounds = [_prunable(self.df, self.specs[i], rs) for i, rs in mine.items()]
        if any(b is None for b in bounds):
            return self.df
        either = bounds[0]
        for b in bounds[1:]:
            either = either | b
        return self.df.filter(either)

    def _counts(self, level: _Level, out: list[Selection]) -> dict[int, tuple]:
        """slot -> rows, smallest and largest value of what its range is cut by. One aggregate over the table."""
        roots = {r.spec: out[r.spec].root for r in level.ranges}
        rows = self.spread(self._rows(level.ranges), roots)
        columns = [F.col(f"c{p}") for p in range(len(self.layout))]
        rows = _walk(rows, "n", self.levels[:-1], columns)
        # Rows that are settled share the slot NULL, one counter a task: a filter on n would be pushed below
        # the steps, each written out many times over.
        plain, text = (level.value(F.col("n"), columns, t) for t in (False, True))
        values = [v.alias(x) for v, x in ((plain, "v"), (text, "t")) if v is not None]
        rows = rows.select(F.when(F.col("n") >= 0, level.slot(F.col("n"), columns)).alias("slot"), *values)
        aggs = [F.count(F.lit(1)).alias("rows")]
        for v, x in ((plain, "v"), (text, "t")):
            if v is not None:
                aggs += [F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}")]
        of = [None] * len(level.next)
        for k, r in enumerate(level.ranges):
            of[level.base[k]: level.base[k] + r.slots] = ["t" if r.dim.text else "v"] * r.slots
        return {x["slot"]: (x["rows"], x[f"lo_{of[x['slot']]}"], x[f"hi_{of[x['slot']]}"]) for x in rows.groupBy("slot").agg(*aggs).collect() if x["slot"] is not None}

    def _read(self, out: list[Selection]) -> None:
        """The rows of the last ranges, equal ones counted; gives each its boundary."""
        roots = {r.spec: out[r.spec].root for r in self.leaves}
        columns = [f"c{p}" for p in range(len(self.layout))]
        rows = _walk(self.spread(self._rows(self.leaves), roots), "n", self.levels, [F.col(c) for c in columns])
        mine = (F.col("n") < 0) & (F.col("n") % 2 == 0)       # all other rows: one counter a task, as above
        rows = rows.select(*[F.when(mine, F.col(c)).alias(c) for c in ("n", *columns)])
        found: dict[int, list] = {}
        for x in rows.groupBy("n", *columns).agg(F.count(F.lit(1)).alias("rows")).collect():
            if x["n"] is not None:
                found.setdefault((-2 - x["n"]) // 2, []).append(x)
        for k, leaf in enumerate(self.leaves):
            dims = self.dims[leaf.spec]
            mine = [(tuple(x[f"c{self.places[leaf.spec, j]}"] for j in range(len(dims))), x["rows"]) for x in found[k]]
            for j in reversed(range(len(dims))):
                mine.sort(key=lambda x, j=j: x[0][j].encode("utf-8", "surrogatepass") if dims[j].text else x[0][j], reverse=not dims[j].ascending)
            before, rank = leaf.offset, leaf.targets[0]
            for norm, n in mine:
                if rank < before + n:
                    leaf.boundary = norm
                    out[leaf.spec].boundaries.append(Boundary(rank, norm, before, n))
                    break
                before += n

    def position(self, rows: DataFrame, s: Selection, name: str) -> DataFrame:
        i = next(k for k, ds in enumerate(self.dims) if ds is s.dims)
        taken = {c.lower() for c in rows.columns}
        prefix = "__q"
        while any(c.startswith(prefix) for c in taken):
            prefix += "_"
        columns = [f"{prefix}{p}" for p in range(len(self.layout))]
        out = rows.select("*", F.lit(s.root).cast("long").alias(name), *[c.alias(x) for c, x in zip(self.stored(i), columns)])
        out = _walk(out, name, self.levels, [F.col(c) for c in columns])
        # A column that Spark does not take for deterministic keeps filters on the label above the steps. The code is
        # never NULL for an ordered row, so the other value is never used.
        out = out.withColumn(name, F.coalesce(F.col(name), F.spark_partition_id().cast("long")))
        code = F.col(name)
        label = F.shiftright(-1 - code, 1)
        mine = [r for r in self.leaves if r.spec == i]
        if mine:
            at = F.shiftright(-2 - code, 1)
            less = F.lit(False)
            for j in reversed(range(len(s.dims))):
                p = self.places[i, j]
                values = [r.boundary[j] if r.spec == i else ("" if s.dims[j].text else 0) for r in self.leaves]
                v = F.get(F.from_json(F.lit(json.dumps(values)), "array<string>"), at.cast("int")) if s.dims[j].text else _pick(values, at)
                x = F.col(columns[p])
                less = (x < v if s.dims[j].ascending else x > v) | ((x == v) & less)
            before = [bisect_left(self.wanted[r.spec], r.targets[0]) for r in self.leaves]
            label = F.when(code % 2 == 0, _pick(before, at) + F.when(less, 0).otherwise(1)).otherwise(label)
        return out.select(*[F.col(_ident(c)) for c in rows.columns], label.cast("int").alias(name))


def select_ranks(df: DataFrame, specs: list[RankSpec], bins: int = RANGE_BINS) -> list[Selection]:
    """The rows at the wanted ranks of each spec: one aggregate over the table per round, for all specs."""
    return _Search(df, specs, bins).run() if specs else []


# -- operators on the selection ------------------------------------------------

def ntile_starts(n: int, k: int) -> list[int]:
    """0-based first ranks of buckets 2..k of NTILE(k) over n rows (existing buckets only).

    The first ``n mod k`` buckets hold ``n div k + 1`` rows, the rest ``n div k``.
    """
    q, r = divmod(n, k)
    starts = []
    for j in range(1, k):          # bucket j+1 starts after j buckets
        s = j * q + min(j, r)
        if s >= n:
            break
        starts.append(s)
    return starts


@dataclass
class NtileSpec:
    name: str
    keys: list[SortKey]
    k: int


def _same(dims: list[_Dim], values: tuple) -> Column:
    out = F.lit(True)
    for d, v in zip(dims, values):
        out = out & (F.expr(d.sql) == (F.lit(v) if d.text else F.expr(_lit(v))))
    return out


def _split_runs(df: DataFrame, labelled: DataFrame, names: list[str], torn: list[tuple[str, Selection, list[int]]]) -> DataFrame:
    """Counts out rows that are equal in every column where a boundary falls among them.

    Equal rows are the same row: each run is one group, written again with numbers 0..n-1, in pieces;
    rows of other runs keep their labels. torn: (name, selection, label of each boundary)."""
    name_of = {n: F.col(_ident(n)) for n in names}
    cond = F.lit(False)
    for name, s, marks in torn:
        runs: dict[tuple, list] = {}
        label = 1
        for b, mine in zip(s.boundaries, marks):
            # the copies before the run's first boundary belong to the bucket before it
            runs.setdefault(b.norm, [(0, label)]).append((b.rank - b.first, mine))
            label = mine
        for v, cuts in runs.items():
            if cuts[-1][0] == 0:
                continue
            same = _same(s.dims, v)
            number = F.lit(cuts[0][1])
            for at, value in cuts[1:]:
                number = F.when(F.col("__i") >= at, F.lit(value)).otherwise(number)
            name_of[name] = F.when(same, number).otherwise(name_of[name])
            cond = cond | same
    columns = [F.col(_ident(c)) for c in df.columns]
    marked = labelled.withColumn("__torn", cond)     # before any column of that name could be made
    grouped = marked.filter("__torn").groupBy(*columns, *[F.col(_ident(n)) for n in names]).agg(F.count(F.lit(1)).alias("__n"))
    pieces = grouped.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / RUN_COPIES)))).repartition("__p")
    copies = pieces.withColumn("__i", F.explode(F.sequence(F.col("__p") * RUN_COPIES, F.least((F.col("__p") + 1) * RUN_COPIES, F.col("__n")) - 1)))
    rest = marked.filter("NOT __torn").select(*columns, *[F.col(_ident(n)) for n in names])
    return rest.unionByName(copies.select(*columns, *[name_of[n].cast("int").alias(n) for n in names]))


@dataclass
class Labels:
    """Boundaries found once; ``apply`` labels the table they were found on, or any rows with its columns."""
    columns: list[str]
    parts: list[tuple[str, Selection, list[int]]]     # name, selection, label from each boundary on
    where: Column | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        out, names = df, []
        for name, s, marks in self.parts:
            out = s.position(out, name)
            if marks == list(range(2, len(marks) + 2)):
                label = F.col(_ident(name)) + 1
            else:
                label = _pick([1, *marks], F.col(_ident(name)))
            label = label.cast("int")
            out = out.withColumn(name, label if self.where is None else F.when(self.where, label))
            names.append(name)
        torn = [p for p in self.parts if any(b.rank > b.first for b in p[1].boundaries)]
        return _split_runs(df, out, names, torn) if torn else out


def _fit(df: DataFrame, specs: list[tuple[str, list[SortKey], Callable]], where: Column | None, bins: int) -> Labels:
    """Per spec, ``starts(n)`` gives ascending (rank, label) pairs; a row gets the label of the last start at or
    before it (1 before the first)."""
    plans = [RankSpec(keys, lambda n, f=starts: [r for r, _ in f(n)], where) for _, keys, starts in specs]
    found = select_ranks(df, plans, bins)
    again = [i for i, s in enumerate(found) if any(b.rank > b.first for b in s.boundaries)]
    if again:  # keys tie across a boundary: order those rows by a hash of the whole row
        for i in again:
            plans[i].whole_row = True
        for i, s in zip(again, select_ranks(df, [plans[i] for i in again], bins)):
            found[i] = s
    return Labels(df.columns, [(name, s, [x for _, x in starts(s.n)]) for (name, _, starts), s in zip(specs, found)], where)


def fit_ntiles(df: DataFrame, specs: list[NtileSpec], where: Column | None = None, bins: int = RANGE_BINS) -> Labels:
    """The boundaries of ``NTILE(k) OVER (ORDER BY keys)`` of each spec: found once, applied as often as wanted."""
    return _fit(df, [(s.name, s.keys, lambda n, k=s.k: [(r, j + 2) for j, r in enumerate(ntile_starts(n, k))]) for s in specs], where, bins)


def with_ntiles(df: DataFrame, specs: list[NtileSpec], where: Column | None = None, bins: int = RANGE_BINS) -> DataFrame:
    """Add ``NTILE(k) OVER (ORDER BY keys)`` columns computed over the whole table.

    ``where`` restricts the ordered rows (as a WHERE before the window); rows outside it get NULL."""
    return fit_ntiles(df, specs, where, bins).apply(df)


def with_ntiles_by(df: DataFrame, by: str, specs: list[NtileSpec], bins: int = RANGE_BINS, group_rows: int | None = None) -> DataFrame:
    """``NTILE(k) OVER (PARTITION BY by ORDER BY keys)`` for any number of groups, NULL being one.

    A group of at most ``group_rows`` rows (default: a million, or the table's 4,096th part if that is more) is
    numbered by a window partitioned by the column, so a window task never sorts more. Larger groups, at most
    4,096 of them, lead the sort keys of one selection over their rows: all are selected in the same scans, and
    none is moved. Only the sizes of the larger groups reach the driver."""
    group = F.col(_ident(by))
    sizes = df.groupBy(group.alias("__group")).agg(F.count(F.lit(1)).alias("__size"))
    if group_rows is None:
        total = sizes.agg(F.sum("__size").alias("n")).collect()[0]["n"] or 0
        group_rows = max(GROUP_ROWS, total // GROUP_SHARE)
    large = sizes.filter(F.col("__size") > group_rows).orderBy(F.col("__group").asc_nulls_last()).collect()
    if not large:
        return _windows(df, by, specs)

    values = [r["__group"] for r in large if r["__group"] is not None]
    dtype = df.schema[by].dataType
    known = F.coalesce(group.isin(*[F.lit(v).cast(dtype) for v in values]), F.lit(False)) if values else F.lit(False)
    is_large = known | group.isNull() if len(values) < len(large) else known

    def starts(k: int) -> Callable:
        marks, at = [], 0
        for r in large:
            marks += [(at, 1)] * bool(at) + [(at + x, j + 2) for j, x in enumerate(ntile_starts(r["__size"], k))]
            at += r["__size"]
        return lambda n: marks

    many = df.filter(is_large)
    labelled = _fit(many, [(s.name, [asc(by), *s.keys], starts(s.k)) for s in specs], None, bins).apply(many)
    return labelled.unionByName(_windows(df.filter(~is_large), by, specs))


def _windows(df: DataFrame, by: str, specs: list[NtileSpec]) -> DataFrame:
    """Groups of bounded size: one exchange by the column, a sort per spec; rows whose keys tie by their hash."""
    last = F.xxhash64(*[F.col(_ident(c)) for c in df.columns])
    return df.select("*", *[F.ntile(s.k).over(Window.partitionBy(_ident(by)).orderBy(*[k.spark_order() for k in s.keys], last)).alias(s.name) for s in specs])


def global_ntile(df: DataFrame, name: str, order: list[SortKey], k: int, by: str | None = None, **tuning) -> DataFrame:
    """``NTILE(k) OVER ([PARTITION BY by] ORDER BY order)`` as column ``name``."""
    spec = [NtileSpec(name, list(order), k)]
    return with_ntiles(df, spec, **tuning) if by is None else with_ntiles_by(df, by, spec, **tuning)


def top_bucket_cutoff(df: DataFrame, column: str, k: int = 100, **tuning):
    """Smallest value in the last bucket of ``NTILE(k) OVER (ORDER BY column)``.

    Returns None when that bucket does not exist (fewer than k rows) or holds
    only NULLs (ASC order puts NULLs last). Every row with ``column >=
    cutoff`` has its value in the last bucket, so deleting "values found in
    the last bucket" equals deleting ``column >= cutoff``.
    """
    found = select_ranks(df, [RankSpec([asc(column)], lambda n: [n - n // k] if n >= k else [])], **tuning)[0]
    return _raw(found.boundaries[0].norm, df.schema[column]) if found.boundaries else None


def exact_medians(df: DataFrame, columns: list[str], **tuning) -> dict[str, tuple | None]:
    """Middle value(s) of each column (NULLs ignored): {col: (lo, hi)} or None if no value.

    ``PERCENTILE_CONT(0.5)`` is ``(lo + hi) / 2``; lo == hi for an odd count.
    """
    found = select_ranks(df, [RankSpec([asc(c)], lambda n: sorted({(n - 1) // 2, n // 2}) if n else [], F.col(_ident(c)).isNotNull()) for c in columns], **tuning)
    return {c: (_raw(s.boundaries[0].norm, df.schema[c]), _raw(s.boundaries[-1].norm, df.schema[c])) if s.boundaries else None
            for c, s in zip(columns, found)}


def median_value(pair: tuple | None) -> float | None:
    """``(lo + hi) / 2`` as the double nearest the exact midpoint's conversion."""
    if pair is None:
        return None
    lo, hi = pair
    return float(lo + hi) / 2.0
