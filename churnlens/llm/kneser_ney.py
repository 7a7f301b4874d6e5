"""Quality rules with an n-gram perplexity verdict.

Symbols are the bytes of the text as they stand: each of the 256 is its own
symbol, so case, digits, marks and every character of any script count. Spark
counts the n-grams of every language
over all documents: tasks count their share, and the counts of ``FAN`` tasks are
added up at a time, per range of n-grams. From
the counts a modified Kneser-Ney model is made: three discounts per order,
continuation counts below the highest order. A model is a set of sorted arrays
of n-gram hashes (the n-gram as a base-``ALPHABET`` number, so no two
collide) with their probabilities and back-off weights.

Beside the model of the bytes stands one of their shapes (letters without case,
one digit, kinds of punctuation, the parts of longer characters). A position's
shape n-gram follows from its byte n-gram, so it is counted from the same
counts, and one look-up gives the probabilities under both.

Every language has a model and a band of its own, however few documents it
has. Its model is mixed with the model of all text, which has ``SHARED``
symbols' weight, so a language of little text leans on it. Null languages use
the model of all text.

Size: the distinct n-grams of ``MAX_LANGUAGES`` languages and of all text are
collected and broadcast at once; their number follows the text (ALPHABET**ORDER
a language would be all). More languages take more passes, each over its own
languages' documents.

Every document gets its log perplexity of bytes and of shapes. A language's band
is its median plus and minus ``width`` robust deviations and an allowance that
shrinks with the length; outside of either band a document is rejected: the bytes
tell what is unlike the language's text, the shapes runs of marks whichever marks
they are. Medians come from an exact
histogram of perplexities in steps of 1/``STEPS``.

Defined results: null text has no words, so base_failed. Text without symbols
has no perplexity and follows the base rules. A document's row depends only on
its text and lang, so repeated rows agree. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import chunks as C
from churnlens.llm import textops as T

ORDER = 4
#: Languages whose models are held at once.
MAX_LANGUAGES = 32
#: Weight of the model of all text in a language's model, in symbols.
SHARED = 5000
#: Band: median +- (WIDTH * deviation + SHORT / sqrt(symbols)).
WIDTH = 4.0
SHORT = 1.0
#: Steps of the perplexity histogram per nat, and its range in nats.
STEPS, TOP = 1000, 40
POOLED = ""
_PARTS = 8
#: Counts of tasks that one reducer adds up.
FAN = 16
BATCH_BYTES = 1 << 20


ALPHABET = 256
#: Shapes of symbols.
SHAPES = 47


def _shapes() -> np.ndarray:
    """Symbol -> shape. 0 space, 1-26 letters, 27 digit, 28-33 punctuation, 34 other, 35-38 lead bytes, 39-46 continuation bytes."""
    fold = np.full(256, 34, np.uint8)
    fold[list(T.SPACES)] = 0
    for i in range(26):
        fold[ord("a") + i] = fold[ord("A") + i] = 1 + i
    fold[ord("0"): ord("9") + 1] = 27
    for i, kind in enumerate((".!?", ",;:", "'\"`", "()[]{}", "-_/\\", "#*$%&|<>@^~+=")):
        fold[[ord(c) for c in kind]] = 28 + i
    for b in range(128, 192):
        fold[b] = 39 + (b & 7)
    for b in range(192, 256):
        fold[b] = 35 + (b >> 4) - 12
    out = np.empty(256, np.int64)
    out[folded(np.arange(256, dtype=np.uint8))] = fold
    return out


def folded(buf: np.ndarray) -> np.ndarray:
    """Symbols of the bytes, one for each: the byte with bit 5 flipped, which makes space 0."""
    return (buf ^ np.uint8(ord(" "))).astype(np.int64)


SHAPE = _shapes()


def shape_codes(codes: np.ndarray) -> np.ndarray:
    """The n-grams of shapes of n-grams of symbols."""
    out = np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        out += SHAPE[codes // ALPHABET ** k % ALPHABET] * SHAPES ** k
    return out


def ngram_codes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at every byte; before a document's start stands space."""
    sym = folded(buf)
    code = sym.copy()
    pos = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        earlier = np.zeros_like(sym)
        earlier[k:] = sym[:-k]
        earlier[pos < k] = 0
        code += earlier * ALPHABET ** k
    return code


_CONTINUATION = bytes(range(0x80, 0xC0))


def base_figures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    marks = len(text) - len(text.translate(None, b"#*$%&|<>"))
    solid = text.translate(None, T.SPACES)
    chars = len(solid.translate(None, _CONTINUATION))
    lines = [x for x in text.split(b"\n") if x.strip(T.SPACES)]
    repeat = 0
    if n > 3:
        number = T.Index()
        ids = np.array(list(map(number.__getitem__, words)), np.int64)
        base = np.int64(len(number))
        if len(number) < n:
            if base < 2_000_000:
                grams = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
            else:  # three numbers do not fit one: the first two are numbered anew
                pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
                grams = pairs[:-1] * base + ids[2:]
            again = C.member(C.repeated_values(np.sort(grams)), grams)
            if again.any():
                repeat = int(T.covered(np.flatnonzero(again), 3, n).sum())
    return n, chars, marks, len(lines) - len(set(lines)), repeat


class Model:
    """Modified Kneser-Ney over symbols, in sorted arrays per order; mixed with ``pool`` if given."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pool: "Model | None" = None, alphabet: int = ALPHABET):
        self.pool, self.share, self.alphabet = None, 0.0, alphabet
        grams, n = codes, counts.astype(np.int64)
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((order, grams, n))
            if order > 1:  # continuation counts: how many symbols precede each shorter n-gram
                grams, n = np.unique(grams % self.alphabet ** (order - 1), return_counts=True)
        self.grams, self.prob, self.context, self.weight = {}, {}, {}, {}
        for order, grams, n in reversed(levels):
            of_count = [max(1, int((n == k).sum())) for k in (1, 2, 3, 4)]
            y = of_count[0] / (of_count[0] + 2 * of_count[1])
            discount = np.array([0.0] + [min(max(k - (k + 1) * y * of_count[k] / of_count[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)])
            off = discount[np.minimum(n, 3)]
            context, at = np.unique(grams // self.alphabet, return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(context))
            self.context[order] = context
            self.weight[order] = np.bincount(at, weights=off, minlength=len(context)) / total
            lower = self._lookup(order - 1, grams % self.alphabet ** (order - 1))
            self.grams[order] = grams
            self.prob[order] = (n - off) / total[at] + self.weight[order][at] * lower
        if pool is not None:
            self.pool, self.share = pool, SHARED / (SHARED + float(counts.sum()))
            self.prob[ORDER] = (1 - self.share) * self.prob[ORDER] + self.share * pool.probability(self.grams[ORDER])

    def _lookup(self, order: int, codes: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(codes), 1.0 / self.alphabet)
        grams = self.grams[order]
        at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        out = self.prob[order][at]
        missing = np.flatnonzero(grams[at] != codes)
        if len(missing):
            few = codes[missing]
            context, weight = self.context[order], self.weight[order]
            at = np.minimum(np.searchsorted(context, few // self.alphabet), len(context) - 1)
            scale = np.where(context[at] == few // self.alphabet, weight[at], 1.0)
            out[missing] = scale * self._lookup(order - 1, few % self.alphabet ** (order - 1))
            if order == ORDER and self.pool is not None:  # the n-grams that it has are mixed already
                out[missing] = (1 - self.share) * out[missing] + self.share * self.pool.probability(few)
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self._lookup(ORDER, codes)


class Models:
    """A language's models, of its bytes and of their shapes, with the log probabilities of its n-grams under both."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pool: "Models | None" = None):
        self.bytes = Model(codes, counts, pool and pool.bytes)
        self.shapes = Model(*_summed([shape_codes(codes)], [counts]), pool and pool.shapes, SHAPES)
        self.codes, self.logs = codes, self._logs(codes)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        return np.log([self.bytes.probability(codes), self.shapes.probability(shape_codes(codes))])

    def logs_of(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of any n-grams: a row for bytes, a row for shapes."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        out = self.logs[:, at]
        missing = np.flatnonzero(self.codes[at] != codes)
        if len(missing):
            out[:, missing] = self._logs(codes[missing])
        return out


def languages(docs: DataFrame, lang_col: str = "lang") -> list[str]:
    """All languages, the most frequent ones first."""
    named = docs.select(F.col(lang_col).cast("string").alias("l")).filter("l IS NOT NULL")
    return [r["l"] for r in named.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").collect()]


def _groups(column: pa.Array, known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(x, 0) for x in column.to_pylist()], np.int64)


def fit(docs: DataFrame, names: list[str], text_col: str = "text", lang_col: str = "lang") -> dict[int, Model]:
    """Language number (0: all text) -> model of bytes, from the n-gram counts of all documents."""
    return {g: m.bytes for _, models in passes(docs, names, text_col, lang_col) for g, m in models.items()}


def passes(docs: DataFrame, names: list[str], text_col: str = "text", lang_col: str = "lang") -> Iterator[tuple[dict[str, int], dict[int, Models]]]:
    """The languages in portions of MAX_LANGUAGES: their numbers, and their models with that of all text (0)."""
    lows = range(0, max(len(names), 1), MAX_LANGUAGES)
    counted = _counts(docs, names, text_col, lang_col).checkpoint()

    def portion(low: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        codes: dict[int, list] = {}
        mine = (F.col("part") >= (low + 1 if low else 0) * _PARTS) & (F.col("part") < (low + MAX_LANGUAGES + 1) * _PARTS)
        for r in sorted(counted.filter(mine).collect(), key=lambda r: r["part"]):
            codes.setdefault(r["part"] // _PARTS, []).append((C.unpack(r["width"], r["keys"]).astype(np.int64), np.frombuffer(r["extra"], np.int64)))
        return {g: (np.concatenate([k for k, _ in x]), np.concatenate([n for _, n in x])) for g, x in codes.items()}

    pooled = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in lows:
        per = portion(low)
        pooled = _summed([pooled[0], *(k for k, _ in per.values())], [pooled[1], *(n for _, n in per.values())])
    pool = Models(*pooled) if len(pooled[0]) else None
    for low in lows:
        if len(lows) > 1:
            per = portion(low)
        models = {g: Models(*x, pool) for g, x in per.items() if g}
        yield {x: low + i + 1 for i, x in enumerate(names[low: low + MAX_LANGUAGES])}, models | ({0: pool} if pool else {})


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts added."""
    keys, at = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


class _Tally:
    """The n-gram counts of one task, per language; batches are added up before they are sent."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.size: dict[int, int] = {}

    def add(self, g: int, codes: np.ndarray) -> None:
        keys, n = np.unique(codes, return_counts=True)
        self.held.setdefault(g, []).append((keys, n))
        self.size[g] = self.size.get(g, 0) + len(keys)
        if self.size[g] > 2 * len(self.held[g][0][0]) + BATCH_BYTES:
            self.settle(g)

    def settle(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        keys, n = _summed([k for k, _ in self.held[g]], [n for _, n in self.held[g]])
        self.held[g], self.size[g] = [(keys, n)], len(keys)
        return keys, n


def _counts(docs: DataFrame, names: list[str], text_col: str, lang_col: str) -> DataFrame:
    """n-grams and counts of every language, in _PARTS key ranges: a task sends its own sums, and ``FAN`` of them are
    added up at a time, in as many rounds as that takes, so no reducer's input grows with the corpus."""
    known = {x: i + 1 for i, x in enumerate(names)}
    top = ALPHABET ** ORDER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, task = _Tally(), TaskContext.get().partitionId()
        for batch in batches:
            buf, offsets = T.as_bytes(batch.column("text"))
            of = _groups(batch.column("lang"), known)
            for lo, hi in T.blocks(offsets):
                o = offsets[lo: hi + 1] - offsets[lo]
                codes = ngram_codes(buf[offsets[lo]: offsets[hi]], o).astype(np.uint32)
                owner = np.repeat(of[lo:hi], np.diff(o))
                for g in np.unique(owner).tolist():
                    tally.add(g, codes[owner == g])
        for g in sorted(tally.held):
            keys, n = tally.settle(g)
            at = np.searchsorted(keys, [top * i // _PARTS for i in range(_PARTS + 1)])
            rows = [(g * _PARTS + r, task, *C.pack(keys[lo:hi].astype(np.uint64)), n[lo:hi].tobytes()) for r, (lo, hi) in enumerate(zip(at[:-1], at[1:])) if hi > lo]
            yield from C.blob_rows(rows).to_batches()

    def add(table: pa.Table) -> pa.Table:
        keys, n = _summed([C.unpack(w, k) for w, k in zip(table["width"].to_pylist(), table["keys"].to_pylist())],
                          [np.frombuffer(x, np.int64) for x in table["extra"].to_pylist()])
        return C.blob_rows([(table["part"][0].as_py(), table["chunk"][0].as_py(), *C.pack(keys), n.tobytes())])

    found = C.written(docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(count, C.BLOB_SCHEMA), "ngrams")
    tasks = (found.agg(F.max("chunk")).first()[0] or 0) + 1
    while tasks > 1:
        found = found.withColumn("chunk", F.floor(F.col("chunk") / FAN)).groupBy("part", "chunk").applyInArrow(add, C.BLOB_SCHEMA)
        tasks = -(-tasks // FAN)
    return found


def _log_perplexities(batch_text: pa.Array, of: np.ndarray, models: dict[int, Models]) -> tuple[np.ndarray, np.ndarray]:
    """(log perplexities of bytes and of shapes, symbols) per text; NaN for a text without symbols."""
    buf, offsets = T.as_bytes(batch_text)
    out = np.full((2, len(of)), np.nan)
    size = np.diff(offsets)
    for lo, hi in T.blocks(offsets):
        b, o = buf[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        if not len(b):
            continue
        codes = ngram_codes(b, o)
        owner = np.repeat(of[lo:hi], size[lo:hi])
        total = np.zeros((2, len(b) + 1))
        for g in np.unique(of[lo:hi][size[lo:hi] > 0]).tolist():
            mine = np.flatnonzero(owner == g)
            total[:, mine + 1] = models[g].logs_of(codes[mine])
        np.cumsum(total, axis=1, out=total)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, lo:hi] = -(total[:, o[1:]] - total[:, o[:-1]]) / size[lo:hi]
    return out, size


def scored(docs: DataFrame, models, known: dict[str, int], keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` as given, with q: the figures, the language's number, log perplexities (null: none) and symbols."""
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    text_in = text_col if text_col in keep else "_q_text"        # a text that is kept is sent once
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"_q_{f} long" for f in fields] + ["_q_group int", "_q_symbols long", "_q_log double", "_q_shape double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = T.as_bytes(batch.column(text_in))
            for lo, hi in T.blocks(offsets, BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                of = _groups(part.column("_q_lang"), known)
                logs, size = _log_perplexities(part.column(text_in), of, shipped.value)
                rows = [base_figures(x) for x in part.column(text_in).cast(pa.binary()).to_pylist()]
                figures = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + figures + [pa.array(of, pa.int32()), pa.array(size, pa.int64()), *(pa.array(x, from_pandas=True) for x in logs)],
                    names=[*keep, *(f"_q_{f}" for f in fields), "_q_group", "_q_symbols", "_q_log", "_q_shape"])

    more = [] if text_in == text_col else [F.col(f"`{text_col}`").alias("_q_text")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], *more, F.col(f"`{lang_col}`").cast("string").alias("_q_lang")).mapInArrow(run, ", ".join(ddl))


#: What has a band: the perplexity of bytes, that of shapes.
VIEWS = ("_q_log", "_q_shape")


def bands(rows: DataFrame) -> list[dict[int, tuple[float, float]]]:
    """For each view, language number -> (median, deviation) of log perplexity, over documents that pass the base rules."""
    step = lambda c: F.least(F.floor(F.col(c) * STEPS), F.lit(TOP * STEPS)).cast("int")
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("view"), step(c).alias("s")) for i, c in enumerate(VIEWS)]))
    counted = (rows.filter("_q_log IS NOT NULL").filter(~base_failed()).select("_q_group", both.alias("at"))
               .groupBy("_q_group", "at.view", "at.s").agg(F.count(F.lit(1)).alias("n")))
    per: dict[tuple[int, int], list] = {}
    for r in counted.collect():  # at most TOP * STEPS + 1 rows a language and view
        per.setdefault((r["view"], r["_q_group"]), []).append((r["s"], r["n"]))
    out: list[dict[int, tuple[float, float]]] = [{} for _ in VIEWS]
    for (view, g), x in per.items():
        s, n = (np.array(v, np.int64) for v in zip(*sorted(x)))
        middle = s[np.searchsorted(np.cumsum(n), (n.sum() + 1) // 2)]
        off = np.abs(s - middle)
        order = np.argsort(off, kind="stable")
        out[view][g] = ((middle + 0.5) / STEPS, 1.4826 * (off[order][np.searchsorted(np.cumsum(n[order]), (n.sum() + 1) // 2)] + 0.5) / STEPS)
    return out


def base_failed():
    return (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))


def verdict(rows: DataFrame, limits: list[dict[int, tuple[float, float]]]) -> DataFrame:
    """Adds _q_base_failed, the bands for the document's language and length (_q_log_low, _q_log_high, and the same of
    _q_shape) and _q_kept."""
    def pick(of: dict[int, tuple[float, float]], i: int):
        if not of:
            return F.lit(None).cast("double")
        return F.element_at(F.create_map(*[F.lit(v) for g, x in sorted(of.items()) for v in (g, float(x[i]))]), F.col("_q_group"))

    rows, kept = rows.withColumn("_q_base_failed", base_failed()), ~F.col("_q_base_failed")
    for c, of in zip(VIEWS, limits):
        room = F.lit(WIDTH) * pick(of, 1) + F.lit(SHORT) / F.sqrt(F.greatest(F.col("_q_symbols"), F.lit(1)))
        rows = rows.withColumn(f"{c}_low", pick(of, 0) - room).withColumn(f"{c}_high", pick(of, 0) + room)
        kept &= F.coalesce(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")), F.lit(True))
    return rows.withColumn("_q_kept", kept)


def _of_pass(docs: DataFrame, known: dict[str, int], names: list[str], lang_col: str) -> DataFrame:
    """The documents of a pass: those of its languages; the first pass has those without one, too."""
    if len(known) == len(names):
        return docs
    lang = F.col(lang_col).cast("string")
    mine = lang.isin(list(known))
    return docs.filter(mine | lang.isNull() if min(known.values()) == 1 else mine)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base figures, base_failed, kept, log_perplexity and its band, and those of shapes."""
    names = languages(docs, lang_col)
    parts = []
    for known, models in passes(docs, names, text_col, lang_col):
        rows = scored(_of_pass(docs, known, names, lang_col), models, known, [id_col], text_col, lang_col).checkpoint()
        parts.append(verdict(rows, bands(rows)))
    out = reduce(DataFrame.union, parts)
    return out.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"_q_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col("_q_log").alias("log_perplexity"), F.col("_q_log_low").alias("band_low"), F.col("_q_log_high").alias("band_high"),
        F.col("_q_shape").alias("shape_perplexity"), F.col("_q_shape_low").alias("shape_low"), F.col("_q_shape_high").alias("shape_high"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns that they had.

    Texts are scored twice, for the bands and for the filter: that moves no text, where a join by id would."""
    plain, name = C.plain_names(docs)
    text_col, lang_col = name[text_col], name[lang_col]
    names = languages(plain, lang_col)
    parts = []
    for known, models in passes(plain, names, text_col, lang_col):
        mine = _of_pass(plain, known, names, lang_col)
        limits = bands(scored(mine, models, known, [], text_col, lang_col))
        rows = scored(mine, models, known, plain.columns, text_col, lang_col)
        parts.append(C.named_again(verdict(rows, limits).filter("_q_kept"), docs))
    return reduce(DataFrame.union, parts)
