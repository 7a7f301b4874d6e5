"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word is the binary vector of its (letter, occurrence) pairs. One replaced code point moves that vector by a
Hamming distance of two and leaves the length; one inserted or deleted code point moves it by one and the length
by one. The dimensions are dealt into ``PARTS`` parts. Vectors at distance two agree on all parts but two, those
at distance one on all but one, so words that share no signature (length, parts left out, the rest of the vector)
are no variants: signatures are exact, not a sample. Projections are sums of random 64-bit values of their
dimensions, so a collision only adds a candidate. Words that share a signature are compared in full: they are one
edit apart exactly if common prefix and common suffix together cover the longer word but one.

Plan. The vocabulary is one map-side combined count, written once. Signature groups are first counted over classes
of equal vectors (anagrams are one row there). A signature of more than ``GROUP`` words never meets in one task:
before the exchange its words are dealt out again by (signature, word without one code point), whose groups the
alphabet bounds. What is left is one exchange by signature, sorted, compared in bounded batches. A word has at most
alphabet x length near words, so grouping by word has no hot key. Forms grow tenfold a step; roots follow by
pointer doubling in about log2(log10(n)) rounds, each written in the shared folder.

Odd input: a NULL text has no words; a NULL doc_id counts as the empty string in the hash; repeated rows count again;
other columns are never read, whatever they are called; an empty table gives an empty result. A run may be as long
as its text: long words are compared by array, not packed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.chunks import written
from churnlens.llm.textops import as_bytes, inverse_powers, mix, powers

#: Parts of the dimensions: 10 signatures that leave out two parts, 2 x 5 that leave out one.
PARTS = 5
#: Words of one signature that are compared with each other; more are dealt out by a second key.
GROUP = 1024
#: Letters of a packed word: two 64-bit values from its start and two from its end.
PACKED = 16
#: Signature rows compared at once.
BATCH_ROWS = 1 << 16

_BASE = 0xD1342543DE82EF95
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- vocabulary ----------------------------------------------------------------

def vocabulary(docs: DataFrame, min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of which each 31st (by the crc32 of id and run) loses one
    code point; at least ``min_chars`` code points and ``min_count`` occurrences. A run that is too short before
    the deletion is too short after it, so the pattern asks for ``min_chars`` letters at once."""
    pattern = F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % min_chars)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col("text"), pattern, F.lit(0))).alias("x"))
    runs = runs.select("d", F.when(F.col("x").rlike("[A-Z]"), F.translate("x", _UPPER, _LOWER)).otherwise(F.col("x")).alias("x"))
    h = F.crc32(F.concat("d", F.lit(":"), "x"))
    at = F.pmod(F.col("h"), F.length("x")).cast("int")
    cut = F.concat(F.substring("x", F.lit(1), at), F.substring(F.col("x"), at + 2, F.length("x")))
    word = F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("x"))
    return (runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


# -- signatures ----------------------------------------------------------------

def letters(column) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of words whose letters are below U+0100, one byte each."""
    buf, offsets = as_bytes(column)
    wide = buf == 0xC3                              # the only lead byte of U+00C0 to U+00FF
    points = buf.copy()
    points[1:][wide[:-1]] += 64
    before = np.concatenate([[0], np.cumsum(~wide)])
    return points[~wide], before[offsets]


def part_sums(points: np.ndarray, offsets: np.ndarray, parts: int) -> np.ndarray:
    """Per word and part, the sum of the random values of the word's dimensions in that part."""
    n = len(offsets) - 1
    word = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((points, word))
    key = (word[order].astype(np.int64) << 8) | points[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    value = mix((key & 255).astype(np.uint64) + (rank.astype(np.uint64) << np.uint64(8)) + np.uint64(_BASE))
    part = ((value >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    out = np.zeros((n, parts), np.uint64)
    np.add.at(out, (word[order], part), value)
    return out


def _measured(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = part_sums(*letters(b["word"]), parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], *[pa.array(sums[:, p]) for p in range(parts)]], ["word", "n", *[f"s{p}" for p in range(parts)]])
    return run


def _signatures(parts: int) -> Column:
    """All signatures of a row (len, s0, s1, ...); the lowest bit tells replacements (0) from insertions (1)."""
    sums = [F.col(f"s{p}") for p in range(parts)]

    def signature(left_out: tuple, length: Column, kind: int) -> Column:
        rest = F.xxhash64(length, *[s for p, s in enumerate(sums) if p not in left_out], *[F.lit(p) for p in left_out])
        return rest.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.lit(kind).cast("long"))

    replaced = [signature(out, F.col("len"), 0) for out in itertools.combinations(range(parts), 2)]
    inserted = [signature((p,), F.col("len") - less, 1) for p in range(parts) for less in (0, 1)]
    return F.array(*replaced, *inserted)


# -- comparison ----------------------------------------------------------------

def _pack(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, backwards: bool) -> np.ndarray:
    """(n, 2) 64-bit values: the first (or last, in reverse order) ``PACKED`` letters, zeros behind."""
    at = np.arange(PACKED)
    inside = at < lengths[:, None]
    place = starts[:, None] + (lengths[:, None] - 1 - at if backwards else at)
    out = np.where(inside, points[np.where(inside, place, 0)], 0).astype(np.uint8) if len(points) else np.zeros((len(starts), PACKED), np.uint8)
    return out.view("<u8")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading letters in which packed words agree."""
    out = np.zeros(len(x), np.int64)
    going = np.ones(len(x), bool)
    for j in range(x.shape[1]):
        d = x[:, j] ^ y[:, j]
        same = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        out += np.where(going, same, 0)
        going &= same == 8
    return out


def _agree_long(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def near_pairs(points: np.ndarray, offsets: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of equal neighbouring ``sig`` whose words are one edit apart. Signatures of the kind 0
    pair words of equal length, those of the kind 1 words of lengths that differ by one."""
    n = len(sig)
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    lengths = np.diff(offsets)
    fore, back = (_pack(points, offsets[:-1], lengths, x) for x in (False, True))
    apart = sig & 1
    found_i, found_j = [], []
    live, step = np.arange(n), 0
    while True:
        step += 1
        live = live[live + step < ends[live]]
        if not len(live):
            break
        i, j = live, live + step
        fits = np.abs(lengths[i] - lengths[j]) == apart[i]
        i, j = i[fits], j[fits]
        longer = np.maximum(lengths[i], lengths[j])
        short = longer <= PACKED
        near = np.zeros(len(i), bool)
        si, sj = i[short], j[short]
        both = _agree(fore[si], fore[sj]) + _agree(back[si], back[sj])
        near[short] = (both >= longer[short] - 1) & ((fore[si] != fore[sj]).any(axis=1) if len(si) else True)
        for x in np.flatnonzero(~short):
            a, b = points[offsets[i[x]]: offsets[i[x] + 1]], points[offsets[j[x]]: offsets[j[x] + 1]]
            near[x] = _agree_long(a, b) + _agree_long(a[::-1], b[::-1]) >= longer[x] - 1 and not np.array_equal(a, b)
        found_i.append(i[near])
        found_j.append(j[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


NEAR_SCHEMA = "word string, other string, other_n long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, word, n) sorted by sig -> both directions of every near pair of a signature."""
    names = ["word", "other", "other_n"]
    held: pa.Table | None = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        word, n = table["word"].combine_chunks(), table["n"].combine_chunks()
        i, j = near_pairs(*letters(word), table["sig"].to_numpy())
        for a, b in ((i, j), (j, i)):
            yield pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))], names)

    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < BATCH_ROWS:
            continue
        sig = held["sig"].to_numpy()
        cut = int(np.searchsorted(sig, sig[-1]))     # the last signature may go on in the next batch
        if cut:
            yield from pairs(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield from pairs(held)


def _of_length(n: int) -> np.uint64:
    return np.uint64(n * _BASE & (2**64 - 1))


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, word, n) of hot signatures -> one row per distinct hash of the word without one code point
    (replacement and longer side of an insertion) or of the whole word (shorter side)."""
    for b in batches:
        points, offsets = letters(b["word"])
        kind = b["sig"].to_numpy() & 1
        sigs, rows = [], []
        for r in range(b.num_rows):
            c = points[offsets[r]: offsets[r + 1]].astype(np.uint64) + np.uint64(1)
            total = np.concatenate([[np.uint64(0)], np.cumsum(c * powers(_BASE, len(c)))])
            keys = total[:-1] + (total[-1] - total[1:]) * inverse_powers(_BASE, 2)[1] + _of_length(len(c) - 1)
            if kind[r]:
                keys = np.append(keys, total[-1] + _of_length(len(c)))
            keys = mix(np.unique(keys) ^ mix(np.array([b["sig"][r].as_py()], np.int64).view(np.uint64)))
            sigs.append((keys & ~np.uint64(1) | np.uint64(kind[r])).view(np.int64))
            rows.append(len(keys))
        take = pa.array(np.repeat(np.arange(b.num_rows), np.array(rows, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)), b["word"].take(take), b["n"].take(take)], ["sig", "word", "n"])


def near_words(words: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """(word, other, other_n): every ordered pair of distinct words one edit apart, once."""
    sums = [f"s{p}" for p in range(parts)]
    measured = words.mapInArrow(_measured(parts), "word string, n long, " + ", ".join(f"{s} long" for s in sums))
    measured = measured.withColumn("len", F.length("word"))
    signed = measured.select("word", "n", F.explode(_signatures(parts)).alias("sig"))
    classes = measured.groupBy("len", *sums).agg(F.count(F.lit(1)).alias("c"))
    hot = (classes.select("c", F.explode(_signatures(parts)).alias("sig")).groupBy("sig").agg(F.sum("c").alias("c"))
           .filter(F.col("c") > group).select("sig", F.lit(True).alias("hot")))
    hot = written(hot, "spelling-hot")
    n_hot = hot.count()
    if n_hot:
        tagged = signed.join(hot, "sig", "left")
        apart = tagged.filter("hot").select("sig", "word", "n").mapInArrow(_without_one, "sig long, word string, n long")
        signed = tagged.filter("hot IS NULL").select("sig", "word", "n").unionByName(apart)
    met = signed.select("sig", "word", "n").repartition("sig").sortWithinPartitions("sig").mapInArrow(_compare, NEAR_SCHEMA)
    return met.repartition("word").dropDuplicates(["word", "other"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: pointer doubling until no root has a form."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def spelling_groups(words: DataFrame, factor: int = 10, **tuning) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n). form: the near word of largest n (ties:
    smallest in code-point order) if its n is at least ``factor`` times the word's; root: where the forms lead."""
    vocab = written(words, "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("word")))
    near = near_words(vocab, **tuning).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocab.join(near, "word", "left")
    is_form = -F.col("best.order") >= factor * F.col("n")
    table = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                  F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n")), "spelling-forms")
    roots = _roots(table.filter("form IS NOT NULL"))
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
