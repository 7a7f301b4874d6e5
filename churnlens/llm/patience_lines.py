"""Line dedup by pairwise alignment of documents.

1. Every document becomes the list of its line hashes. Lines of
   ``EVIDENCE_WORDS`` words or more that at most ``RARE`` documents have are
   rare; a document is paired with the first holder of each of its rare lines.
   No rare line is on more rows than that, so this join has no hot key.
2. Pairs are aligned with patience diff on the line hashes: lines that occur
   once in both, in the longest increasing order, are anchors; the
   stretches between anchors are aligned the same way, and matches grow into
   the blocks that both have. Of both documents only the stretch around the
   shared rare lines moves (``AROUND`` lines more on each side), not the list of
   a long holder for each of its partners. A block of at least ``MIN_WORDS``
   words is deleted from the later document.
3. The exact rest. What alignment leaves by its nature is found without pairs:
   blocks of lines that are frequent, blocks in another order than the partner's,
   further copies of a block, blocks that another earlier document has. Runs are
   the shortest stretches of consecutive lines (blank ones aside) of at least
   ``MIN_WORDS`` words, from every line onward and backward; they cover every
   such block. One aggregate gives the first holder of every run, and
   the lines of a run that an earlier document has go, too. Together, a line goes
   if it stands in a block of ``MIN_WORDS`` words that some earlier document has.

Documents are judged on the input, so the order of pairs does not matter.
"Later" is by doc_id, then by a hash of the text.

Defined results: null text stays null and has no lines. Null doc_ids are later
than all others. Rows that repeat doc_id and text are one document, and each
gets its result. Lines are compared without white space at their ends; blank
lines match nothing and stay. Empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import chunks as C
from churnlens.llm import textops as T

#: Lines of so many words in at most so many documents are rare: they name the pairs to align.
EVIDENCE_WORDS = 4
RARE = 100
MIN_WORDS = 8
#: Lines around the shared rare ones that are aligned with them.
AROUND = 64
#: Rows of one key that one join key holds.
SPLIT = 4096
#: Pairs that are Python lists at a time.
_PAIRS = 64
_RUN_BASE = 0xA0761D6478BD642F


def line_keys(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per text: a hash of every line (0: blank) and its words."""
    keys, words, ends = [], [], [0]
    for text in texts.cast(pa.binary()).to_pylist():
        lines = text.split(b"\n") if text is not None else []
        for line in lines:
            parts = line.split()
            words.append(len(parts))
            keys.append(line.strip(T.SPACES) if parts else b"")
        ends.append(ends[-1] + len(lines))
    buf = np.frombuffer(b"".join(keys), np.uint8)
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    stop = np.cumsum(size)
    hashes = np.zeros(len(keys), np.uint64)
    for lo, hi in T.blocks(np.concatenate([[0], stop])):
        base = int(stop[lo] - size[lo])
        part = buf[base: stop[hi - 1]]
        if len(part):
            hashes[lo:hi] = T.span_hashes(part, stop[lo:hi] - size[lo:hi] - base, stop[lo:hi] - base)
    hashes[size == 0] = 0
    at = pa.array(ends, pa.int32())
    return (pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(words, pa.int32())))


def run_spans(words: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of at least min_words words, from every line onward and backward.

    ``words`` are the words of the lines that are not blank, ``ends`` where the documents end."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    sizes = np.diff(np.concatenate([[0], ends]))
    low, high = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    onward = np.searchsorted(total, total[:-1] + min_words, "left")
    backward = np.searchsorted(total, total[1:] - min_words, "right") - 1
    at = np.arange(n)
    fits, back = onward <= high, backward >= low
    return np.concatenate([at[fits], backward[back]]), np.concatenate([onward[fits], at[back] + 1])


def spread_keys(keys: pa.Array, words: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document its distinct keys: document number, key, first line (-1: a run of several lines), and whether it is
    a run. Keys are the runs, and the lines of ``EVIDENCE_WORDS`` words that are no run by themselves."""
    sizes = np.diff(keys.offsets.to_numpy().astype(np.int64))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    line = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key, count = keys.flatten().to_numpy().view(np.uint64), words.flatten().to_numpy().astype(np.int64)
    of, made, places, several = _hashed_runs(doc, key, count, line, len(sizes), min_words)
    short = (count >= EVIDENCE_WORDS) & (count < min_words) & (key != 0)
    of = np.concatenate([of, doc[short]])
    made = np.concatenate([made, T.mix(key[short] ^ np.uint64(_RUN_BASE)).view(np.int64)])
    places = np.concatenate([np.where(several, -1, places), line[short]])
    runs = np.concatenate([np.ones(len(several), bool), np.zeros(int(short.sum()), bool)])
    order = np.lexsort((places, made, of))
    of, made, places, runs = of[order], made[order], places[order], runs[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (made[1:] != made[:-1])]) if len(of) else np.zeros(0, bool)
    return of[new], made[new], places[new], runs[new]


def _hashed_runs(doc, key, count, line, n_docs: int, min_words: int):
    """Every run: document number, hash, its first line, whether it has several lines."""
    solid = key != 0
    doc, key, count, line = doc[solid], key[solid], count[solid], line[solid]
    s, e = run_spans(count, np.cumsum(np.bincount(doc, minlength=n_docs)), min_words)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    total = np.zeros(len(key) + 1, np.uint64)
    np.cumsum(T.mix(key.copy()) * T.powers(_RUN_BASE, len(key)), out=total[1:])
    made = T.mix((total[e] - total[s]) * T.inverse_powers(_RUN_BASE, len(key) + 1)[s] + (e - s).astype(np.uint64)).view(np.int64)
    return doc[s], made, line[s], e - s > 1


def lines_of_runs(keys: list[int], words: list[int], wanted: np.ndarray, gone: set[int], min_words: int) -> set[int]:
    """The lines of a document's runs whose hash is wanted, of runs that are not gone as a whole."""
    key, count = np.array(keys, np.int64).view(np.uint64), np.array(words, np.int64)
    line = np.flatnonzero(key != 0)
    _, made, _, _ = _hashed_runs(np.zeros(len(key), np.int64), key, count, np.arange(len(key)), 1, min_words)
    s, e = run_spans(count[line], np.array([len(line)]), min_words)
    out: set[int] = set()
    hit = np.isin(made, wanted)
    for a, b in sorted(set(zip(s[hit].tolist(), e[hit].tolist()))):
        run = line[a:b].tolist()
        if not gone.issuperset(run):
            out.update(run)
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence (by first) whose seconds increase."""
    tops: list[int] = []
    held: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(held[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            held.append(k)
        else:
            tops[at], held[at] = b, k
    out = []
    k = held[-1] if held else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: the aligned equal lines (place in a, place in b), in order. 0 matches nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] and a[a0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] and a[a1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if x and in_b[x] == 1 and in_a.get(x) == 1}
        anchors = _increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place])
        if not anchors:
            continue
        low_a, low_b = a0, b0
        for i, j in anchors:
            todo.append((low_a, i, low_b, j))
            out.append((i, j))
            low_a, low_b = i + 1, j + 1
        todo.append((low_a, a1, low_b, b1))
    return sorted(out)


def common_lines(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """The lines of b in aligned blocks (consecutive in both, blank lines aside) of at least min_words words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*aligned(a, b), (-9, -9)]:
        gap_a, gap_b = a[last[0] + 1: i], b[last[1] + 1: j]
        if not block or i < 0 or any(gap_a) or any(gap_b):
            if sum(words[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: late (a null id), id, rid (hash of the text), keys, words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = line_keys(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("late", "id", "rid")] + [keys, words], names=["late", "id", "rid", "keys", "words"])

    named = docs.select(F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                        F.xxhash64(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    made = named.filter("text IS NOT NULL").mapInArrow(run, "late boolean, id long, rid long, keys array<long>, words array<int>")
    return made.groupBy("late", "id", "rid").agg(F.first("keys").alias("keys"), F.first("words").alias("words"))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """late, id, rid, gone (the line numbers to delete), n_aligned (how many of them the alignments found), for documents that lose any."""
    rows = _rows(docs, id_col, text_col).checkpoint()
    me = F.struct("late", "id", "rid")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, made, line, runs = spread_keys(batch.column("keys"), batch.column("words"), min_words)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(of)) for c in ("late", "id", "rid")] + [pa.array(made), pa.array(line.astype(np.int32)), pa.array(runs)],
                                             names=["late", "id", "rid", "key", "line", "run"])

    keyed = rows.mapInArrow(spread, "late boolean, id long, rid long, key long, line int, run boolean").select(me.alias("doc"), "key", "line", "run")
    holders = (keyed.groupBy("key").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("df"), F.max("run").alias("any_run"))
               .filter((F.col("df") >= 2) & (F.col("any_run") | (F.col("df") <= RARE))))
    holders = C.written(holders, "lines-holders")
    # a key on very many documents is dealt over several join keys; the table of such keys is a small part of all
    hot = C.written(holders.filter(F.col("df") > SPLIT).select("key", F.ceil(F.col("df") / SPLIT).cast("int").alias("deals")), "lines-hot")
    held = holders.select("key", "first", "df", F.explode(F.sequence(F.lit(0), F.ceil(F.col("df") / SPLIT).cast("int") - 1)).alias("deal"))
    dealt = keyed.join(hot, "key", "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("deals")).cast("int"), F.lit(0))).drop("deals")
    met = dealt.join(held, ["key", "deal"]).filter(F.col("first.doc") < F.col("doc"))

    # pairs by shared rare lines: the stretches of both that hold them are aligned
    pairs = (met.filter((F.col("line") >= 0) & (F.col("df") <= RARE)).groupBy("doc", F.col("first.doc").alias("holder"))
             .agg(F.min("line").alias("low"), F.max("line").alias("high"), F.min("first.line").alias("their_low"), F.max("first.line").alias("their_high")))
    stretch = lambda c, low, high: F.slice(F.col(c), F.greatest(F.col(low) - AROUND, F.lit(0)) + 1, F.col(high) - F.greatest(F.col(low) - AROUND, F.lit(0)) + 1 + AROUND)
    named = rows.select(me.alias("doc"), "keys", "words")
    ours = pairs.join(named, "doc").select("doc", "holder", "their_low", "their_high", F.greatest(F.col("low") - AROUND, F.lit(0)).alias("at"),
                                           stretch("keys", "low", "high").alias("keys"), stretch("words", "low", "high").alias("words"))
    theirs = named.select(F.col("doc").alias("holder"), F.col("keys").alias("their_keys"))
    both = ours.join(theirs, "holder").select("doc.*", "at", "keys", "words", stretch("their_keys", "their_low", "their_high").alias("theirs"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PAIRS):
                part = batch.slice(lo, _PAIRS)
                gone = [[at + j for j in common_lines(t, k, w, min_words)] for at, t, k, w in zip(*(part.column(c).to_pylist() for c in ("at", "theirs", "keys", "words")))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("late", "id", "rid")] + [pa.array(gone, pa.list_(pa.int32()))], names=["late", "id", "rid", "gone"])

    found = both.mapInArrow(align, "late boolean, id long, rid long, gone array<int>").filter(F.size("gone") > 0)
    found = found.groupBy(me.alias("doc")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("aligned"))
    # the exact rest: runs that an earlier document has, of which the alignments left lines
    runs = met.filter("run").groupBy("doc").agg(F.collect_set("key").alias("runs"))
    given = rows.select(me.alias("doc"), "keys", "words").join(runs.join(found, "doc", "full"), "doc").select("doc.*", "keys", "words", "runs", "aligned")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, n = [], []
            for keys, words, runs, mine in zip(*(batch.column(c) for c in ("keys", "words", "runs", "aligned"))):
                have = set(mine.as_py() or ())
                left = lines_of_runs(keys.as_py(), words.as_py(), np.array(runs.as_py(), np.int64), have, min_words) if runs.is_valid else set()
                gone.append(sorted(have | left))
                n.append(len(have))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("late", "id", "rid")] + [pa.array(gone, pa.list_(pa.int32())), pa.array(n, pa.int32())],
                                             names=["late", "id", "rid", "gone", "n_aligned"])

    return given.mapInArrow(rest, "late boolean, id long, rid long, gone array<int>, n_aligned int").filter(F.size("gone") > 0)


def without_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, the deleted lines gone from the text; then two columns, lines and deleted
    lines, called _l_lines and _l_removed."""
    given = docs
    docs, name = C.plain_names(docs)
    id_col, text_col = name[id_col], name[text_col]
    gone = deletions(docs, id_col, text_col, min_words).select(
        F.col("late").alias("_l_late"), F.col("id").alias("_l_id"), F.col("rid").alias("_l_rid"), F.col("gone").alias("_l_gone"))
    text = F.col(f"`{text_col}`")
    on = ((F.col(id_col).isNull() == F.col("_l_late")) & (F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col("_l_id")) & (F.xxhash64(text) == F.col("_l_rid")))
    joined = docs.join(gone, on, "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("_l_gone"), i)), "\n")
    return joined.select(*[(F.when(F.col("_l_gone").isNull(), text).otherwise(kept) if c == text_col else F.col(f"`{c}`")).alias(n)
                           for c, n in zip(docs.columns, given.columns)],
                         F.coalesce(F.size(lines), F.lit(0)).alias("_l_lines"), F.when(F.col("_l_gone").isNull(), 0).otherwise(F.size("_l_gone")).alias("_l_removed"))
