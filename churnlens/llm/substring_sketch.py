"""Repeated word windows removed, behind a count-min prefilter.

1. Every chunk of documents makes a sketch of its windows: ``depth`` rows of
   ``2**bits`` cells, kept sparse (the sorted cells that it hits).
2. The sketches are merged by cell range. A cell's merged count is at least
   the count of every window in it, so a window whose cells do not all reach
   two occurs once; no repeat is lost, whatever the collisions.
3. Only windows estimated repeated go on: they are grouped exactly (96 hash
   bits of the word sequence), and every chunk learns which of its windows
   also start in a document with a smaller id.
4. The words covered by such windows are removed.

The number of cells follows the number of words, so the share of false
candidates is the same at every size.

Defined results: null text counts as no words. A null doc_id is larger than
every id and never removes anything; rows that repeat a doc_id do not remove
each other's words. Empty table: empty result. One output row per input row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnlens.llm import chunks as C
from churnlens.llm import textops as T

#: Cells per word in each row of the sketch (then rounded up to a power of two).
CELLS_PER_WORD = 4
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_ROW_SEEDS = (0x0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_BIG = np.iinfo(np.int64).max

RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _windows(table: pa.Table, k: int):
    """Of the chunk's texts in table order: per window two hashes, its first word and document; words per document."""
    buf, offsets = T.as_bytes(table["text"])
    one, two, first, counts = [], [], [], []
    n_words = 0
    for lo, hi in T.blocks(offsets):
        b, o = buf[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        s, e, c = T.word_spans(b, o)
        at = T.starts_within(c, k)
        if len(at):
            words = T.span_hashes(b, s, e)
            one.append(T.sequence_hashes(words, k)[at])
            two.append(T.sequence_hashes(words, k, _SECOND_BASE)[at])
            first.append(at + n_words)
        counts.append(c)
        n_words += len(s)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    counts, first = join(counts, np.int64), join(first, np.int64)
    doc = np.searchsorted(np.cumsum(counts), first, side="right")
    return join(one, np.uint64), join(two, np.uint64), first, doc, counts


def _cells(one: np.ndarray, row: int, bits: int) -> np.ndarray:
    return T.mix(one ^ np.uint64(_ROW_SEEDS[row])) >> np.uint64(64 - bits)


def _candidates(table: pa.Table, masks, k, depth, bits, n_ranges):
    """The chunk's windows whose estimated count reaches two in every row."""
    one, two, first, doc, counts = _windows(table, k)
    pick = np.arange(len(one))
    for row in range(depth):
        cells = _cells(one, row, bits)
        distinct = np.sort(cells)
        here = C.repeated_values(distinct)
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])] if len(distinct) else distinct
        elsewhere = distinct[C.read_mask(masks, row * n_ranges, C.held(distinct, bits, n_ranges))]
        hot = np.union1d(here, elsewhere)
        pick = pick[C.member(hot, cells[pick])]
    return one[pick], two[pick], first[pick], doc[pick], counts


def _entries(one, two, doc, ids):
    """Distinct candidate windows of the chunk with the smallest id that has them.

    Returns key, low bits, id per entry (sorted by key), and per window its entry."""
    order = np.lexsort((ids[doc], one & np.uint64(0xFFFFFFFF), two))
    key, low, owner = two[order], (one[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ids[doc[order]]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return key[new], low[new], owner[new], entry


def _earlier(table: pa.Table) -> pa.Table:
    """Reducer of one key range: per entry, whether a smaller id has the same window."""
    keys = [C.unpack(w, k) for w, k in zip(table["width"].to_pylist(), table["keys"].to_pylist())]
    lows, owners = [], []
    for k, x in zip(keys, table["extra"].to_pylist()):
        lows.append(np.frombuffer(x, np.uint32, len(k)))
        rank_width = int(x[4 * len(k)])
        n_ids = int(np.frombuffer(x, np.uint32, 1, 4 * len(k) + 1)[0])
        ids = np.frombuffer(x, np.int64, n_ids, 4 * len(k) + 5)
        ranks = np.frombuffer(x, f"u{rank_width}", len(k), 4 * len(k) + 5 + 8 * n_ids)
        owners.append(ids[ranks])
    key, low, owner = np.concatenate(keys), np.concatenate(lows), np.concatenate(owners)
    order = np.lexsort((low, key))
    new = np.ones(len(order), bool)
    sk, sl = key[order], low[order]
    new[1:] = (sk[1:] != sk[:-1]) | (sl[1:] != sl[:-1])
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(order) else owner
    bits = np.empty(len(order), bool)
    bits[order] = least[np.cumsum(new) - 1] < owner[order]
    ends = np.cumsum([len(k) for k in keys])
    rows = [(p, c, np.packbits(bits[hi - len(k): hi]).tobytes()) for p, c, k, hi in
            zip(table["part"].to_pylist(), table["chunk"].to_pylist(), keys, ends)]
    return C.blob_rows(rows, C.MASK_SCHEMA)


def _kept_texts(table: pa.Table, drop: np.ndarray, counts: np.ndarray):
    """Words that stay, joined by one space; and words removed, per document."""
    ends = np.cumsum(counts)
    removed = np.diff(np.concatenate([[0], np.cumsum(drop)])[np.concatenate([[0], ends])]) if len(counts) else counts
    texts = []
    for text, n, gone, hi in zip(table["text"].cast(pa.binary()).to_pylist(), counts.tolist(), removed.tolist(), ends.tolist()):
        words = (text or b"").split()
        if gone:
            words = [w for w, d in zip(words, drop[hi - n: hi].tolist()) if not d]
        texts.append(b" ".join(words))
    return texts, removed


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                            depth: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words in windows that an earlier document has are gone."""
    _, n_bytes = C.measured(docs, text_col)
    parts, n_chunks = C.chunked(docs, id_col, text_col, n_bytes)
    n_words = max(1, n_bytes // 6)
    bits = max(16, math.ceil(math.log2(n_words * CELLS_PER_WORD)))
    n_ranges = max(1, math.ceil(n_words / C.RANGE_KEYS))

    def sketch(table: pa.Table) -> pa.Table:
        one = _windows(table, window)[0]
        chunk, rows = table["chunk"][0].as_py(), []
        for row in range(depth):
            cells = np.unique(_cells(one, row, bits))
            rows += [(row * n_ranges + r, chunk, *C.pack(cells[lo:hi]), None) for r, lo, hi in C.held(cells, bits, n_ranges)]
        return C.blob_rows(rows)

    def ordered(table):
        ids, _ = C.doc_ids(table)
        return table, ids

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return C.blob_rows([])
        table, ids = ordered(left)
        one, two, _, doc, _ = _candidates(table, C.masks_of(right), window, depth, bits, n_ranges)
        key, low, owner, _ = _entries(one, two, doc, ids)
        rows, chunk = [], table["chunk"][0].as_py()
        for r, lo, hi in C.held(key, 64, n_ranges):
            known, rank = np.unique(owner[lo:hi], return_inverse=True)
            width = 2 if len(known) < 1 << 16 else 4
            extra = low[lo:hi].tobytes() + bytes([width]) + np.uint32(len(known)).tobytes() + known.tobytes() + rank.astype(f"u{width}").tobytes()
            rows.append((r, chunk, *C.pack(key[lo:hi]), extra))
        return C.blob_rows(rows)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        table, ids = ordered(left)
        masks = C.masks_of(right)
        one, two, first, doc, counts = _candidates(table, masks, window, depth, bits, n_ranges)
        key, _, owner, entry = _entries(one, two, doc, ids)
        earlier = C.read_mask(masks, depth * n_ranges, C.held(key, 64, n_ranges))
        gone = earlier[entry] | (owner[entry] < ids[doc])
        drop = T.covered(first[gone], window, int(counts.sum()))
        texts, removed = _kept_texts(table, drop, counts)
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(counts, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    by_chunk = parts.groupBy("chunk")
    estimated = by_chunk.applyInArrow(sketch, C.BLOB_SCHEMA).groupBy("part").applyInArrow(C.shared_mask, C.MASK_SCHEMA)
    judged = (by_chunk.cogroup(estimated.groupBy("chunk")).applyInArrow(exact, C.BLOB_SCHEMA)
              .groupBy("part").applyInArrow(_earlier, C.MASK_SCHEMA))
    answers = estimated.unionByName(judged.selectExpr(f"part + {depth * n_ranges} AS part", "chunk", "mask"))
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(cut, RESULT)
