"""Repeated substrings removed, through merged Burrows-Wheeler transforms.

A string of ``length`` bytes is assigned to its anchor: the leftmost smallest
hash among its ``gram``-byte substrings. Equal strings have equal anchors, so
a document falls into runs of string starts with one anchor each.

1. Chunks of documents exchange the anchor and the hash of each run's text (its
   piece). A run whose anchor occurs once cannot begin a repeat; all strings of
   a piece that occurs twice repeat. Both are settled, copies without any text.
2. Where an anchor has several distinct pieces, one copy of each is sent to the
   anchor's bucket. There they are split into shards, each shard's transform is
   built (suffixes in order of blocks of ``block`` bytes, with the block that
   precedes each), and the transforms are merged by refining the interleave of
   their suffixes one block at a time. The refinement carries the common
   prefixes along, so the suffixes that still share an interval after
   ``length`` bytes are the repeats. No suffix is sorted again for a merge.
3. An anchor with more than ``HOT_RUNS`` distinct pieces (a passage in a third
   of all documents, in as many surroundings) is spread instead of gathered:
   the starts of its runs are dealt out by the hash of their whole string.
4. Every chunk learns which of its starts repeat, and cuts the covered bytes.

Blocks are compared by 64-bit hashes. Matches never cross documents.

Defined results: null text is empty. Rows that repeat a doc_id are documents of
their own, so their strings repeat. Empty table: empty result. One output row
per input row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnlens.llm import chunks as C
from churnlens.llm import textops as T

GRAM = 150
BLOCK = 200
SHARDS = 2
#: Distinct pieces of an anchor beyond which its strings are dealt out singly.
HOT_RUNS = 4096
#: Bytes of text per bucket of anchors, if all of it were pieces.
BUCKET_BYTES = 4 << 20
#: Pieces that one reducer of anchors groups at a time.
RANGE_PIECES = 1 << 19
_POSITION_BITS = 26
_SEGMENT = 1 << 25

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _anchors(grams: np.ndarray, wide: int) -> np.ndarray:
    """Position of the leftmost smallest gram in each window of ``wide`` grams."""
    n = len(grams) - wide + 1
    out = np.empty(n, np.int64)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    for at in range(0, n, _SEGMENT):
        here = grams[at: min(at + _SEGMENT, n) + wide - 1]
        size = -(-len(here) // wide) * wide
        keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        keys[:len(here)] = (here & ~low) | np.arange(len(here), dtype=np.uint64)
        rows = keys.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = len(here) - wide + 1
        out[at: at + m] = (np.minimum(back[:m], ahead[wide - 1: wide - 1 + m]) & low).astype(np.int64) + at
    return out


def _runs(buf: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of starts with one anchor: first start, starts, anchor hash, hash of the run's text."""
    first, count, anchor, piece = [], [], [], []
    for lo, hi in T.blocks(offsets):
        base = int(offsets[lo])
        b, o = buf[base: offsets[hi]], offsets[lo: hi + 1] - base
        if not (np.diff(o) >= length).any():
            continue
        grams = T.gram_hashes(b, GRAM)
        where = _anchors(grams, length - GRAM + 1)
        room = np.maximum(np.diff(o) - length + 1, 0)
        start = T.ragged(o[:-1], room)
        doc = np.repeat(np.arange(len(room)), room)
        at = where[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(start)))
        s = start[head]
        first.append(s + base)
        count.append(n)
        anchor.append(T.mix(grams[at[head]]))  # smallest hashes crowd near 0; mixed again they spread over all ranges
        piece.append(T.span_hashes(b, s, s + n + length - 1))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(first, np.int64), join(count, np.int64), join(anchor, np.uint64), join(piece, np.uint64)


def _string_hashes(buf: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Hash of the whole string at every start of the given runs."""
    out = [T.gram_hashes(buf[f: f + n + length - 1], length) for f, n in zip(first.tolist(), count.tolist())]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _grouped(anchor: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (anchor, piece): where each distinct piece is first met, and each row's piece number."""
    order = np.lexsort((piece, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (piece[order][1:] != piece[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


#: What a chunk learns of a piece: all its strings repeat; its text (or hashes) are wanted; its anchor is hot.
COPIED, WANTED, HOT = 1, 2, 4


def _verdicts(table: pa.Table) -> pa.Table:
    """Reducer of one range of anchors: a verdict per piece of each chunk.

    Rows come in any order, and a lost executor makes this run again: the chunk that sends a piece's text
    is the smallest that has it."""
    table = table.sort_by("chunk")
    keys = [C.unpack(w, k) for w, k in zip(table["width"].to_pylist(), table["keys"].to_pylist())]
    extra = table["extra"].to_pylist()
    anchor = np.concatenate(keys)
    piece = np.concatenate([np.frombuffer(x, np.uint64, len(k)) for k, x in zip(keys, extra)])
    many = np.concatenate([np.frombuffer(x, np.uint8, len(k), 8 * len(k)) for k, x in zip(keys, extra)])
    first, kind = _grouped(anchor, piece)
    copied = np.bincount(kind, weights=1 + many.astype(np.int64), minlength=len(first)) >= 2
    of = anchor[first]
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rivals = np.repeat(np.diff(np.append(edge, len(of))), np.diff(np.append(edge, len(of))))
    said = (copied * COPIED + (rivals > HOT_RUNS) * HOT)[kind].astype(np.uint8)
    said[first[rivals >= 2]] |= WANTED
    rows, at = [], 0
    for p, c, k in zip(table["part"].to_pylist(), table["chunk"].to_pylist(), keys):
        rows.append((p, c, said[at: at + len(k)].tobytes()))
        at += len(k)
    return C.blob_rows(rows, C.MASK_SCHEMA)


# -- transforms -------------------------------------------------------------

class Transform:
    """A Burrows-Wheeler transform over blocks: per suffix, in order, the block before it (-1: none).

    ``group`` numbers the intervals of suffixes that share the blocks compared
    so far; ``suffix`` is where each comes from."""

    def __init__(self, before: np.ndarray, group: np.ndarray, suffix: np.ndarray, n_empty: int):
        self.before, self.group, self.suffix, self.n_empty = before, group, suffix, n_empty


def _refined(symbols: np.ndarray, group: np.ndarray, n_empty: int) -> tuple[np.ndarray, np.ndarray]:
    """One block more: for suffixes in order with the block before each, the order of the suffixes one
    block longer (as indices of those they extend), and their intervals. Empty suffixes stay in front."""
    has = np.flatnonzero(symbols >= 0)
    keyed = np.sort((symbols[has] << np.int64(32)) | np.arange(len(has)))
    came = has[keyed & np.int64(0xFFFFFFFF)]
    sym, old = keyed >> np.int64(32), group[came]
    new = np.ones(len(came), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
    return came, np.concatenate([np.zeros(n_empty, np.int64), np.cumsum(new)])


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of small integers, and their dense ranks (0 for the smallest pair)."""
    n, bits = len(high), int(max(len(high), high.max(initial=0), low.max(initial=0)) + 1).bit_length()
    if 3 * bits <= 63:
        keyed = np.sort((high << np.int64(2 * bits)) | (low << np.int64(bits)) | np.arange(n))
        order, pair = keyed & np.int64((1 << bits) - 1), keyed >> np.int64(bits)
    else:
        pair = (high << np.int64(bits)) | low
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))
    return order, rank


def shard_transform(symbols: np.ndarray, lengths: np.ndarray, block: int, depth: int) -> Transform:
    """The transform of one shard's pieces (symbols: the block id at every position, -1 past the last block).

    A piece of n bytes has the suffixes 0..n; those with no whole block left are
    empty and come first. Their order comes from doubling the blocks compared."""
    n = len(symbols)
    room = lengths + 1
    ends = np.cumsum(room)
    blank = symbols < 0
    rank, have = symbols + 1, 1
    order = None
    while order is None or have < depth:
        step = min(have, depth - have) * block
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:]
        after[T.ragged(np.maximum(ends - step, ends - room), np.minimum(room, step))] = 0
        order, rank = _ranked(rank, after)
        have = min(depth, 2 * have)
    before = np.full(n, -1, np.int64)
    before[block:] = symbols[:-block] if n > block else before[block:]
    before[T.ragged(ends - room, np.minimum(room, block))] = -1
    return Transform(before[order], rank[order], order, int(blank.sum()))


def merge_transforms(a: Transform, b: Transform, depth: int) -> Transform:
    """Interleaves two transforms: after k rounds suffixes are in order of their first k blocks.

    Only the interleave moves; within a transform the order never changes."""
    n_empty = a.n_empty + b.n_empty
    # the empty suffixes of both come first and stay there
    edge = np.concatenate([np.zeros(a.n_empty, bool), np.ones(b.n_empty, bool)])
    rest = np.concatenate([np.zeros(len(a.before) - a.n_empty, bool), np.ones(len(b.before) - b.n_empty, bool)])
    from_b = np.concatenate([edge, rest])
    group = np.zeros(len(from_b), np.int64)
    for _ in range(depth):
        symbols = np.empty(len(from_b), np.int64)
        symbols[~from_b], symbols[from_b] = a.before, b.before
        came, group = _refined(symbols, group, n_empty)
        from_b = np.concatenate([edge, from_b[came]])
    before, suffix = np.empty(len(from_b), np.int64), np.empty(len(from_b), np.int64)
    before[~from_b], before[from_b] = a.before, b.before
    suffix[~from_b], suffix[from_b] = a.suffix, b.suffix + len(a.suffix)
    return Transform(before, group, suffix, n_empty)


def repeated_starts(text: np.ndarray, lengths: np.ndarray, length: int, block: int = BLOCK, shards: int = SHARDS) -> np.ndarray:
    """For distinct pieces laid end to end: which positions begin a string of ``length`` bytes that begins twice.

    The result has lengths + 1 places per piece, in order of the pieces."""
    depth = length // block
    n = lengths + 1
    at = np.cumsum(n) - n
    grams = T.gram_hashes(text, block)
    valid = np.maximum(lengths - block + 1, 0)
    symbols = np.full(int(n.sum()), -1, np.int64)
    names = grams[T.ragged(np.cumsum(lengths) - lengths, valid)]
    symbols[T.ragged(at, valid)] = np.unique(names, return_inverse=True)[1]
    borders = np.unique([round(i * len(lengths) / shards) for i in range(shards + 1)])
    edges = np.append(at, len(symbols))
    parts = [shard_transform(symbols[edges[lo]: edges[hi]], lengths[lo:hi], block, depth) for lo, hi in zip(borders[:-1], borders[1:])]
    while len(parts) > 1:
        parts = [merge_transforms(*pair, depth) if len(pair) == 2 else pair[0] for pair in (parts[i: i + 2] for i in range(0, len(parts), 2))]
    whole = parts[0]
    again = np.bincount(whole.group)[whole.group] >= 2
    out = np.zeros(len(symbols), bool)
    out[whole.suffix] = again
    inner = np.arange(len(symbols)) - np.repeat(at, n)
    return out & (inner + length <= np.repeat(lengths, n))


def _bucket_masks(table: pa.Table, length: int) -> pa.Table:
    """Reducer of one bucket of anchors: per chunk, a bit for every start of the pieces that it sent."""
    counts, texts = [], []
    for x in table["keys"].to_pylist():
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        counts.append(np.frombuffer(x, np.uint32, n, 4).astype(np.int64))
        texts.append(np.frombuffer(x, np.uint8, -1, 4 + 4 * n))
    count = np.concatenate(counts)
    size = count + length - 1
    found = repeated_starts(np.concatenate(texts), size, length)
    bits = found[T.ragged(np.cumsum(size + 1) - size - 1, count)]
    rows, at = [], 0
    for p, c, own in zip(table["part"].to_pylist(), table["chunk"].to_pylist(), counts):
        n = int(own.sum())
        rows.append((p, c, np.packbits(bits[at: at + n]).tobytes()))
        at += n
    return C.blob_rows(rows, C.MASK_SCHEMA)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    _, n_bytes = C.measured(docs, text_col)
    parts, _ = C.chunked(docs, id_col, text_col, n_bytes)
    n_ranges = max(1, math.ceil(n_bytes / (length - GRAM) * 2 / RANGE_PIECES))
    n_buckets = max(1, math.ceil(n_bytes / BUCKET_BYTES))
    bucket_first, hot_first = n_ranges, n_ranges + n_buckets

    def pieces_of(table: pa.Table):
        """The chunk's runs, its distinct pieces (places of their first runs, by anchor), and each run's piece."""
        buf, offsets = T.as_bytes(table["text"])
        first, count, anchor, piece = _runs(buf, offsets, length)
        one, kind = _grouped(anchor, piece)
        return buf, offsets, first, count, anchor, piece, one, kind

    def send(table: pa.Table) -> pa.Table:
        _, _, _, _, anchor, piece, one, kind = pieces_of(table)
        many = np.bincount(kind, minlength=len(one)) >= 2
        keys, chunk = anchor[one], table["chunk"][0].as_py()
        return C.blob_rows([(r, chunk, *C.pack(keys[lo:hi]), piece[one[lo:hi]].tobytes() + many[lo:hi].tobytes())
                            for r, lo, hi in C.held(keys, 64, n_ranges)])

    def verdicts(masks, keys: np.ndarray) -> np.ndarray:
        got = [masks[r] for r, _, _ in C.held(keys, 64, n_ranges)]
        return np.concatenate(got) if got else np.zeros(0, np.uint8)

    def wanted(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return C.blob_rows([])
        buf, _, first, count, anchor, _, one, _ = pieces_of(left)
        said = verdicts(C.masks_of(right), anchor[one])
        chunk, rows = left["chunk"][0].as_py(), []
        cold = one[(said & (WANTED | HOT)) == WANTED]
        for r, lo, hi in C.held(anchor[cold], 64, n_buckets):
            k = cold[lo:hi]
            text = buf[T.ragged(first[k], count[k] + length - 1)]
            blob = np.uint32(len(k)).tobytes() + count[k].astype(np.uint32).tobytes() + text.tobytes()
            rows.append((bucket_first + r, chunk, 0, blob, None))
        hot = one[(said & (WANTED | HOT)) == WANTED | HOT]
        if len(hot):
            keys = np.unique(_string_hashes(buf, first[hot], count[hot], length))
            rows += [(hot_first + r, chunk, *C.pack(keys[lo:hi]), None) for r, lo, hi in C.held(keys, 64, n_ranges)]
        return C.blob_rows(rows)

    def judge(table: pa.Table) -> pa.Table:
        return C.shared_mask(table) if table["part"][0].as_py() >= hot_first else _bucket_masks(table, length)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                             "kept": pa.array([], pa.binary())})
        masks = C.masks_of(right)
        buf, offsets, first, count, anchor, _, one, kind = pieces_of(left)
        said = verdicts(masks, anchor[one])
        all_of = (said & COPIED > 0)[kind]
        starts, ends = [first[all_of]], [first[all_of] + count[all_of] + length - 1]
        cold = one[(said & (WANTED | HOT)) == WANTED]
        places = np.concatenate([[0], np.cumsum(count[cold])])
        bits = C.read_mask(masks, bucket_first, [(r, int(places[lo]), int(places[hi])) for r, lo, hi in C.held(anchor[cold], 64, n_buckets)])
        starts.append(T.ragged(first[cold], count[cold])[bits])
        ends.append(starts[-1] + length)
        hot = one[(said & (WANTED | HOT)) == WANTED | HOT]
        if len(hot):
            hashes = _string_hashes(buf, first[hot], count[hot], length)
            keys = np.sort(hashes)
            here = C.repeated_values(keys)
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            there = keys[C.read_mask(masks, hot_first, C.held(keys, 64, n_ranges))]
            again = C.member(here, hashes) | C.member(there, hashes)
            starts.append(T.ragged(first[hot], count[hot])[again])
            ends.append(starts[-1] + length)
        delta = np.zeros(len(buf) + 1, np.int32)
        np.add.at(delta, np.concatenate(starts), 1)
        np.subtract.at(delta, np.concatenate(ends), 1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(total[offsets])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[heads] = gone[heads]
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
        kept = buf[~gone].tobytes()
        ends = (offsets - total[offsets]).tolist()
        return pa.table({"doc_id": left["doc_id"].cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed),
                         "n_spans": pa.array(spans), "kept": pa.array([kept[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    by_chunk = parts.groupBy("chunk")
    known = by_chunk.applyInArrow(send, C.BLOB_SCHEMA).groupBy("part").applyInArrow(_verdicts, C.MASK_SCHEMA)
    judged = (by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(wanted, C.BLOB_SCHEMA)
              .groupBy("part").applyInArrow(judge, C.MASK_SCHEMA))
    return by_chunk.cogroup(known.unionByName(judged).groupBy("chunk")).applyInArrow(cut, RESULT)
