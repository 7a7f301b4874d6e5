"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of word shingles are compared once per distinct value. The 64
bits are split into blocks so that fingerprints within ``distance`` bits agree
in at least two of them (more, and longer, for very many fingerprints: see
``equal_blocks``); rows are grouped by all choices of so many blocks, and the
Hamming distance is verified inside a group. A group emits one link per
fingerprint to the smallest one it reaches there, not all pairs. Groups larger
than ``TILE`` are split into tiles; each pair of tiles is its own small group,
so no task takes a whole hot group. Components follow from the links.

Defined results: null or wordless text has fingerprint zero, linked like any
other. component_id is the smallest non-null doc_id reachable (null if there
is none). Rows that repeat a doc_id each keep their row. One row per input row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import chunks as C
from churnlens.llm import textops as T
from churnlens.llm.components import components

#: Fingerprints per tile of a hot group.
TILE = 512
#: Random fingerprints that a key may hold.
CROWD = 64
#: Rows of block keys per reducer.
GROUP_ROWS = 200_000
SEED = 42


def _shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words)))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + i for i, e in enumerate(ends, 1))]
    return [digest(joined[a: z + i + width - 1], SEED) for i, (a, z) in enumerate(zip(starts, ends[width - 1:]))]


def fingerprint(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: a bit is set if over half the shingle hashes set it."""
    out = np.zeros(len(texts), np.uint64)
    hashes = [_shingle_hashes(t or b"", width) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
    bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[filled], axis=0, dtype=np.int32)
    out[filled] = np.packbits(2 * sums > counts[filled, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, rid (hash of the text), fp (the fingerprint's bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            _, offsets = T.as_bytes(texts)
            parts = [fingerprint(texts.slice(lo, hi - lo).to_pylist(), width) for lo, hi in T.blocks(offsets)]
            fps = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("rid"), pa.array(fps.view(np.int64))], names=["doc_id", "rid", "fp"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, rid long, fp long"))


def _masks(distance: int, equal: int) -> list[int]:
    """The 64 bits in distance + ``equal`` blocks: the masks of every ``equal`` of them, one of which any linked pair agrees on."""
    n = distance + equal
    sizes = [64 // n + (i < 64 % n) for i in range(n)]
    blocks = [((1 << s) - 1) << sum(sizes[:i]) for i, s in enumerate(sizes)]
    return [sum(x) for x in combinations(blocks, equal)]


def equal_blocks(n: int, distance: int) -> int:
    """How many blocks make a key, for n fingerprints: the fewest (two at least) with which n random ones leave at most
    ``CROWD`` to a key. More blocks are longer keys and more tables: 15 of 21 bits, 35 of 27, 70 of 32 at distance 4."""
    equal = 2
    while equal < 5 and n > CROWD << (64 * equal // (distance + equal)):
        equal += 1
    return equal


def _links_of_groups(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each group: a link from every fingerprint to the smallest one that it reaches there."""
    order = np.lexsort((fp, group))
    group, fp = group[order], fp[order]
    n = len(fp)
    root = np.arange(n)
    ahead = np.arange(n)
    pairs_a, pairs_b = [], []
    step = 1
    while True:
        ahead = ahead[ahead + step < n]
        ahead = ahead[group[ahead] == group[ahead + step]]
        if not len(ahead):
            break
        close = ahead[np.bitwise_count(fp[ahead] ^ fp[ahead + step]) <= distance]
        close = close[fp[close] != fp[close + step]]
        pairs_a.append(close)
        pairs_b.append(close + step)
        step += 1
    if pairs_a:
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def links(fps: DataFrame, distance: int = 4, equal: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within ``distance`` bits."""
    total = max(1, fps.count())
    masks = _masks(distance, equal or equal_blocks(total, distance))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = ", ".join(f"named_struct('t', {i}, 'k', fp & CAST('{signed(m)}' AS BIGINT))" for i, m in enumerate(masks))
    rows = fps.selectExpr("fp", f"inline(array({keys}))")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    near = rows.join(sizes, ["t", "k"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(
        F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j"))))
    near = near.select("fp", "t", "k", cell.alias("c")).select("fp", F.xxhash64("t", "k", "c").alias("g"))

    def verify(table: pa.Table) -> pa.Table:
        a, b = _links_of_groups(table["g"].to_numpy(), table["fp"].to_numpy().view(np.uint64), distance)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    n_parts = max(1, total * len(masks) // GROUP_ROWS)
    return near.withColumn("p", F.pmod("g", F.lit(n_parts))).groupBy("p").applyInArrow(verify, "a long, b long").distinct()


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints; and per distinct fingerprint the root of its component and its component_id."""
    marked = with_fingerprints(docs, id_col, text_col, width).checkpoint()
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(links(fps.select("fp"), distance))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, placed.join(named, "root").select("fp", "root", "component_id")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                              distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most ``distance`` bits."""
    marked, placed = _placed(docs, id_col, text_col, width, distance)
    return marked.join(placed, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One document of each component, with its columns: the one with the smallest doc_id (nulls last).

    Of rows that repeat that doc_id the one with the smallest text hash stays, and of equal ones one."""
    given = docs
    docs, name = C.plain_names(docs)
    id_col, text_col = name[id_col], name[text_col]
    marked, placed = _placed(docs, id_col, text_col, width, distance)
    none = -(1 << 63)
    heads = (marked.join(placed, "fp").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")).alias("h"))
             .select(F.coalesce("h.doc_id", F.lit(none)).alias("_s_id"), F.col("h.rid").alias("_s_rid")))
    rows = docs.withColumn("_s_id", F.coalesce(F.col(id_col).cast("long"), F.lit(none))).withColumn("_s_rid", F.xxhash64(text_col))
    return C.named_again(rows.join(heads, ["_s_id", "_s_rid"], "left_semi").dropDuplicates(["_s_id", "_s_rid"]), given)
