"""Documents dealt into byte-bounded chunks, and key blobs exchanged between them.

A chunk is a group of documents of a few MB, chosen by a hash of id and text,
so that a hot source or id spreads out. Every stage of an operator groups the
same projection by the same column: Spark writes that exchange once and reads
it again for the later stages. Chunks tell each other about their keys in
blobs: one row per chunk and key range, holding the chunk's sorted distinct
keys; the answer is one bit per key. A key that a third of all documents share
costs one entry per chunk, not one per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import scratch_path

#: Bytes of text per chunk.
CHUNK_BYTES = 4 << 20
#: Keys that one reducer sorts at a time.
RANGE_KEYS = 1 << 21

BLOB_SCHEMA = "part int, chunk long, width int, keys binary, extra binary"
MASK_SCHEMA = "part int, chunk long, mask binary"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns 0, 1, ... (which no helper column is called), and the new name of each column."""
    return docs.toDF(*map(str, range(len(docs.columns)))), {c: str(i) for i, c in enumerate(docs.columns)}


def named_again(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, from rows that carry them as ``plain_names`` called them."""
    return rows.select(*[F.col(f"`{i}`").alias(c) for i, c in enumerate(docs.columns)])


def measured(docs: DataFrame, text: str) -> tuple[int, int]:
    """(rows, text bytes): one aggregate over the whole table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def chunked(docs: DataFrame, id_col: str, text: str, n_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of chunks."""
    n = max(1, math.ceil(n_bytes / chunk_bytes))
    d, t = F.col(id_col), F.col(text)
    return docs.select(F.pmod(F.xxhash64(d, t), F.lit(n)).alias("chunk"), d.alias("doc_id"), t.alias("text")), n


def doc_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids (null: the largest int64) and which are null."""
    col = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
    null = col.is_null().to_numpy(zero_copy_only=False)
    ids = col.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, null


def pack(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as gaps, in the narrowest unsigned width that holds them."""
    if not len(keys):
        return 1, b""
    gaps = np.empty_like(keys)
    gaps[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=gaps[1:])
    top = int(gaps[1:].max()) if len(keys) > 1 else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return width, keys[:1].tobytes() + gaps[1:].astype(f"u{width}").tobytes()


def unpack(width: int, blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(blob, f"u{width}", offset=8)
    out = np.empty(len(gaps) + 1, np.uint64)
    out[0] = np.frombuffer(blob, np.uint64, 1)[0]
    out[1:] = gaps
    return np.cumsum(out, out=out)


def held(keys: np.ndarray, bits: int, n_ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted ``bits``-bit keys, for the ranges that hold any: the work follows the keys, not
    the ranges. A key's range is key * n_ranges >> bits, for n_ranges below 2**32."""
    if not len(keys):
        return []
    wide = keys << np.uint64(64 - bits)
    n, half = np.uint64(n_ranges), np.uint64(32)
    low = wide & np.uint64(0xFFFFFFFF)
    of = ((wide >> half) * n + ((low * n) >> half)) >> half
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


def blob_rows(rows: list[tuple], schema: str = BLOB_SCHEMA) -> pa.Table:
    """Rows (part, chunk, width, keys, extra) or (part, chunk, mask) as an Arrow table."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(names, cols)})


def repeated_values(sorted_keys: np.ndarray) -> np.ndarray:
    """The distinct values that occur at least twice in a sorted array."""
    again = sorted_keys[1:][sorted_keys[1:] == sorted_keys[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def member(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted set."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def shared_mask(table: pa.Table) -> pa.Table:
    """Reducer of one key range: per chunk, a bit for each of its keys that another chunk has too."""
    sent = [unpack(w, k) for w, k in zip(table["width"].to_pylist(), table["keys"].to_pylist())]
    again = repeated_values(np.sort(np.concatenate(sent))) if sent else np.zeros(0, np.uint64)
    rows = [(p, c, np.packbits(member(again, k)).tobytes()) for p, c, k in
            zip(table["part"].to_pylist(), table["chunk"].to_pylist(), sent)]
    return blob_rows(rows, MASK_SCHEMA)


def masks_of(table: pa.Table) -> dict[int, np.ndarray]:
    """part -> mask bytes, of the answers that one chunk got."""
    return {p: np.frombuffer(m, np.uint8) for p, m in zip(table["part"].to_pylist(), table["mask"].to_pylist())}


def read_mask(masks: dict[int, np.ndarray], first_part: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The bits of all ranges in the order of the chunk's sorted keys; spans as ``held`` gives them."""
    out = np.zeros(spans[-1][2] if spans else 0, bool)
    for r, lo, hi in spans:
        out[lo:hi] = np.unpackbits(masks[first_part + r], count=hi - lo).view(bool)
    return out
