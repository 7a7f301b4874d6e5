"""Fill-in-middle over seekable compressed text.

Store. ``seekable`` writes a text as independent zstandard frames of at most ``FRAME_BYTES`` bytes (cut between code
points) with cumulative counts of bytes, code points and units that end up to each frame. A unit is a word with the
white space before it, or white space that ends the text. The frames of a row stand in one binary column in order,
so together they are one zstandard stream; a frame's place follows from its cumulative end.

Selection. A cut after k units is looked up in the cumulative unit counts; only the frame in which the k-th unit ends
is decompressed. ``fill_in_middle`` builds the output as frames again: markers are frames of their own, the two cut
frames are written anew in pieces, and every other frame is copied as it is. Digests are taken over the ordered
frames, one frame in memory at a time. The restored text is read back from output and form: the markers, which
no transformed text contains, part it, and its pieces are put in order.

Everything is map-only: a row of the input is a row of the output, no row is held with another, and a lost
executor repeats its own splits.

Odd input: a NULL or empty text is plain and has no units; a NULL doc_id is hashed as the empty string; repeated rows give
repeated rows; other columns of the input are not read, whatever their names. A unit longer than a frame spans frames
and is counted where it ends. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.textops import IS_SPACE

FRAME_BYTES = 1 << 16
LEVEL = 1
SEED = 42
PLAIN_PERCENT, SPM_PERCENT = 50, 80
#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

STORE_SCHEMA = "doc_id string, frames binary, frame_ends array<long>, byte_ends array<long>, char_ends array<long>, unit_ends array<long>, marked boolean"
OUT_SCHEMA = ("doc_id string, n long, form string, prefix_chars long, middle_chars long, output binary, output_ends array<long>, "
              "output_sha256 string, restored_sha256 string")


# -- the store ---------------------------------------------------------------------

def unit_ends(text: np.ndarray) -> np.ndarray:
    """Byte positions behind each unit of a whole text."""
    if not len(text):
        return np.zeros(0, np.int64)
    space = IS_SPACE[text]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text))


def _starts_point(text: np.ndarray) -> np.ndarray:
    return (text & 0xC0) != 0x80


def frame_cuts(text: np.ndarray, size: int) -> np.ndarray:
    """Frame ends: at most ``size`` bytes apart, each between code points."""
    ends, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut > at + 1 and (int(text[cut]) & 0xC0) == 0x80:
            cut -= 1
        ends.append(cut)
        at = cut
    if len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def store_text(text: bytes, pack: zstandard.ZstdCompressor, size: int) -> tuple:
    """(frames, frame_ends, byte_ends, char_ends, unit_ends, marked) of one text."""
    raw = np.frombuffer(text, np.uint8)
    cuts = frame_cuts(raw, size)
    units = np.searchsorted(unit_ends(raw), cuts, side="right")
    chars = np.concatenate([[0], np.cumsum(np.add.reduceat(_starts_point(raw).astype(np.int64), np.concatenate([[0], cuts[:-1]])))])[1:] if len(cuts) else cuts
    frames = [pack.compress(text[a:b]) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
    return b"".join(frames), np.cumsum([len(f) for f in frames], dtype=np.int64).tolist(), cuts.tolist(), chars.tolist(), units.tolist(), marked


def _to_bytes(value) -> bytes:
    if value is None:
        return b""
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value)


def seekable(docs: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """The store of (doc_id, text): one row a document; doc_id as decimal text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        schema = _arrow(STORE_SCHEMA)
        for b in batches:
            held, held_bytes = [], 0
            for doc_id, text in zip(b["doc_id"], b["text"]):
                row = (doc_id.as_py(), *store_text(_to_bytes(text.as_py()), pack, size))
                held.append(row)
                held_bytes += len(row[1])
                if held_bytes >= 8 << 20:
                    yield _batch(held, schema)
                    held, held_bytes = [], 0
            if held:
                yield _batch(held, schema)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, STORE_SCHEMA)


_KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Store:
    """One stored text: reads single frames."""

    def __init__(self, frames: bytes, frame_ends: list, byte_ends: list, char_ends: list, units: list, unpack: zstandard.ZstdDecompressor):
        self.frames, self.frame_ends, self.byte_ends, self.char_ends, self.units = frames, frame_ends, byte_ends, char_ends, units
        self.unpack = unpack

    def __len__(self) -> int:
        return len(self.frame_ends)

    def packed(self, f: int) -> bytes:
        return self.frames[self.frame_ends[f - 1] if f else 0: self.frame_ends[f]]

    def read(self, f: int) -> bytes:
        return self.unpack.decompress(self.packed(f))

    def place(self, k: int) -> tuple[int, int, int]:
        """(frame, bytes of it, code points of the text) before the end of the k-th unit (k = 0: the text's start)."""
        if k == 0:
            return 0, 0, 0
        f = int(np.searchsorted(self.units, k))
        raw = np.frombuffer(self.read(f), np.uint8)
        space = IS_SPACE[raw]
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        mine = k - (self.units[f - 1] if f else 0)
        at = int(ends[mine - 1]) if mine <= len(ends) else len(raw)   # else the unit ends with the frame
        return f, at, (self.char_ends[f - 1] if f else 0) + int(np.count_nonzero(_starts_point(raw[:at])))

    def between(self, start: tuple, end: tuple, pack: zstandard.ZstdCompressor) -> list[bytes]:
        """Frames of the text from one place to another: whole frames as they are, cut ones written anew."""
        out = []
        for f in range(start[0], min(end[0], len(self) - 1) + 1):
            size = self.byte_ends[f] - (self.byte_ends[f - 1] if f else 0)
            lo, hi = start[1] if f == start[0] else 0, end[1] if f == end[0] else size
            if hi > lo:
                out.append(self.packed(f) if hi - lo == size else pack.compress(self.read(f)[lo:hi]))
        return out


# -- the transformation --------------------------------------------------------------

def choices(doc_id: str | None, n: int) -> tuple[int, int, int, int]:
    """(first cut, second cut, third, fourth hash) of a document of n units."""
    digest = hashlib.sha256(f"{SEED}:{doc_id or ''}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i: 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3, h4


def transform(store: Store, doc_id: str | None, marked: bool, pack: zstandard.ZstdCompressor) -> tuple:
    """(n, form, prefix_chars, middle_chars, output frames in order)."""
    n = store.units[-1] if len(store) else 0
    first, second, h3, h4 = choices(doc_id, n)
    if n == 0 or marked or h3 % 100 >= PLAIN_PERCENT:
        return n, "plain", None, None, [store.packed(f) for f in range(len(store))]
    a, b = store.place(first), store.place(second)
    end = (len(store) - 1, store.byte_ends[-1] - (store.byte_ends[-2] if len(store) > 1 else 0))
    pieces = {PREFIX: store.between((0, 0), a, pack), MIDDLE: store.between(a, b, pack), SUFFIX: store.between(b, end, pack)}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < SPM_PERCENT else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return n, form, a[2], b[2] - a[2], [f for m in order for f in (pack.compress(m), *pieces[m])]


def restored(frames: list[bytes], form: str, unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text that an output stands for, a frame at a time. Markers are frames of their own, which no piece of a
    transformed text can equal."""
    if form == "plain":
        yield from (unpack.decompress(f) for f in frames)
        return
    at = {unpack.decompress(f): i for i, f in enumerate(frames) if len(f) < 64 and unpack.decompress(f) in (PREFIX, SUFFIX, MIDDLE)}
    borders = sorted(at.values()) + [len(frames)]
    for marker in (PREFIX, MIDDLE, SUFFIX):
        start = at[marker]
        yield from (unpack.decompress(f) for f in frames[start + 1: borders[borders.index(start) + 1]])


def digest(parts: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(x)
    return h.hexdigest()


def fill_in_middle(store: DataFrame, outputs: bool = True) -> DataFrame:
    """Every stored text transformed: n, form, code points of prefix and middle, digests of the output and of the text
    restored from it. ``outputs``: also the output as frames (``output``, with their ends), see ``texts``."""
    schema = _arrow(OUT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            held, held_bytes = [], 0
            for row in zip(*[b[name] for name in ("doc_id", "frames", "frame_ends", "byte_ends", "char_ends", "unit_ends", "marked")]):
                doc_id, *parts, marked = [x.as_py() for x in row]
                n, form, prefix, middle, frames = transform(Store(*parts, unpack), doc_id, marked, pack)
                out = (b"".join(frames), np.cumsum([len(f) for f in frames], dtype=np.int64).tolist()) if outputs else (None, None)
                held.append((doc_id, n, form, prefix, middle, *out, digest(unpack.decompress(f) for f in frames), digest(restored(frames, form, unpack))))
                held_bytes += len(out[0] or b"")
                if held_bytes >= 8 << 20:
                    yield _batch(held, schema)
                    held, held_bytes = [], 0
            if held:
                yield _batch(held, schema)

    return store.mapInArrow(run, OUT_SCHEMA)


def texts(transformed: DataFrame) -> DataFrame:
    """(doc_id, form, output, restored) as text, read from the output frames."""
    schema = _arrow("doc_id string, form string, output binary, restored binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for doc_id, form, blob, ends in zip(*[b[name] for name in ("doc_id", "form", "output", "output_ends")]):
                blob, ends, form = blob.as_py(), ends.as_py(), form.as_py()
                frames = [blob[x:y] for x, y in zip([0, *ends[:-1]], ends)]
                yield _batch([(doc_id.as_py(), form, b"".join(map(unpack.decompress, frames)), b"".join(restored(frames, form, unpack)))], schema)

    out = transformed.select("doc_id", "form", "output", "output_ends").mapInArrow(run, "doc_id string, form string, output binary, restored binary")
    return out.select("doc_id", "form", F.col("output").cast("string").alias("output"), F.col("restored").cast("string").alias("restored"))
