"""Byte-level BPE encoding and decoding with a pair occurrence index.

Every partition cuts its texts into pre-tokens and keeps each distinct one
once. The distinct pre-tokens of a block lie in one symbol list; an index maps
each merge rank to all positions of its pair. Active ranks are applied in
ascending order: a rank's positions are merged from left to right, and the
pairs that a merge makes with its neighbours are added to their ranks' lists.
Documents then take their ids from the finished pre-tokens by array gathers,
and decoding gathers the bytes of the ids.

The vocabulary file is read on the driver (its path is a parameter) and
broadcast: its size is fixed, a few MB. No shuffle.

Defined results: null text counts as empty; empty text has no ids. The
special token's string in a text becomes its id. One output row per row.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from churnlens.llm import textops as T

#: The pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that the pattern engine here takes for letters or digits and the tokenizers library,
#: whose tables are those of Unicode 16, for neither. First and last of each run, in hexadecimal.
LATER_CHARACTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: A code point that no table gives a class.
UNCLASSED = "\u0378"
#: Distinct pre-tokens kept per task before the table starts anew.
KEPT_TYPES = 400_000
BLOCK_BYTES = 1 << 20
_SHIFT = 20

RESULT = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, their bytes and the merges of one tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        ids = dict(model["vocab"])
        self.special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        size = max([*ids.values(), *(i for _, i in self.special)]) + 1
        spelled = [b""] * size
        for token, i in ids.items():
            spelled[i] = bytes(back[c] for c in token)
        for text, i in self.special:
            spelled[i] = text.encode()
        self.byte_ids = np.array([ids[s] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        self.rank = {(a << _SHIFT) | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        lengths = np.array([len(s) for s in spelled], np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at, self.spelled_len = np.cumsum(lengths) - lengths, lengths


def merge_all(vocabulary: Vocabulary, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, lengths) of the distinct pre-tokens, through the pair occurrence index."""
    v = vocabulary
    lengths = np.array([len(t) for t in tokens], np.int64)
    flat = v.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
    n = len(flat)
    if n == 0:
        return flat, lengths
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(tokens)), lengths)
    after = np.arange(1, n + 1)
    after[ends[lengths > 0] - 1] = -1
    before = np.arange(-1, n - 1)
    before[(ends - lengths)[lengths > 0]] = -1

    joined = np.flatnonzero(after >= 0)
    keys = (flat[joined] << _SHIFT) | flat[joined + 1]
    at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
    known = v.pair_keys[at] == keys
    joined, ranks = joined[known], v.pair_ranks[at[known]]
    order = np.argsort(ranks, kind="stable")
    joined, ranks = joined[order], ranks[order]
    borders = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else np.zeros(0, np.int64)
    occurrences = {int(ranks[lo]): joined[lo:hi].tolist() for lo, hi in zip(borders, [*borders[1:], len(ranks)])}
    active = list(occurrences)
    heapq.heapify(active)

    sym, nxt, prv = flat.tolist(), after.tolist(), before.tolist()
    rank_of = v.rank.get
    while active:
        r = heapq.heappop(active)
        left, right, made = v.left[r], v.right[r], v.made[r]
        places = occurrences.pop(r)
        places.sort()
        for p in places:
            q = nxt[p]
            if q < 0 or sym[p] != left or sym[q] != right:
                continue
            sym[p], sym[q] = made, -1
            far = nxt[q]
            nxt[p] = far
            near = prv[p]
            if far >= 0:
                prv[far] = p
                new = rank_of((made << _SHIFT) | sym[far])
                if new is not None:
                    if new in occurrences:
                        occurrences[new].append(p)
                    else:
                        occurrences[new] = [p]
                        heapq.heappush(active, new)
            if near >= 0:
                new = rank_of((sym[near] << _SHIFT) | made)
                if new is not None:
                    if new in occurrences:
                        occurrences[new].append(near)
                    else:
                        occurrences[new] = [near]
                        heapq.heappush(active, new)
    out = np.array(sym, np.int64)
    alive = out >= 0
    return out[alive], np.bincount(word[alive], minlength=len(tokens))


def later_characters() -> tuple[str, str]:
    """LATER_CHARACTERS as a pattern, and a quicker one that finds them and more: one run for each plane beyond the first."""
    pairs = [(chr(int(lo, 16)), chr(int(hi or lo, 16))) for lo, _, hi in (x.partition("-") for x in LATER_CHARACTERS.split())]
    planes: dict[int, list] = {}
    for lo, hi in pairs:
        planes.setdefault(ord(lo) >> 16, []).append((lo, hi))
    coarse = planes.pop(0, []) + [(runs[0][0], runs[-1][1]) for runs in planes.values()]
    exact, quick = ("[" + "".join(f"{lo}-{hi}" for lo, hi in runs) + "]" for runs in (pairs, coarse))
    return exact, quick


class Encoder:
    """Encodes blocks of texts; keeps the distinct pre-tokens of a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.later, self.maybe_later = map(re.compile, later_characters())
        self.split = regex.compile("|".join(regex.escape(s) for s, _ in vocabulary.special)) if vocabulary.special else None
        self._clear()

    def _clear(self):
        self.index = T.Index()
        self.flat = np.array([i for _, i in self.v.special], np.int64)
        for s, _ in self.v.special:
            self.index[(s,)]
        self.lengths = np.ones(len(self.v.special), np.int64)

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii() or not self.maybe_later.search(text):
            return self.pattern.findall(text)
        return [text[m.start(): m.end()] for m in self.pattern.finditer(self.later.sub(UNCLASSED, text))]

    def _pre_tokens(self, text: str) -> list:
        if self.split is None or not self.split.search(text):
            return self.find(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.find(text[at: m.start()])
            out.append((m.group(),))
            at = m.end()
        return out + self.find(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        if len(self.index) > KEPT_TYPES:
            self._clear()
        number, types, counts = self.index.__getitem__, [], []
        for text in texts:
            got = list(map(number, self._pre_tokens(text)))
            types.append(np.array(got, np.int64))
            counts.append(len(got))
        fresh = list(self.index)[len(self.lengths):]
        if fresh:
            flat, lengths = merge_all(self.v, [t.encode() for t in fresh])
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        used = np.concatenate(types) if types else np.zeros(0, np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        ids = self.flat[T.ragged(starts[used], self.lengths[used])]
        owner = np.repeat(np.arange(len(texts)), counts)
        return ids, np.bincount(owner, weights=self.lengths[used], minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids spell."""
        lengths = self.v.spelled_len[ids]
        data = self.v.spelled[T.ragged(self.v.spelled_at[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    with open(vocabulary_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(source.value))
            _, offsets = T.as_bytes(batch.column("text"))
            for lo, hi in T.blocks(offsets, BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = [(x or b"").decode("utf-8", "replace") for x in part.column("text").cast(pa.binary()).to_pylist()]
                ids, counts = encoder.encode(texts)
                decoded = [x.decode("utf-8", "replace") for x in encoder.decode(ids, counts)]
                packed = ids.astype("<u4").tobytes()
                ends = (4 * np.concatenate([[0], np.cumsum(counts)])).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), column, pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, RESULT)
