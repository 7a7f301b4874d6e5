"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its evidence is a vector of figures of the
line and of its two neighbours; a 2 x 2 transition matrix links consecutive
lines. Training lines take the label of their document. The forward-backward
algorithm gives every line's marginal of being good; the mean over lines,
weighted by length, goes through a calibration fitted on the training
documents and is the document's quality.

The field is fitted on the driver on a bounded sample: at most ``max_docs``
labelled documents (those of the smallest id hash) with ``max_lines`` lines together,
of which the tasks send the line figures. All documents are scored in one pass without a shuffle.

Defined results: a text without lines (null, empty, only newlines) counts as
one empty line. Without labelled rows every score is 0.5. One row per row. Of
rows that repeat an id one is learned from. No column but id and text is read,
whatever the others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import textops as T

#: The training sample: documents, and lines of all of them.
MAX_DOCS = 4000
MAX_LINES = 1_000_000
ROUNDS = 120
RATE = 0.1
DECAY = 1e-3
THRESHOLD = 0.3
_BLOCK = 1 << 20

RESULT = "doc_id long, score double, predicted int, n_lines long, n_bad_lines long"

_KIND = np.zeros(256, np.uint8)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), ("#*$%&<>", 4), ("|", 5), ("!?", 6), (".,;:", 7), ("@/\\_=+~^{}[]", 8)):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[128:] = 9
_KIND[list(T.SPACES)] = 10
_N_KINDS = 11
N_LOCAL = _N_KINDS + 6


def line_figures(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(figures, length) of all lines of the texts, and lines per text: blank lines do not count, but a
    text has one line at least."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    begin = np.union1d(breaks + 1, offsets[:-1])
    begin = begin[begin < len(buf)]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, begin)], offsets[doc + 1])
    solid = np.concatenate([[0], np.cumsum(~T.IS_SPACE[buf])])
    full = solid[end] > solid[begin]
    begin, end, doc = begin[full], end[full], doc[full]
    lines = np.bincount(doc, minlength=n_docs)
    bare = np.flatnonzero(lines == 0)
    if len(bare):
        begin, end = np.append(begin, offsets[bare]), np.append(end, offsets[bare])
        doc = np.append(doc, bare)
        order = np.argsort(doc, kind="stable")
        begin, end, doc = begin[order], end[order], doc[order]
        lines = np.maximum(lines, 1)
    size = end - begin
    kind = _KIND[buf]
    share = np.empty((len(begin), N_LOCAL))
    length = np.maximum(size, 1)
    for k in range(_N_KINDS):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        share[:, k] = (total[end] - total[begin]) / length
    s, e, _ = T.word_spans(buf, offsets)
    first, last = np.searchsorted(s, begin), np.searchsorted(s, end)
    n_words = last - first
    letters = share[:, 1] + share[:, 2] + share[:, 9]
    share[:, _N_KINDS] = share[:, 2] / np.maximum(letters, 1e-9)
    share[:, _N_KINDS + 1] = np.log1p(size) / 10
    share[:, _N_KINDS + 2] = size / np.maximum(n_words, 1) / 20
    # words that end like the word before (one trailing symbol after another)
    last_kind = kind[e - 1] if len(e) else np.zeros(0, np.uint8)
    odd = np.concatenate([[0], np.cumsum((last_kind >= 4) & (last_kind <= 6))])
    share[:, _N_KINDS + 3] = (odd[last] - odd[first]) / np.maximum(n_words, 1)
    words = T.span_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(begin)), n_words)
    order = np.lexsort((words, owner))
    same = np.zeros(len(order))
    if len(order) > 1:
        same[1:] = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    share[:, _N_KINDS + 4] = np.bincount(owner[order], weights=same, minlength=len(begin)) / np.maximum(n_words, 1)
    share[:, _N_KINDS + 5] = _seen_before(buf, begin, end, doc)
    return share, size, lines


def _seen_before(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 for a line whose text occurs earlier in its document."""
    if not len(begin):
        return np.zeros(0)
    key = T.span_hashes(buf, begin, end) if len(buf) else np.zeros(len(begin), np.uint64)
    order = np.lexsort((np.arange(len(doc)), key, doc))
    again = np.zeros(len(doc))
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return again


def with_neighbours(figures: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The figures of the line before, the line and the line after (0 outside the text), and 1."""
    out = np.zeros((len(figures), 3 * N_LOCAL + 1))
    out[:, N_LOCAL: 2 * N_LOCAL] = figures
    ends = np.cumsum(lines)
    out[1:, :N_LOCAL] = figures[:-1]
    out[:-1, 2 * N_LOCAL: 3 * N_LOCAL] = figures[1:]
    out[ends - lines, :N_LOCAL] = 0
    out[ends - 1, 2 * N_LOCAL: 3 * N_LOCAL] = 0
    out[:, -1] = 1
    return out


def marginals(evidence: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(good) per line, expected transitions (2 x 2).

    evidence: log odds of good per line. Texts are sorted by lines, so step t works on those that have one."""
    order = np.argsort(-lines, kind="stable")
    start = (np.cumsum(lines) - lines)[order]
    n = lines[order]
    steps = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(steps), side="left")
    link = np.exp(transition)
    emit = np.exp(np.clip(np.stack([-evidence / 2, evidence / 2], axis=1), -30, 30))
    forward, backward = np.empty((len(evidence), 2)), np.ones((len(evidence), 2))
    for t in range(steps):
        at = start[:alive[t]] + t
        f = emit[at] if t == 0 else (forward[at - 1] @ link) * emit[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = start[:alive[t]] + t
        b = emit[at] * backward[at]
        joint = forward[at - 1][:, :, None] * link * b[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint.sum(axis=0)
        b = b @ link.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = forward * backward
    return p[:, 1] / p.sum(axis=1), pairs


class Field:
    """Weights of the evidence and transitions; calibration of the document score."""

    def __init__(self, figures: np.ndarray, sizes: np.ndarray, lines: np.ndarray, labels: np.ndarray):
        x = with_neighbours(figures, lines)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        y = np.repeat(labels, lines).astype(float)
        self.weights, self.transition = np.zeros(x.shape[1]), np.zeros((2, 2))
        seen = np.zeros((2, 2))
        inner = lines - 1
        for k in (0, 1):
            seen[k, k] = inner[labels == k].sum()
        n = len(y)
        slope, speed = [np.zeros_like(self.weights), np.zeros((2, 2))], [np.zeros_like(self.weights), np.zeros((2, 2))]
        for r in range(1, ROUNDS + 1):  # Adam on the mean conditional log likelihood per line
            p, pairs = marginals(x @ self.weights, self.transition, lines)
            for i, (value, up) in enumerate(((self.weights, x.T @ (y - p) / n - DECAY * self.weights), (self.transition, (seen - pairs) / n - 0.05 * self.transition))):
                slope[i] = 0.9 * slope[i] + 0.1 * up
                speed[i] = 0.999 * speed[i] + 0.001 * up ** 2
                value += RATE * (slope[i] / (1 - 0.9 ** r)) / (np.sqrt(speed[i] / (1 - 0.999 ** r)) + 1e-8)
        self.line, self.offset = 1.0, 0.0
        raw, _ = self._raw(figures, sizes, lines)
        z = np.log(raw / (1 - raw))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic regression on one figure
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
            da, db = np.linalg.solve(h, [((labels - p) * z).sum() - (a - 1), (labels - p).sum() - b])
            a, b = a + da, b + db
        self.line, self.offset = max(a, 1e-3), b

    def _raw(self, figures, sizes, lines):
        x = (with_neighbours(figures, lines) - self.mean) / self.scale
        p, _ = marginals(x @ self.weights, self.transition, lines)
        weight = np.maximum(sizes, 1).astype(float)
        start = np.cumsum(lines) - lines
        mean = np.add.reduceat(p * weight, start) / np.add.reduceat(weight, start)
        return np.clip(mean, 1e-6, 1 - 1e-6), p

    def score(self, figures, sizes, lines):
        """(quality per text, P(good) per line)."""
        raw, p = self._raw(figures, sizes, lines)
        return 1 / (1 + np.exp(-np.clip(self.line * np.log(raw / (1 - raw)) + self.offset, -30, 30))), p


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, max_docs: int,
        max_lines: int = MAX_LINES) -> Field | None:
    """The field of at most ``max_docs`` labelled documents for which ``train`` (over the id) holds, with at most
    ``max_lines`` lines together, none of more than a sixteenth of them."""
    known = labels.filter(train).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    lines = F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(1)), F.lit(1))
    # one document an id, the one with the smallest text hash; at most max_docs rows of numbers come here
    sizes = (texts.join(F.broadcast(known), texts.d == known.k).groupBy("k", "y").agg(F.min(F.struct("h", lines.alias("lines"))).alias("t"))
             .select("k", "y", "t.h", "t.lines", F.xxhash64("k").alias("order")).collect())
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["order"], r["k"])):
        if r["lines"] <= max_lines // 16 and total + r["lines"] <= max_lines:
            chosen.append((r["k"], r["y"], r["h"]))
            total += r["lines"]
    if not chosen:
        return None
    few = docs.sparkSession.createDataFrame(chosen, "k long, y int, g long")
    rows = texts.join(F.broadcast(few), (texts.d == few.k) & (texts.h == few.g)).groupBy("k", "y").agg(F.first("text").alias("text"))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.as_bytes(batch.column("text"))
            share, size, lines = line_figures(buf, offsets)
            ends = np.cumsum(lines)
            yield pa.RecordBatch.from_arrays([
                batch.column("k").cast(pa.int64()), batch.column("y").cast(pa.int32()),
                pa.array([share[b - n: b].astype(np.float32).tobytes() for b, n in zip(ends, lines)], pa.binary()),
                pa.array([size[b - n: b].tobytes() for b, n in zip(ends, lines)], pa.binary())], names=["k", "y", "share", "size"])

    found = sorted(rows.mapInArrow(figures, "k long, y int, share binary, size binary").collect(), key=lambda r: (r["k"], r["size"], r["share"]))
    if not found:
        return None
    sizes = [np.frombuffer(r["size"], np.int64) for r in found]
    share = np.concatenate([np.frombuffer(r["share"], np.float32).reshape(-1, N_LOCAL) for r in found]).astype(float)
    return Field(share, np.concatenate(sizes), np.array([len(s) for s in sizes]), np.array([r["y"] for r in found]))


def classify(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, score, predicted (score >= 0.3), n_lines, n_bad_lines."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train, id_col, text_col, label_col, max_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.as_bytes(batch.column("text"))
            for lo, hi in T.blocks(offsets, _BLOCK):
                b, o = buf[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
                share, size, lines = line_figures(b, o)
                if field.value is None:
                    score, good = np.full(hi - lo, 0.5), np.ones(len(size))
                else:
                    score, good = field.value.score(share, size, lines)
                bad = np.add.reduceat((good < 0.5).astype(np.int64), np.cumsum(lines) - lines)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                                                  pa.array(lines), pa.array(bad)], names=["doc_id", "score", "predicted", "n_lines", "n_bad_lines"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, RESULT)
