"""Language identification with blended-spectrum string kernels.

A text's features are the n-grams of 1 to 3 folded bytes that are present in
it. The kernel of two texts is the number of n-grams that both have, over the
square root of the product of their own numbers. Landmarks (some training
texts) span a Nyström approximation; a kernel ridge regression per language
against the rest is solved there. Scoring a batch is two matrix products:
presence rows x landmark presences, then kernels x weights.

The model is fitted on a bounded sample, ``per_language`` training documents a
language (those of the smallest id hash) of every language. Beyond ``FULL``
languages each has a smaller sample and fewer landmarks, so that the model
stays a few MB, whatever the corpus, and is broadcast; no language is left out.
All documents are scored.

Defined results: null text, or text without a letter, is ``und`` with score 0;
so is everything if there is no training document. Ties go to the language
first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import textops as T

PER_LANGUAGE = 300
LANDMARKS = 32
#: With more languages than this, samples and landmarks of a language shrink in proportion.
FULL = 32
#: Documents of a language that are ranked for its sample, over the sample's size.
SPARE = 4
RIDGE = 1e-2
#: Rows scored at once.
ROWS = 256
SIZE = 64
N_GRAMS = SIZE + SIZE ** 2 + SIZE ** 3
NONE = "und"

RESULT = "doc_id long, lang_pred string, score double"


def _folding() -> np.ndarray:
    """Byte -> 0 (no letter), 1-26 letters, 27-31 lead bytes, 32-63 continuation bytes."""
    fold = np.zeros(256, np.int32)
    for i in range(26):
        fold[ord("a") + i] = fold[ord("A") + i] = 1 + i
    for b in range(128, 192):
        fold[b] = 32 + (b & 31)
    for b in range(192, 256):
        fold[b] = 27 + min(4, (b - 192) >> 3)
    return fold


FOLD = _folding()


def _codes(text: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of one text (repeats included)."""
    s = FOLD[text]
    two = s[:-1] * SIZE + s[1:]
    three = two[:-1] * SIZE + s[2:]
    return np.concatenate([s, two + SIZE, three + SIZE + SIZE ** 2])


def present(text: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text, in order."""
    flags = np.zeros(N_GRAMS, bool)
    flags[_codes(text)] = True
    return np.flatnonzero(flags)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if text.isascii():
        return bool(FOLD[np.frombuffer(text, np.uint8)].any())
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Model:
    """Landmarks, and the weights of every language over their kernels."""

    def __init__(self, grams: list[np.ndarray], names: list[str], landmarks: int = LANDMARKS):
        self.labels = sorted(set(names))
        y = np.array([self.labels.index(x) for x in names])
        marks = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(self.labels))])
        self.vocabulary = np.unique(np.concatenate([grams[i] for i in marks]))
        self.marks = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for j, i in enumerate(marks):
            self.marks[np.searchsorted(self.vocabulary, grams[i]), j] = 1
        self.mark_size = np.sqrt([float(len(grams[i])) for i in marks])
        rows = np.zeros((len(grams), len(self.vocabulary)), np.float32)
        for r, g in enumerate(grams):
            at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            rows[r, at[self.vocabulary[at] == g]] = 1
        kernels = self.kernels(rows, np.array([len(g) for g in grams]))
        values, vectors = np.linalg.eigh(kernels[marks])
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        features = kernels @ root
        target = np.where(y[:, None] == np.arange(len(self.labels)), 1.0, -1.0)
        # every language weighs the same against the rest
        weight = (1.0 / np.bincount(y))[y][:, None]
        gram = features.T @ (features * weight) + RIDGE * np.eye(features.shape[1])
        self.weights = root @ np.linalg.solve(gram, features.T @ (target * weight))

    def kernels(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (rows @ self.marks).astype(np.float64) / (np.sqrt(np.maximum(sizes, 1))[:, None] * self.mark_size)

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score from 0 to 1) per text."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        flags = np.zeros(N_GRAMS, bool)
        for lo in range(0, len(texts), ROWS):
            part = texts[lo: lo + ROWS]
            rows = np.empty((len(part), len(self.vocabulary)), np.float32)
            sizes = np.empty(len(part))
            for r, text in enumerate(part):
                codes = _codes(text)
                flags[codes] = True
                sizes[r] = np.count_nonzero(flags)
                rows[r] = flags[self.vocabulary]
                flags[codes] = False
            margin = np.clip(4 * (self.kernels(rows, sizes) @ self.weights), -50, 50)
            top = margin.argmax(axis=1)
            odds = np.exp(margin - margin.max(axis=1, keepdims=True))
            best[lo: lo + ROWS], score[lo: lo + ROWS] = top, 1 / odds.sum(axis=1)
        return best, score


def fit(docs: DataFrame, train: Column, text_col: str, lang_col: str, id_col: str, per_language: int) -> Model | None:
    """The model of a bounded sample: n-gram sets are made in the tasks, at most 270,000 numbers each."""
    rows = (docs.filter(train).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
            .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    # ids and texts give a row's place, so rows of one id, or of one text, spread out
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    top = rows.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).collect()
    if not top:
        return None
    portion = min(1.0, FULL / len(top))
    per_language, landmarks = max(1, int(per_language * portion)), max(1, int(LANDMARKS * portion))
    # a share of each language's places holds its smallest ones, and its smallest at least: only those texts are shuffled
    shares = {r["l"]: max(r["first"], int(min(1.0, SPARE * per_language / r["n"]) * (1 << 30))) for r in top}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text"))
    few = (rows.withColumn("h", place).filter(F.col("h") <= share)
           .groupBy("lang", "h", "id").agg(F.first("text").alias("text"))      # equal rows count once, where they are
           .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.as_bytes(batch.column("text"))
            sets = [present(buf[a:b]).astype(np.int32).tobytes() if has_letter(buf[a:b].tobytes()) else None for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("r"), pa.array(sets, pa.binary())], names=["lang", "r", "grams"])

    found = few.select("lang", "r", "text").mapInArrow(grams, "lang string, r int, grams binary").filter("grams IS NOT NULL").collect()
    found.sort(key=lambda x: (x["lang"], x["r"]))
    return Model([np.frombuffer(x["grams"], np.int32) for x in found], [x["lang"] for x in found], landmarks) if found else None


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang_pred, score. ``train`` says which rows may be learned from (their text and lang only)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train, text_col, lang_col, id_col, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            pick = [i for i, x in enumerate(texts) if has_letter(x)] if model.value else []
            names, score = [NONE] * len(texts), np.zeros(len(texts))
            if pick:
                best, found = model.value.score([np.frombuffer(texts[i], np.uint8) for i in pick])
                score[pick] = found
                for i, b in zip(pick, best.tolist()):
                    names[i] = model.value.labels[b]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, RESULT)
