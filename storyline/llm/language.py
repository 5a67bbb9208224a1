"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of one to ``LONGEST`` letters (presence, not counts), hashed to ``BINS``.
The kernel of two texts is the cosine of their sets. A bounded sample of labelled texts gives Nystrom landmarks; a
one-versus-rest kernel ridge regression is fitted on the landmark features; texts are scored in batches of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import mixed, row_with_text, slices, text_in, texts_of
from storyline.session import materialize

LONGEST = 3
BINS = 8192
#: Texts of each language that the model is fitted on. Of many languages each has fewer, so that they are ``SAMPLE`` in all, but
#: each has one at least and none is left out.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 25600
#: Landmarks at least, landmarks of each language, and landmarks at most, which all languages then share.
LANDMARKS, LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS = 256, 4, 1024
RIDGE = 1e-2
#: Texts a task turns into a dense matrix at once, and code points it hashes at once.
ROWS_AT_ONCE = 256
POINTS_AT_ONCE = 1 << 20

UNDETERMINED = "und"


def presence(text: str, bins: int = BINS) -> np.ndarray:
    """Which hashed n-grams of letters the text holds. Other characters count as one space; case is folded."""
    found = np.zeros(bins, bool)
    step = POINTS_AT_ONCE
    for start in range(0, max(1, len(text)), step):
        part = text[max(0, start - LONGEST + 1) : start + step].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letters = ((points >= 97) & (points <= 122)) | ((points >= 0xAA) & (points != 0xD7) & (points != 0xF7))
        points[~letters] = 32
        gram = np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            gram = (gram[: len(points) - n + 1] if n > 1 else gram) * np.uint64(0x1FFFF7) + points[n - 1 :] + np.uint64(n)
            found[(mixed(gram) % np.uint64(bins)).astype(np.int64)] = True
            if len(points) <= n:
                break
    return found


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Landmark sets (unit rows), the weights of each language over the landmark kernels, and the languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def score(self, sets: np.ndarray) -> np.ndarray:
        """One-versus-rest scores of rows of hashed sets."""
        return (unit_rows(sets) @ self.landmarks.T) @ self.weights


def unit_rows(sets: np.ndarray) -> np.ndarray:
    rows = sets.astype(np.float32)
    return rows / np.maximum(np.sqrt(rows.sum(axis=1, keepdims=True)), 1)


def fit(sets: np.ndarray, languages: list[str], landmarks: int | None = None, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on rows of hashed sets, given in an order that is random but fixed. No rows: no model."""
    if not languages:
        return None
    names = sorted(set(languages))
    number = {name: k for k, name in enumerate(names)}
    labels = np.array([number[x] for x in languages])
    turn = np.zeros(len(labels), np.int64)  # landmarks take turns among the languages
    for k in range(len(names)):
        turn[labels == k] = np.arange((labels == k).sum())
    landmarks = landmarks or min(MOST_LANDMARKS, max(LANDMARKS, LANDMARKS_PER_LANGUAGE * len(names)))
    marks = unit_rows(sets[np.lexsort((labels, turn))[:landmarks]]).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    weight = 1.0 / np.bincount(labels, minlength=len(names))[labels]  # languages count alike
    gram, aims = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(names)))
    for start in range(0, len(labels), ROWS_AT_ONCE):
        part = slice(start, start + ROWS_AT_ONCE)
        features = unit_rows(sets[part]).astype(np.float64) @ marks.T @ root
        targets = np.where(labels[part, None] == np.arange(len(names)), 1.0, -1.0)
        gram += features.T @ (features * weight[part, None])
        aims += features.T @ (targets * weight[part, None])
    solved = np.linalg.solve(gram + ridge * np.eye(gram.shape[0]), aims)
    return LanguageModel(marks.astype(np.float32), (root @ solved).astype(np.float32), names)


def train(docs: DataFrame, fold: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Learn from ``text`` and ``lang`` of at most ``per_language`` rows of each language.

    The rows are those with the least hash of id and text; each task and slice keeps no more than the bound. Their
    hashed sets, ``BINS`` bits each, are all that reaches the driver. Rows without language, or without a letter in the text, are left out.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fold is not None:
        rows = rows.filter(fold)
    kinds = rows.select("lang").distinct().count()
    per_language = min(per_language, max(1, SAMPLE // max(1, kinds)))
    key = F.xxhash64("doc_id", "text")
    rows = rows.select("lang", key.alias("key"), "text")
    # Each slice keeps its least keys, then each language; keys only, so that no text is shuffled.
    keys = rows.select("lang", "key", F.pmod("key", F.lit(32)).alias("slice"))
    for group in (["lang", "slice"], ["lang"]):
        window = Window.partitionBy(*group).orderBy("key")
        keys = keys.withColumn("n", F.row_number().over(window)).filter(F.col("n") <= per_language)
    # One row per language, written so that the join knows its size.
    edges = materialize(keys.groupBy("lang").agg(F.max("key").alias("last")), "edges")
    chosen = rows.join(edges, "lang").filter(F.col("key") <= F.col("last")).select("lang", "key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch["text"])
            packed = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["key"], pa.array(packed, pa.binary())], ["lang", "key", "bits"])

    found = chosen.mapInArrow(sets, "lang string, key bigint, bits binary").filter("bits is not null").distinct().collect()
    found = sorted({(r["key"], r["lang"], bytes(r["bits"])) for r in found})
    matrix = np.unpackbits(np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(-1, BINS // 8), axis=1)
    return fit(matrix, [r[1] for r in found])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add ``doc`` (the row, all its columns), ``lang_pred`` and ``score`` in [0, 1].

    A null text or one without a letter is ``und`` with score 0, as is every text if there was nothing to learn from. Ties
    go to the first language by name. Rows stay where they are; the model is a bounded number of landmarks, and weights of each language over them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.landmarks, model.weights, model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value and LanguageModel(*shared.value)
        for batch in slices(batches, ROWS_AT_ONCE):
            texts = text_in(batch).to_pylist()
            names: list[str] = [UNDETERMINED] * len(texts)
            scores = np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if has_letter(t)] if known else []
            if at:
                raw = known.score(np.vstack([presence(texts[i]) for i in at]))
                best = raw.argmax(axis=1)
                scores[at] = np.clip((raw.max(axis=1) + 1) / 2, 0, 1)
                for i, k in zip(at, best):
                    names[i] = known.languages[k]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(names), pa.array(scores)], ["doc", "lang_pred", "score"])

    rows = row_with_text(docs)
    schema = rows.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)
