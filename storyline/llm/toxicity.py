"""Toxicity with a factorization machine over hashed terms.

Terms are the distinct words of a text and their first letters (inflected forms of one stem share those), hashed to
``BINS``. The machine adds a weight per term and, through a short vector per term, a weight per pair of terms, so that
two terms together can count for more than their sum. Terms that are spread evenly over both classes carry no feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import WORD_BYTES, WordHashes, row_with_text, slices, text_in, texts_of

BINS = 1 << 18
#: Labelled rows of each class that the machine is fitted on, at most. Each counts with all its terms.
SAMPLE_PER_CLASS = 3000
#: First letters (in bytes) of a word that count as terms of their own.
STEMS = (4, 5, 6)
FACTORS = 4
STEPS = 400
RATE = 0.1
SHRINK = 2e-4
#: A text is toxic from this score on.
TOXIC_FROM = 0.7


def terms(text: str, hashes: WordHashes, bins: int = BINS) -> np.ndarray:
    """The distinct hashed terms of the whole text, sorted."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    stems = {b"^" + w[:n] for w in words for n in STEMS if len(w) >= n}
    return np.unique(hashes.of([*words, *stems]) % np.uint64(bins)).astype(np.int64)


def packed(found: np.ndarray) -> bytes:
    """A list of terms as numbers or, of a long text, as one bit per bin, so that no text takes more than ``BINS / 8`` bytes."""
    if len(found) < BINS // 32:
        return found.astype(np.int32).tobytes()
    bits = np.zeros(BINS, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(found: bytes | np.ndarray) -> np.ndarray:
    if isinstance(found, np.ndarray):
        return found
    if len(found) < BINS // 8:
        return np.frombuffer(found, np.int32).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8)))


@dataclass
class FactorizationMachine:
    """Bias, the chosen terms' bins (sorted), their weights and their factor rows."""

    bias: float
    bins: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, lists: list[np.ndarray]) -> np.ndarray:
        """The value before the logistic function, one per list of terms."""
        lengths = np.array([len(x) for x in lists])
        every = np.concatenate([*lists, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(lists)), lengths)
        at = np.minimum(np.searchsorted(self.bins, every), max(0, len(self.bins) - 1))
        known = (self.bins[at] == every) if len(self.bins) else np.zeros(len(every), bool)
        return _margin(self.bias, self.weights, self.factors, row[known], at[known], len(lists))[0]

    def score(self, lists: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(lists), -30, 30)))


def _margin(bias: float, weights: np.ndarray, factors: np.ndarray, row: np.ndarray, at: np.ndarray, count: int):
    """Linear part plus half of (square of the factor sum less the sum of squares); also the factor sums."""
    linear = np.bincount(row, weights[at], count)
    sums = np.stack([np.bincount(row, factors[at, k], count) for k in range(factors.shape[1])], axis=1)
    squares = np.bincount(row, (factors[at] ** 2).sum(axis=1), count)
    return bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def chosen_terms(lists: list[bytes | np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Bins whose presence differs between the classes by more than chance among so many bins (G test)."""
    clean, toxic = np.zeros(BINS), np.zeros(BINS)
    for found, label in zip(lists, labels.tolist()):
        (toxic if label else clean)[unpacked(found)] += 1  # a text's terms are distinct
    n1, n0 = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    share = (toxic + clean) / (n1 + n0)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)

    g = 2 * (part(toxic, n1 * share) + part(clean, n0 * share) + part(n1 - toxic, n1 * (1 - share)) + part(n0 - clean, n0 * (1 - share)))
    return np.flatnonzero(g > 2 * np.log(max(2, (share > 0).sum())))


def fit(lists: list[bytes | np.ndarray], labels: list[int]) -> FactorizationMachine:
    """Fit by full-batch adaptive gradient steps on logistic loss, both classes with equal weight in total.

    Packed lists are unpacked one at a time, and only the chosen terms of each are held.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the only known class, or even odds
        share = 0.5 if not len(y) else float(np.clip(y[0], 0.01, 0.99))
        none = np.zeros(0)
        return FactorizationMachine(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.zeros((0, FACTORS)))
    bins = chosen_terms(lists, y)
    kept = [x[np.isin(x, bins)] for x in map(unpacked, lists)]
    row, at = np.repeat(np.arange(len(kept)), [len(x) for x in kept]), np.searchsorted(bins, np.concatenate(kept))
    bias, weights = 0.0, np.zeros(len(bins))
    factors = np.random.default_rng(7).normal(0, 0.01, (len(bins), FACTORS))
    importance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    seen = [1e-8, np.full(len(bins), 1e-8), np.full((len(bins), FACTORS), 1e-8)]
    for _ in range(STEPS):
        value, sums = _margin(bias, weights, factors, row, at, len(y))
        slope = importance * (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y)
        to_weights = np.bincount(at, slope[row], len(bins)) + SHRINK * weights
        pull = slope[row][:, None] * (sums[row] - factors[at])
        to_factors = np.stack([np.bincount(at, pull[:, k], len(bins)) for k in range(FACTORS)], axis=1) + SHRINK * factors
        moves = [slope.sum(), to_weights, to_factors]
        seen = [s + m**2 for s, m in zip(seen, moves)]
        bias, weights, factors = (v - RATE * m / np.sqrt(s) for v, m, s in zip((bias, weights, factors), moves, seen))
    value = _margin(bias, weights, factors, row, at, len(y))[0]
    return FactorizationMachine(float(bias) + shift(value, y), bins, weights, factors)


def shift(value: np.ndarray, y: np.ndarray) -> float:
    """What to add so that the cut that parts the classes of the sample best, halfway between its neighbours, scores ``TOXIC_FROM``.

    Nothing, if no cut tells at least half of one class from the other.
    """
    order = np.argsort(value, kind="stable")
    value, toxic = value[order], y[order] == 1
    kept = np.cumsum(~toxic) / max(1, (~toxic).sum()) - np.cumsum(toxic) / max(1, toxic.sum())  # if the cut is after each
    kept[:-1][value[1:] == value[:-1]] = -np.inf
    best = int(np.argmax(kept[:-1]))
    if kept[best] < 0.5:
        return 0.0
    return float(np.log(TOXIC_FROM / (1 - TOXIC_FROM)) - (value[best] + value[best + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, per_class: int = SAMPLE_PER_CLASS) -> FactorizationMachine:
    """Learn from the texts of ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, toxic``) marks 0 or 1.

    Of each class the ``per_class`` pairs of id and text with the least hash are taken, so an id with many texts counts with each of
    them, but no more rows than that reach the driver. Null ids and labels are left out, and an id that is labelled twice counts by its
    larger label. Ids may be of any type that both tables share.
    """
    rows = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if fold is not None:
        rows = rows.filter(fold)
    marked = rows.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    key = F.xxhash64("doc_id", "text").alias("key")
    keyed = docs.select("doc_id", key).join(marked, "doc_id").select("key", "_toxic").distinct()
    sample = None
    for value in (1, 0):
        part = keyed.filter(F.col("_toxic") == value).orderBy("key").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    chosen = {r["key"]: int(r["_toxic"]) for r in sample.collect()}
    picked = docs.sparkSession.createDataFrame([(k,) for k in chosen], "key bigint")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            found = [packed(terms(t, hashes)) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found, pa.binary())], ["key", "terms"])

    # At most twice ``per_class`` keys, so their side of the join has a known size.
    texts = docs.select("text", key).join(F.broadcast(picked), "key", "left_semi").dropDuplicates(["key"])
    found = texts.select("key", "text").mapInArrow(lists, "key bigint, terms binary")
    found = sorted((r["key"], bytes(r["terms"])) for r in found.collect())
    return fit([t for _, t in found], [chosen[k] for k, _ in found])


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """Add ``doc`` (the row, all its columns) and ``score`` in (0, 1), from the whole text alone.

    Null and empty texts score as the bias alone does. Rows stay where they are; the machine has ``BINS`` terms at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.bins, machine.weights, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), FactorizationMachine(*shared.value)
        for batch in slices(batches):
            found = [terms(t, hashes) for t in texts_of(text_in(batch))]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(known.score(found), pa.float64())], ["doc", "score"])

    rows = row_with_text(docs)
    return rows.mapInArrow(run, rows.select("doc", F.lit(0.0).alias("score")).schema)
