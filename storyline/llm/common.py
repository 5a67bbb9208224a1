"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.session import prepare

#: ASCII letters and digits stand for words, A-Z in lower case; other ASCII bytes separate; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Entries of a task's cache of word hashes.
CACHE_WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_remainder(column: str, divisor: int) -> Column:
    """``crc32`` of the id as text, modulo the divisor: the fold of a row. A null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a public hash)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Fixed odd multipliers."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Views of ``rows`` rows at most, so that what a task makes of texts does not depend on the size of Spark's batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # workers are used again


def row_with_text(docs: DataFrame) -> DataFrame:
    """``doc``: the row, all its columns, so that a text goes to a task once; :func:`text_in` takes it out there."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def text_in(batch: pa.RecordBatch) -> pa.Array:
    """The texts of the rows in ``doc``; null for a null text."""
    docs = batch["doc"]
    return pc.struct_field(docs, docs.type.get_field_index("text"))


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array."""
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, count * np.dtype(kind).itemsize, codec="zstd"), kind)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def stream_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], handle: Callable[[pa.Table], pa.Table | None], flush_rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """Call ``handle`` once per group of adjacent rows with equal integer keys.

    The caller has dealt and sorted the rows by the keys, and each group is bounded, so a task holds one group and
    one batch, however many groups it has.
    """
    carry: pa.Table | None = None
    waiting: list[pa.Table] = []
    held = 0

    def cuts(found: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, found.num_rows - 1), bool)
        for key in keys:
            values = found[key].to_numpy()
            change |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [found.num_rows]])

    def work(found: pa.Table, edges: np.ndarray) -> None:
        nonlocal held
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            made = handle(found.slice(start, end - start))
            if made is not None and made.num_rows:
                waiting.append(made)
                held += made.num_rows

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        found = part if carry is None else pa.concat_tables([carry, part])
        edges = cuts(found)
        work(found, edges[:-1])
        carry = found.slice(int(edges[-2]))
        if held >= flush_rows:
            yield from pa.concat_tables(waiting).combine_chunks().to_batches()
            waiting, held = [], 0
    if carry is not None and carry.num_rows:
        work(carry, np.array([0, carry.num_rows]))
    if waiting:
        yield from pa.concat_tables(waiting).combine_chunks().to_batches()


def least_linked(links: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and each column of a link matrix can reach inside the matrix."""
    left, right = left_ids.copy(), right_ids.copy()
    top = np.iinfo(np.int64).max
    rows, columns = np.nonzero(links)
    while len(rows):
        near = np.full(len(left), top)
        np.minimum.at(near, rows, right[columns])
        new_left = np.minimum(left, near)
        back = np.full(len(right), top)
        np.minimum.at(back, columns, new_left[rows])
        new_right = np.minimum(right, back)
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    return left, right


def tile_pairs(rows: DataFrame, tiles: str, tile: str) -> DataFrame:
    """Send each row to every unordered pair ``p <= q`` of tiles that holds its own tile."""
    every = F.sequence(F.lit(0).cast("bigint"), F.col(tiles) - 1)
    pair = F.transform(every, lambda k: F.struct(F.least(k, F.col(tile)).alias("p"), F.greatest(k, F.col(tile)).alias("q")))
    return rows.withColumn("_pair", F.explode(pair)).withColumns({"p": F.col("_pair.p"), "q": F.col("_pair.q")}).drop("_pair")
