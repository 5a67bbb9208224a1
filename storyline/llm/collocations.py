"""Phrase collocations from FM-indexes over word ids, one index per shard of the corpus.

A task lays the words of its texts end to end, as ids of a dictionary of the shard, with a mark between pieces that no phrase may
cross, and cuts a shard off every ``SHARD_TOKENS`` words. A shard's index is two Burrows-Wheeler transforms, of the ids and of the ids
reversed. A pattern is an interval of either. Extending it to the left by a word is a step in the first transform, which also moves
the interval in the second (by the extensions with smaller words); a step in the second extends it to the right. All patterns of a
depth are extended at once: their steps are the runs of equal (word, pattern) in the order of the last-to-first mapping. Suffixes
need sorting to the depth of the longest phrase only.

Counts are summed over shards level by level. A phrase can only reach the least count if its parts do, so each level asks a
shard for extensions of patterns and by words that reached it everywhere: words, then pairs, then triples. Pairs travel as packed
lists, one per shard and bucket of pairs; the number of buckets follows the number of words, so that none grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import mixed, packed, unpacked
from storyline.operators.ordering import positions
from storyline.session import drop_table, even_parts, write_table

#: Words of a shard; a text is never cut, so a very long one makes a longer shard.
SHARD_TOKENS = 1 << 20
LONGEST = 3
LEAST_COUNT = 10
#: A phrase goes if a longer one around it has this share of its count, in percent.
COVERED_PERCENT = 50
SCORE_SCALE = 1_000_000
NO_LANGUAGE = "und"
#: Pairs in a bucket, about.
BUCKET_PAIRS = 1 << 19

#: Piece ends become a byte that UTF-8 does not use, tabs become spaces.
PIECE_END = b"\xff"
_BYTES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b for b in range(256))

INDEX = "shard bigint, tokens bigint, langs array<string>, words array<string>, counts array<bigint>, forward binary, backward binary"


def split_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), with ``PIECE_END`` between pieces."""
    return text.lower().translate(_BYTES).replace(PIECE_END, b" \xff ").split()


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text (taken as a ring) in the order of the ``depth`` ids that start there.

    As many ids as fit one 64-bit key are sorted at once; what is deeper follows by prefix doubling.
    """
    rank = text.astype(np.int64)
    kinds, width = int(rank.max()) + 1, 1
    key = rank
    while width < depth and kinds ** (width + 1) < 1 << 63:
        key = key * kinds + np.roll(rank, -width)
        width += 1
    order = np.argsort(key)
    while width < depth:
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        key = rank * (rank.max() + 1) + np.roll(rank, -width)
        order = np.argsort(key)
        width *= 2
    return order


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The id before each place of :func:`suffix_order`: a Burrows-Wheeler transform to a limited depth."""
    return text[suffix_order(text, depth) - 1]


def first_ids(bwt: np.ndarray, kinds: int) -> np.ndarray:
    """The id each suffix starts with: the patterns of one word, as intervals."""
    return np.repeat(np.arange(kinds), np.bincount(bwt, minlength=kinds))


def extend_left(bwt: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of ids in a row: the first, the second, the count, and where the pair's interval starts in the reversed text.

    In the order of (word put before, pattern) an extension is a run, which is its interval. In the reversed text a pair lies
    inside the interval of its second word, after the pairs with smaller first words.
    """
    run = np.sort(bwt.astype(np.int64) * kinds + first_ids(bwt, kinds))
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.concatenate([start, [len(run)]]))
    first, second = np.divmod(run[start], kinds)
    there = np.argsort(second * kinds + first)
    back = np.empty_like(start)
    back[there] = np.cumsum(size[there]) - size[there]
    return first, second, size, back


def extend_right(backward: np.ndarray, start: np.ndarray, size: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extensions of patterns, given by their intervals in the reversed text: the pattern's number, the next id, the count."""
    pattern = np.repeat(np.arange(len(start)), size)
    inside = np.arange(len(pattern)) - np.repeat(np.cumsum(size) - size, size)
    run = np.sort(pattern * kinds + backward[start[pattern] + inside])
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    number, following = np.divmod(run[begin], kinds)
    return number, following, np.diff(np.concatenate([begin, [len(run)]]))


class Shard:
    """The words of some texts, as ids by language and word. Id 0 stands between pieces."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bytes]] = []
        self.languages: dict[str, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.tokens = 0

    def add(self, text: bytes, lang: str) -> None:
        ids = self.languages.get(lang)
        if ids is None:
            ids = self.languages[lang] = _Ids(self.names, lang)
        words = split_words(text)
        self.parts += [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.tokens += len(words)

    def row(self, number: int, depth: int) -> pa.RecordBatch:
        text = np.concatenate(self.parts)
        text = text[(text != 0) | (np.roll(text, 1) != 0)]
        if not text[0]:
            text = np.roll(text, -1)  # ends in a mark
        counts = np.bincount(text, minlength=len(self.names) + 1)[1:]
        columns = [
            pa.array([number]),
            pa.array([len(text)]),
            pa.array([[lang for lang, _ in self.names]], pa.list_(pa.string())),
            pa.array([[word for _, word in self.names]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([packed(transform(text, depth))], pa.binary()),
            pa.array([packed(transform(text[::-1], depth))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


class _Ids(dict):
    def __init__(self, names: list[tuple[str, bytes]], lang: str) -> None:
        super().__init__({PIECE_END: 0})
        self.names, self.lang = names, lang

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        found = self[word] = len(self.names)
        return found


def build_index(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, depth: int = LONGEST) -> DataFrame:
    """One row per shard of ``docs`` (``text, lang``): its dictionary with counts, and both transforms, packed.

    A null text has no words, a null language is ``NO_LANGUAGE``. Texts stay in their task; a shard mixes languages, but its dictionary
    doesn't, so words of two languages are different words.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 33, Shard()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                for text, lang in zip(part["text"].cast(pa.binary()).to_pylist(), part["lang"].to_pylist()):
                    shard.add(text or b"", lang)
                    if shard.tokens >= shard_tokens:
                        yield shard.row(number, depth)
                        number, shard = number + 1, Shard()
        if shard.names:
            yield shard.row(number, depth)

    return rows.mapInArrow(run, INDEX)


def _word_ids(found: dict, row: int, kinds: int) -> np.ndarray:
    """Corpus-wide ids of a shard's words, -1 for those below the least count."""
    ids = np.full(kinds, -1)
    for pair in found["ids"][row].as_py() or []:
        ids[pair["place"]] = pair["id"]
    return ids


def _pairs_of_shards(index: DataFrame, buckets: int) -> DataFrame:
    """``bucket, shard, size, pairs, counts``: the pairs of frequent words of each shard, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kinds = batch["kinds"][k].as_py()
                ids = _word_ids(batch, k, kinds)
                bwt = unpacked(batch["forward"][k].as_py(), batch["tokens"][k].as_py(), np.int32)
                first, second, size, _ = extend_left(bwt, kinds)
                use = (ids[first] >= 0) & (ids[second] >= 0)
                key, size = ids[first[use]] << 32 | ids[second[use]], size[use]
                bucket = (mixed(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key, bucket))
                key, size, bucket = key[order], size[order].astype(np.int32), bucket[order]
                cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(key)]]) if len(key) else np.zeros(1, np.int64)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                columns = [
                    pa.array(bucket[cuts[:-1]]),
                    pa.array([batch["shard"][k].as_py()] * len(spans), pa.int64()),
                    pa.array(np.diff(cuts)),
                    pa.array([packed(np.diff(key[a:b], prepend=0)) for a, b in spans], pa.binary()),
                    pa.array([packed(size[a:b]) for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "size", "pairs", "counts"])

    return index.select("shard", "tokens", "kinds", "forward", "ids").mapInArrow(run, "bucket bigint, shard bigint, size bigint, pairs binary, counts binary")


def _frequent_pairs(found: DataFrame, least: int) -> DataFrame:
    """``shard, size, pairs, counts``: the pairs of each bucket that reach the least count over all shards.

    One row per shard that has some of them; and a row without a shard with all of them and their counts.
    """

    def sums(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        key = np.concatenate([np.cumsum(unpacked(p, n, np.int64)) for p, n in zip(table["pairs"].to_pylist(), sizes)])
        count = np.concatenate([unpacked(c, n, np.int32) for c, n in zip(table["counts"].to_pylist(), sizes)])
        kinds, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, count).astype(np.int64)  # sums below 2^53 are exact
        use = (total >= least)[at]
        rows, low = [(None, int((total >= least).sum()), packed(kinds[total >= least]), packed(total[total >= least]))], 0
        for shard, n in zip(table["shard"].to_pylist(), sizes):
            kept = key[low : low + n][use[low : low + n]]
            low += n
            if len(kept):
                rows.append((shard, len(kept), packed(kept), b""))
        kinds_of = [("shard", pa.int64()), ("size", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())]
        return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds_of, zip(*rows))})

    return found.groupBy("bucket").applyInArrow(sums, "shard bigint, size bigint, pairs binary, counts binary")


def _triples_of_shards(index: DataFrame) -> DataFrame:
    """``first, second, third, n``: the triples of each shard whose both pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kinds, tokens = batch["kinds"][k].as_py(), batch["tokens"][k].as_py()
                ids = _word_ids(batch, k, kinds)
                first, second, size, start = extend_left(unpacked(batch["forward"][k].as_py(), tokens, np.int32), kinds)
                lists = [unpacked(p["pairs"], p["size"], np.int64) for p in batch["frequent"][k].as_py()]
                wanted = np.sort(np.concatenate(lists))
                use = _among(wanted, np.where((ids[first] >= 0) & (ids[second] >= 0), ids[first] << 32 | ids[second], -1))
                first, second, size, start = first[use], second[use], size[use], start[use]
                number, third, n = extend_right(unpacked(batch["backward"][k].as_py(), tokens, np.int32), start, size, kinds)
                use = _among(wanted, np.where(ids[third] >= 0, ids[second[number]] << 32 | ids[third], -1))
                columns = [ids[first[number[use]]], ids[second[number[use]]], ids[third[use]], n[use]]
                for low in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[low : low + (1 << 16)]) for c in columns], ["first", "second", "third", "n"])

    return index.select("shard", "tokens", "kinds", "forward", "backward", "ids", "frequent").mapInArrow(run, "first bigint, second bigint, third bigint, n bigint")


def _among(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in a sorted list that isn't empty."""
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _counted_pairs(found: DataFrame) -> DataFrame:
    """``first, second, n`` of the frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, pairs, counts in zip(*(batch[c].to_pylist() for c in ("size", "pairs", "counts"))):
                key = unpacked(pairs, size, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(unpacked(counts, size, np.int64))], ["first", "second", "n"])

    return found.filter("shard is null and size > 0").select("size", "pairs", "counts").mapInArrow(run, "first bigint, second bigint, n bigint")


def strength(both: Column, left: Column, right: Column) -> Column:
    """``floor(SCORE_SCALE * both^2 / (left * right))`` in whole numbers of up to 38 digits."""
    whole = [c.cast("decimal(15,0)") for c in (both, left, right)]
    scaled = (whole[0] * whole[0]).cast("decimal(31,0)") * F.lit(SCORE_SCALE).cast("decimal(7,0)")
    return F.call_function("div", scaled.cast("decimal(38,0)"), (whole[1] * whole[2]).cast("decimal(38,0)"))


def mine(docs: DataFrame, least: int = LEAST_COUNT, covered: int = COVERED_PERCENT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All phrases of two and three words of ``docs`` (``text, lang``) with a count of ``least`` or more, by language.

    ``lang, phrase, words, a, l, r, n, score``: the phrase's count, those of its parts at the weakest cut, the words of the language, and
    :func:`strength` at that cut; ``left_most, right_most``: the counts of its most frequent extensions by a word to either side, if any
    reaches ``least``; ``dropped``: whether one of those reaches ``covered`` percent of the phrase's own count. Three words are not
    extended. Texts that are null, empty or have no words add nothing, and repeated rows count each. Without any such phrase the table is empty.
    """
    spark = docs.sparkSession
    index, index_path = write_table(build_index(docs, shard_tokens), "index")
    entry = F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "entry")
    words = index.select("shard", entry).select("shard", (F.col("place") + 1).alias("place"), "entry.*").withColumnsRenamed({"langs": "lang", "words": "word", "counts": "n"})
    counted, counted_path = write_table(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # Dense numbers, so that a pair fits one 64-bit key.
    frequent, frequent_path = write_table(
        positions(counted.filter(F.col("n") >= least), [], [F.col("lang"), F.col("word")], "id").withColumn("id", F.col("id") - 1), "frequent"
    )
    shape = index.agg(F.count("*").alias("shards"), F.sum("tokens").alias("tokens")).first()
    if (frequent.count() or 0) >= 1 << 31:
        raise ValueError("over 2^31 frequent words; raise the least count")
    parts = max(even_parts(docs), shape["shards"] // 8)
    ids = words.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    numbered = index.withColumn("kinds", F.size("words") + 1).drop("langs", "words", "counts")
    ids, ids_path = write_table(ids, "ids")
    buckets = max(1, (shape["tokens"] or 0) // BUCKET_PAIRS)
    ready = numbered.select("shard", "tokens", "kinds", "forward").repartition(parts, "shard").join(ids, "shard")
    pairs, pairs_path = write_table(_frequent_pairs(_pairs_of_shards(ready, buckets), least), "pairs")
    twos, twos_path = write_table(_counted_pairs(pairs), "twos")
    wanted = pairs.filter("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("size", "pairs")).alias("frequent"))
    ready = numbered.repartition(parts, "shard").join(ids, "shard").join(wanted, "shard")
    threes = _triples_of_shards(ready).groupBy("first", "second", "third").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    threes, threes_path = write_table(threes, "threes")
    found, _ = write_table(_scored(twos, threes, frequent, covered).join(totals, "lang").withColumnRenamed("total", "n"), "phrases")
    for path in (index_path, counted_path, frequent_path, ids_path, pairs_path, twos_path, threes_path):
        drop_table(spark, path)
    return found.select("lang", "phrase", "words", "a", "l", "r", "n", "score", "left_most", "right_most", "dropped")


def _scored(twos: DataFrame, threes: DataFrame, words: DataFrame, covered: int) -> DataFrame:
    one = {k: words.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n")) for k in ("first", "second")}
    langs = words.select(F.col("id").alias("first"), "lang")
    named = twos.join(one["first"], "first").join(langs, "first").join(one["second"], "second")
    named = named.select("lang", "first", "second", F.array("first_word", "second_word").alias("words"), F.col("n").alias("a"), F.col("first_n").alias("l"), F.col("second_n").alias("r"))
    head = named.select("lang", "first", "second", F.col("words").alias("head"), F.col("a").alias("head_n"), F.col("l").alias("first_n"))
    tail = named.select(F.col("first").alias("second"), F.col("second").alias("third"), F.element_at("words", 2).alias("third_word"), F.col("a").alias("tail_n"), F.col("r").alias("third_n"))
    triple = threes.join(head, ["first", "second"]).join(tail, ["second", "third"])
    early = F.struct(strength(F.col("n"), F.col("first_n"), F.col("tail_n")).alias("score"), F.lit(1).alias("cut"), F.col("first_n").alias("l"), F.col("tail_n").alias("r"))
    late = F.struct(strength(F.col("n"), F.col("head_n"), F.col("third_n")).alias("score"), F.lit(2).alias("cut"), F.col("head_n").alias("l"), F.col("third_n").alias("r"))
    none = F.lit(None).cast("bigint")
    long = triple.withColumn("best", F.least(early, late)).select(
        "lang", F.concat("head", F.array("third_word")).alias("words"), F.col("n").alias("a"), "best.l", "best.r", "best.score",
        none.alias("left_most"), none.alias("right_most"),
    )
    right = threes.groupBy("first", "second").agg(F.max("n").alias("right_most"))
    left = threes.groupBy(F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("n").alias("left_most"))
    short = named.join(right, ["first", "second"], "left").join(left, ["first", "second"], "left").select(
        "lang", "words", "a", "l", "r", strength(F.col("a"), F.col("l"), F.col("r")).alias("score"), "left_most", "right_most"
    )
    around = F.greatest(F.coalesce("left_most", F.lit(0)), F.coalesce("right_most", F.lit(0)))
    return short.unionByName(long).withColumns({"phrase": F.array_join("words", " "), "dropped": 100 * around >= covered * F.col("a")})
