"""Similarity join of texts on word shingles: a MinHash LSH forest finds candidates, exact Jaccard verifies them.

* A text is the set of its runs of ``SHINGLE`` words. Texts with equal sets are a class; only classes are compared.
* Each of ``TREES`` tries holds ``DEEPEST`` min-hashes of a class, 16 bits each. The rows of all tries are range-partitioned and
  sorted by that path, so the classes below a node stand side by side, and the longest prefix that a row shares with a
  neighbour says how deep its first partner lies. Rows without a neighbour at the shortest useful prefix leave here.
* Matched prefixes start at full depth and are shortened value by value. After each level the links found so far tell the
  weakest similarity in this corpus; shortening ends when a link that weak is met with the target recall, or at
  ``depth_for()``, where every link at the threshold is.
* A pair is verified once: at the level of its longest common prefix, in the first tree that has it. Whole signatures rule out pairs
  that are far from the threshold; texts are sent only for classes with a pair left, and compared as sorted shingle arrays.
* Nodes are cut into tiles, and each pair of tiles is one bounded Spark group. A task counts links and returns one
  row per class; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import WORD_BYTES, WordHashes, least_linked, mixed, odd_numbers, slices, stream_groups, texts_of, tile_pairs
from storyline.operators.components import connected_components
from storyline.session import materialize

SHINGLE = 5
SIMILAR = 0.8
TREES = 24
DEEPEST = 6
RECALL = 0.99999
#: Bytes of a min-hash in a path, and bits of a node's number that are left below those of its tree.
VALUE_BYTES, NODE_BITS = 2, 58
#: Standard deviations of the signature estimate below the threshold at which a candidate is ruled out.
DEVIATIONS = 5.0
#: Classes and shingles per tile of a node.
NODE_TILE = 1024
TILE_SHINGLES = 1 << 21
#: Pairs per class of a tile up to which pairs are intersected one by one, not as a product of matrices.
FEW_PAIRS = 2
#: Products of shingles and min-hash multipliers held at once, and shingle columns of a block of counts.
CELLS = 1 << 20
COLUMNS = 4096
#: Bytes of paths are big-endian, so that their order is that of the values.
PATH = np.dtype(">u2")


def depth_for(similar: float = SIMILAR, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix, shortened value by value, at which pairs at the threshold meet often enough."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - similar**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def shingles(text: str, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashed runs of ``width`` words; a shorter text with words is one run."""
    words = hashes.of((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    if not len(words):
        return words
    width = min(width, len(words))
    found = np.zeros(len(words) - width + 1, np.uint64)
    for k, odd in enumerate(odd_numbers(width, 11)):
        found += words[k : k + len(found)] * odd
    return np.unique(mixed(found + np.uint64(width)))


def min_hashes(found: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least product of the shingles with each multiplier, modulo 2**64."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, CELLS // len(multipliers))
    for start in range(0, len(found), step):
        least = np.minimum(least, (found[start : start + step, None] * multipliers).min(axis=0))
    return least


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right set, as blocked products of 0/1 matrices."""
    both = [*left, *right]
    every = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, column = np.unique(every, return_inverse=True)
    split = len(left)
    seen = np.bincount(column[row < split], minlength=len(values)) * np.bincount(column[row >= split], minlength=len(values))
    place = np.cumsum(seen > 0) - 1
    keep = seen[column] > 0
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((split, len(right)), np.float64)
    width = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, width, COLUMNS):
        stop = min(width, start + COLUMNS)
        part = slice(*np.searchsorted(column, [start, stop]))
        block = np.zeros((len(both), stop - start), np.float32)
        block[row[part], column[part] - start] = 1
        counts += block[:split] @ block[split:].T
    return counts


def _signed(texts: DataFrame) -> DataFrame:
    """Per row: class of its shingle set (two 64-bit halves), number of shingles, signature (the paths of all trees)."""
    multipliers = odd_numbers(TREES * DEEPEST, 23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            size, high, low, marks = [], [], [], []
            for text in texts_of(batch["text"]):
                found = shingles(text, hashes)
                size.append(len(found))
                if not len(found):
                    high.append(None), low.append(None), marks.append(None)
                    continue
                whole = xxhash.xxh3_128_digest(found.tobytes())
                halves = np.frombuffer(whole, np.int64)
                high.append(int(halves[0])), low.append(int(halves[1]))
                least = mixed(min_hashes(found, multipliers))
                marks.append((least >> np.uint64(64 - 8 * VALUE_BYTES)).astype(PATH).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["text_key"], batch["number"], pa.array(size, pa.int64()), pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()), pa.array(marks, pa.binary()),
                ],
                ["doc_id", "text_key", "number", "size", "high", "low", "marks"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, number bigint, size bigint, high bigint, low bigint, marks binary"
    return texts.mapInArrow(run, schema)


def text_key():
    """Stands for a row's id and text, so that a text is found again; equal rows have the same."""
    return F.xxhash64("doc_id", "text")


def join(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, text_key, n_links, class_id, kept``.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard similarity of at least ``similar``. ``class_id`` is the
    least ``doc_id`` reachable by links, ``kept`` is true for one row of each class: the least id, and of equal ids the first read.
    Texts without words (null, empty, signs only) link with nothing and are kept. Repeated rows and equal texts are linked like
    others. A null id is less than others. Other columns are ignored.
    """
    floor = depth_for(similar)
    texts = docs.select("doc_id", "text", text_key().alias("text_key"), F.monotonically_increasing_id().alias("number"))
    rows = materialize(_signed(texts), "signed")
    named = rows.filter(F.col("high").isNotNull())
    classes = materialize(named.groupBy("high", "low").agg(F.count("*").alias("copies"), F.min("number").alias("id")), "classes")
    chosen = named.join(classes.select(F.col("id").alias("number"), "copies"), "number")
    chosen = materialize(chosen.select(F.col("number").alias("id"), "copies", "text_key", "size", "marks"), "chosen")
    checked = _links(chosen, docs, similar, floor)
    links = checked.groupBy("id").agg(F.sum("links").alias("near"))
    edges = checked.filter(F.col("target") != F.col("id")).select(F.col("id").alias("a"), F.col("target").alias("b"))
    joined = connected_components(checked.select("id").distinct(), edges, [])
    found = classes.join(links, "id", "left").join(joined, "id", "left").select(
        "high", "low", F.coalesce("cluster_id", "id").alias("class"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    result = materialize(rows.select("doc_id", "text_key", "number", "high", "low").join(found, ["high", "low"], "left"), "linked")
    first = result.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    first = materialize(first, "first")
    alone = F.col("class").isNull()
    return result.join(first, "class", "left").select(
        "doc_id",
        "text_key",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (alone | (F.col("number") == F.col("first.number"))).alias("kept"),
    )


def _links(chosen: DataFrame, docs: DataFrame, similar: float, floor: int) -> DataFrame:
    """Level by level from full depth: per class and pair of tiles ``id, links`` (rows linked), ``target``, ``weakest``."""
    forest = materialize(_forest(chosen, floor), "forest")
    ids = forest.select("id").distinct()
    members = chosen.join(ids, "id").select("id", "text_key")
    texts = docs.select(text_key().alias("text_key"), "text").join(members, "text_key")
    texts = materialize(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")  # equal rows have equal keys
    checked = None
    for depth in range(DEEPEST, floor - 1, -1):
        found = _verify(_candidates(forest, chosen, depth, similar), chosen, texts, depth, similar)
        checked = found if checked is None else checked.unionByName(found)
        if depth > floor and _recalled(checked, depth, similar):
            break
    return checked


def _recalled(checked: DataFrame, depth: int, similar: float) -> bool:
    """Whether prefixes of this depth meet the target recall on this corpus, so that they need not be shortened.

    A link as weak as the weakest one found must be met with the target recall, and an unseen one at the threshold must
    weigh no more than the target allows among the links found.
    """
    missed = lambda s: (1 - s**depth) ** TREES
    seen = checked.agg(F.min("weakest").alias("weakest"), F.sum("links").alias("links")).first()
    if not seen["links"]:
        return False
    return missed(seen["weakest"]) <= 1 - RECALL and missed(similar) <= (1 - RECALL) * seen["links"]


def _forest(chosen: DataFrame, floor: int) -> DataFrame:
    """``id, size, tree, path, near``: the sorted rows of all tries that share at least ``floor`` values with a neighbour.

    ``near`` is the longest prefix shared with the row before or after. At the borders of a partition the neighbour is not
    seen and counts as equal; the nodes' counts decide there.
    """
    width = DEEPEST * VALUE_BYTES
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("marks"), t * width + 1, F.lit(width)))
    spread = chosen.select("id", "size", F.posexplode(paths).alias("tree", "path"))
    order = ["tree", "path", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, before = None, np.array([DEEPEST])

        def kept(found: pa.Table, left: np.ndarray, right: np.ndarray) -> list[pa.RecordBatch]:
            near = np.maximum(left, right)
            found = found.append_column("near", pa.array(near.astype(np.int32)))
            return found.filter(pa.array(near >= floor)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            found = pa.Table.from_batches([batch])
            found = found if carry is None else pa.concat_tables([carry, found])
            values = np.frombuffer(b"".join(found["path"].to_pylist()), PATH).reshape(-1, DEEPEST)
            tree = found["tree"].to_numpy()
            same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
            shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            left = np.concatenate([before, shared])
            yield from kept(found.slice(0, found.num_rows - 1), left[:-1], shared)
            carry, before = found.slice(found.num_rows - 1), left[-1:]
        if carry is not None:
            yield from kept(carry, before, np.array([DEEPEST]))

    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "id bigint, size bigint, tree int, path binary, near int")


def _candidates(forest: DataFrame, chosen: DataFrame, depth: int, similar: float) -> DataFrame:
    """Classes with a pair to verify at this level: ``block, node, p, q, tile, id``."""
    part = F.xxhash64(F.substring("path", 1, depth * VALUE_BYTES)).bitwiseAND(F.lit((1 << NODE_BITS) - 1))
    node = F.shiftleft(F.col("tree").cast("bigint"), NODE_BITS).bitwiseOR(part)
    child = F.xxhash64(F.substring("path", 1, (depth + 1) * VALUE_BYTES))
    below = forest.filter(F.col("near") >= depth).select("id", "size", node.alias("node"), child.alias("child"))
    nodes = below.groupBy("node").agg(
        F.count("*").alias("rows"), F.sum("size").alias("sizes"), F.bit_xor(F.xxhash64("id")).alias("members"),
        (F.min("child") != F.max("child")).alias("parts"),
    ).filter("rows > 1")
    if depth < DEEPEST:
        nodes = nodes.filter("parts")  # pairs below one child were met at the level before
    # Trees that gather the same classes below a node need that node once, in the first of them.
    nodes = nodes.groupBy("rows", "members").agg(F.min("node").alias("node"), F.max("sizes").alias("sizes"))
    tiles = F.greatest(F.ceil(F.col("rows") / NODE_TILE), F.ceil(F.col("sizes") / TILE_SHINGLES))
    nodes = materialize(nodes.select("node", tiles.alias("tiles")), "nodes")
    below = below.select("id", "node").join(nodes, "node").join(chosen.select("id", "size", "marks"), "id")
    dealt = tile_pairs(below.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))), "tiles", "tile")
    dealt = dealt.withColumn("block", F.xxhash64("node", "p", "q")).select("block", "node", "p", "q", "tile", "id", "size", "marks")

    def compare(found: pa.Table) -> pa.Table | None:
        left, right = _sides(found)
        near = _to_verify(found, left, right, depth, similar)
        if near is None:
            return None
        hit = np.zeros(found.num_rows, bool)
        hit[left] |= near.any(axis=1)
        hit[right] |= near.any(axis=0)
        return found.select(["block", "node", "p", "q", "tile", "id"]).filter(pa.array(hit))

    order = ["block", "node", "p", "q"]
    dealt = dealt.repartition("block").sortWithinPartitions(*order)
    kinds = "block bigint, node bigint, p bigint, q bigint, tile bigint, id bigint"
    return materialize(dealt.mapInArrow(lambda batches: stream_groups(batches, order, compare), kinds), "candidates")


def _to_verify(found: pa.Table, left: np.ndarray, right: np.ndarray, depth: int, similar: float) -> np.ndarray | None:
    """Pairs of a node's tiles that meet first here and may be similar; None without any."""
    if not len(left) or not len(right):
        return None
    ids, size = found["id"].to_numpy(), found["size"].to_numpy()
    tree = int(found["node"][0].as_py()) >> NODE_BITS
    marks = np.frombuffer(b"".join(found["marks"].to_pylist()), PATH).astype(np.uint16).reshape(len(ids), TREES, DEEPEST)
    near = _sizes_allow(size[left], size[right], similar) & (ids[left][:, None] != ids[right][None, :])
    here = _prefixes(marks, depth)
    near &= here[left, tree][:, None] == here[right, tree][None, :]
    for t in range(tree):
        near &= here[left, t][:, None] != here[right, t][None, :]
    if depth < DEEPEST:
        longer = _prefixes(marks, depth + 1)
        for t in range(TREES):
            near &= longer[left, t][:, None] != longer[right, t][None, :]
    a, b = np.nonzero(near)
    flat, width = marks.reshape(len(ids), -1), TREES * DEEPEST
    least = similar - DEVIATIONS * np.sqrt(similar * (1 - similar) / width)
    step = max(1, CELLS // width)
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        near[a[part], b[part]] = (flat[left[a[part]]] == flat[right[b[part]]]).sum(axis=1) >= least * width
    return near if near.any() else None


def _prefixes(marks: np.ndarray, depth: int) -> np.ndarray:
    """One number per class and tree for the first ``depth`` values of the path."""
    return mixed(mixed(marks[:, :, :depth].astype(np.uint64) + np.uint64(1)) * odd_numbers(depth, 31)).sum(axis=2, dtype=np.uint64)


def _sides(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tile, q = found["tile"].to_numpy(), found["q"][0].as_py()
    right = np.flatnonzero(tile == q)
    return (right if found["p"][0].as_py() == q else np.flatnonzero(tile != q)), right


def _sizes_allow(left: np.ndarray, right: np.ndarray, similar: float) -> np.ndarray:
    """Sets whose sizes alone don't rule the similarity out."""
    low, high = np.minimum(left[:, None], right[None, :]), np.maximum(left[:, None], right[None, :])
    return low >= similar * high - 1e-9


def _verify(candidates: DataFrame, chosen: DataFrame, texts: DataFrame, depth: int, similar: float) -> DataFrame:
    """The pairs of each block, on whole texts. Per class and block: ``id, links`` (rows linked), ``target``, ``weakest`` similarity."""
    dealt = candidates.join(chosen.select("id", "copies", "size", "marks"), "id").join(texts, "id")
    order = ["block", "node", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def compare(found: pa.Table) -> pa.Table | None:
            left, right = _sides(found)
            near = _to_verify(found, left, right, depth, similar)
            if near is None:
                return None
            ids, copies = found["id"].to_numpy(), found["copies"].to_numpy()
            likeness = _jaccard([shingles(t, hashes) for t in texts_of(found["text"])], left, right, near)
            near &= likeness >= similar - 1e-9
            if not near.any():
                return None
            low_left, low_right = least_linked(near, ids[left], ids[right])
            likeness[~near] = 2
            out = [(ids[left], near @ copies[right], low_left, likeness.min(axis=1))]
            if left is not right:
                out.append((ids[right], near.T @ copies[left], low_right, likeness.min(axis=0)))
            out_ids, links, target, weakest = (np.concatenate(x) for x in zip(*out))
            hit = links > 0
            return pa.table({"id": out_ids[hit], "links": links[hit].astype(np.int64), "target": target[hit], "weakest": weakest[hit]})

        return stream_groups(batches, order, compare)

    dealt = dealt.select(*order, "tile", "id", "copies", "size", "marks", "text").repartition("block").sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, "id bigint, links bigint, target bigint, weakest double"), "checked")


def _jaccard(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact similarities of the wanted pairs; the others are 0 or any value."""
    size = np.array([len(x) for x in sets])
    a, b = np.nonzero(wanted)
    if len(a) > FEW_PAIRS * (len(left) + len(right)):
        shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
    else:
        shared = np.zeros(wanted.shape)
        for i, j in zip(a.tolist(), b.tolist()):
            shared[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
    return shared / (size[left][:, None] + size[right][None, :] - shared)


def deduplicate(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class, with the columns of ``docs``. Rows equal in id and text are one document."""
    kept = join(docs, similar).filter("kept").select("text_key").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_key().alias("text_key"))
    one = keyed.join(kept, "text_key", "left_semi").groupBy("text_key").agg(F.first("doc").alias("doc"))
    return one.select("doc.*")
