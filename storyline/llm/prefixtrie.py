"""Prefix trie of conversations by bursting containers.

Conversations with the same turns are folded into one class. At first all classes lie in one container under the root. A container with
too many turns bursts: its classes are dealt by their next turn into containers one level deeper, and its head becomes a node of the
trie's top. What remains are containers of a bounded number of turns. Each task holds many of them; it sorts their suffixes and
sweeps once over the sorted list, which visits every node below the heads. Sums of whole subtrees reach the nodes of the top from the
heads of the containers beneath.

A node is told by its depth and its smallest member, since a conversation passes one node of each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyline.operators.ordering import positions
from storyline.session import drop_table, even_parts, write_table

#: A container with more turns and classes bursts.
CONTAINER_ROWS = 1 << 16
#: Rows of whole containers that a task sweeps at once, about.
SWEPT_ROWS = 1 << 15
#: Ids in a block of a long list that is hashed.
BLOCK_IDS = 1 << 16
KEY_BYTES = 16

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary, head boolean"
_NODE_TYPES = [*[pa.int64()] * 7, pa.binary(), pa.bool_()]
_NODE_NAMES = [c.split()[0] for c in NODES.split(", ")]


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, turn_key, bytes``: the turns of ``conv_id, turn, role, text`` in order, from depth 1.

    Null turns come first; rows with equal turns follow by their key. Null roles and texts are empty, and rows without ``conv_id``
    belong to no conversation and are left out. ``turn_key`` is a 128-bit hash of role and text. A conversation of any length is
    numbered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(whole, 256)), 1, KEY_BYTES).alias("turn_key"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return positions(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_key")], "depth").select("conv_id", "depth", "turn_key", "bytes")


def _classes(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rep, weight, n, ends``: conversations with the same turns under their smallest id, and the hash of the list of their ids."""
    def of(seed: int):
        return F.bit_xor(F.xxhash64(F.lit(seed), "depth", "turn_key"))

    prints = turns.groupBy("conv_id").agg(F.count("*").alias("n"), of(1).alias("p"), of(2).alias("q"))
    zero = F.lit(0).cast("bigint")
    folded, path = write_table(
        members.select("conv_id").distinct().join(prints, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in "npq"]), "prints"
    )
    classes, classes_path = write_table(folded.groupBy("n", "p", "q").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "classes")
    many = folded.join(classes.filter("weight > 1"), ["n", "p", "q"]).select("rep", "conv_id")
    own = F.unhex(F.sha2(F.col("rep").cast("string"), 256))
    found = classes.join(_hashed_lists(many), "rep", "left").select("rep", "weight", "n", F.coalesce("ends", own).alias("ends"))
    return found, [path, classes_path]


def _hashed_lists(pairs: DataFrame) -> DataFrame:
    """``rep, ends``: SHA-256 of the ids of each class, ascending and comma-joined.

    A range shuffle spreads a class of any size over tasks that write blocks of its list, so the task that hashes them
    reads few rows and holds one block.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, conv = batch["rep"].to_numpy(), batch["conv_id"].to_numpy()
            cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]])), [len(rep)]]) if len(rep) else [0]
            spans = [(a, min(b, a + BLOCK_IDS)) for low, b in zip(cuts[:-1], cuts[1:]) for a in range(low, b, BLOCK_IDS)]
            data = [",".join(map(str, conv[a:b].tolist())).encode() for a, b in spans]
            firsts = [a for a, _ in spans]
            yield pa.RecordBatch.from_arrays([pa.array(rep[firsts]), pa.array(conv[firsts]), pa.array(data, pa.binary())], ["rep", "first", "data"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for rep, data in zip(batch["rep"].to_pylist(), batch["data"].to_pylist()):
                if state is None or rep != now:
                    if state is not None:
                        done.append((now, state.digest()))
                    now, state = rep, hashlib.sha256(data)
                else:
                    state.update(b"," + data)
            yield _pairs(done)
        if state is not None:
            yield _pairs([(now, state.digest())])

    def _pairs(done: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([h for _, h in done], pa.binary())], ["rep", "ends"])

    spread = pairs.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    listed = spread.mapInArrow(blocks, "rep bigint, first bigint, data binary")
    return listed.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashes, "rep bigint, ends binary")


class Sweep:
    """Nodes of sorted suffixes. A node is finished when the sweep leaves it, and adds its sums to the node above."""

    def __init__(self) -> None:
        self.conv: list[int] = []
        self.depth: list[int] = []
        self.above: list[int] = []
        self.convs: list[int] = []
        self.children: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.ends: list[bytes | None] = []
        self.bytes: list[int] = []

    def open(self, depth: int, above: int, size: int) -> int:
        for column, value in ((self.conv, 1 << 62), (self.depth, depth), (self.above, above), (self.convs, 0), (self.children, 0)):
            column.append(value)
        for column, value in ((self.leaves, 0), (self.saved, 0), (self.ends, None), (self.bytes, size)):
            column.append(value)
        return len(self.conv) - 1

    def close(self, node: int) -> None:
        if not self.children[node]:
            self.leaves[node] = 1
        self.saved[node] += (self.convs[node] - 1) * self.bytes[node]
        above = self.above[node]
        if above >= 0:
            self.conv[above] = min(self.conv[above], self.conv[node])
            self.convs[above] += self.convs[node]
            self.children[above] += 1
            self.leaves[above] += self.leaves[node]
            self.saved[above] += self.saved[node]

    def container(self, depth: int, suffixes: list[tuple[bytes, int, int, bytes, list[int]]]) -> None:
        """Sweep over ``(keys, rep, weight, ends, bytes)`` of each class, its keys from the head on. The head's own bytes are left out."""
        suffixes.sort(key=lambda s: s[0])
        stack, before = [self.open(depth, -1, 0)], b""
        for keys, rep, weight, ends, sizes in suffixes:
            shared, most = 0, min(len(keys), len(before))
            while shared < most and keys[shared : shared + KEY_BYTES] == before[shared : shared + KEY_BYTES]:
                shared += KEY_BYTES
            shared //= KEY_BYTES
            while len(stack) > shared + 1:
                self.close(stack.pop())
            for k in range(shared, len(sizes)):
                stack.append(self.open(depth + k + 1, stack[-1], sizes[k]))
            node = stack[-1]
            self.conv[node] = min(self.conv[node], rep)
            self.convs[node] += weight
            self.ends[node] = ends
            before = keys
        while stack:
            self.close(stack.pop())

    def rows(self) -> pa.RecordBatch:
        parent = [None if a < 0 else self.conv[a] for a in self.above]
        head = [a < 0 for a in self.above]
        columns = [self.conv, self.depth, parent, self.convs, self.children, self.leaves, self.saved, self.ends, head]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES)], _NODE_NAMES)


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of the containers. ``rows``: ``at, head, rep, depth, turn_key, bytes, weight, ends``, dealt and sorted; a class's first row is its own."""

    def sweep(found: pa.Table) -> pa.RecordBatch:
        made, waiting = Sweep(), []
        now = None
        columns = [found[c].to_pylist() for c in ("at", "head", "rep", "turn_key", "bytes", "weight", "ends")]
        for at, head, rep, key, size, weight, ends in zip(*columns):
            if (at, head) != now:
                if waiting:
                    made.container(now[0], [(b"".join(k), *rest) for k, *rest in waiting])
                now, waiting = (at, head), []
            if weight is not None:
                waiting.append(([], rep, weight, ends, []))
            else:
                waiting[-1][0].append(key)
                waiting[-1][4].append(size)
        if waiting:
            made.container(now[0], [(b"".join(k), *rest) for k, *rest in waiting])
        return made.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.RecordBatch] = []
        for batch in batches:
            carry.append(batch)
            if sum(b.num_rows for b in carry) < SWEPT_ROWS:
                continue
            found = pa.Table.from_batches(carry)
            at, head = found["at"].to_numpy(), found["head"].to_numpy()
            last = int(np.argmax((at == at[-1]) & (head == head[-1])))  # the last container may go on
            if last:
                yield sweep(found.slice(0, last))
            carry = found.slice(last).to_batches()
        if carry:
            yield sweep(pa.Table.from_batches(carry))

    return rows.mapInArrow(run, NODES)


def build(turns: DataFrame, members: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """All nodes of the trie over the conversations of ``members`` (``conv_id``) with ``turns`` (``conv_id, depth, turn_key, bytes``).

    Depths count from 1 without gaps. Returns ``conv_id`` (smallest member), ``depth, parent_conv_id`` (null for the root),
    ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. Members without turns are at the root. Without members there is no
    node. Each burst takes a few small jobs, so their number follows the depth of turns that oversized containers share.
    """
    spark = turns.sparkSession
    turns, turns_path = write_table(turns.select("conv_id", "depth", "turn_key", "bytes"), "turns")
    classes, paths = _classes(turns, members)
    paths.append(turns_path)
    none = F.lit(None).cast("bigint")
    state = classes.crossJoin(classes.agg(F.min("rep").alias("head"))).select(
        "*", none.alias("parent"), F.lit(0).cast("bigint").alias("own"), F.array().cast("array<bigint>").alias("path")
    )
    state, path = write_table(state, "state")
    paths.append(path)
    settled, top, lonely = [], [], []
    depth = 0
    while True:
        size = F.sum(F.col("n") - depth + 1)
        heads = state.groupBy("head").agg(
            size.alias("rows"), F.count("*").alias("kinds"), F.sum("weight").alias("n_convs"),
            *[F.first(c).alias(c) for c in ("parent", "own", "path")],
            F.max(F.when(F.col("n") == depth, F.col("ends"))).alias("ends"),
        )
        heads, path = write_table(heads.withColumn("burst", (F.col("rows") > container_rows) & (F.col("kinds") > 1)), "heads")
        paths.append(path)
        marked = state.join(heads.select("head", "burst", "rows"), "head")
        here = F.lit(depth).cast("bigint").alias("at")
        settled.append(marked.filter(~F.col("burst") & (F.col("rows") <= container_rows)).select("rep", "weight", "n", "ends", here, "head", "parent", "own", "path"))
        lonely.append(marked.filter(~F.col("burst") & (F.col("rows") > container_rows)).select("rep", "weight", "n", "ends", here, "head", "parent", "own", "path"))
        top.append(heads.filter("burst").select(here, F.col("head").alias("conv_id"), "parent", "n_convs", "own", "path", "ends"))
        if not heads.filter("burst").take(1):
            break
        following = turns.filter(F.col("depth") == depth + 1).select(F.col("conv_id").alias("rep"), "turn_key", "bytes")
        moved = marked.filter(F.col("burst") & (F.col("n") > depth)).join(following, "rep")
        moved, path = write_table(moved.select("rep", "weight", "n", "ends", "head", "path", "turn_key", "bytes"), "moved")
        paths.append(path)
        child = moved.groupBy("head", "turn_key").agg(F.min("rep").alias("child"))
        state, path = write_table(
            moved.join(child, ["head", "turn_key"]).select(
                "rep", "weight", "n", "ends", F.col("child").alias("head"), F.col("head").alias("parent"), F.col("bytes").alias("own"),
                F.concat("path", F.array("head")).alias("path"),
            ),
            "state",
        )
        paths.append(path)
        depth += 1

    def union(parts: list[DataFrame]) -> DataFrame:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    settled, path = write_table(union(settled), "settled")
    paths.append(path)
    alone, path = write_table(union(lonely), "alone")
    paths.append(path)
    tops, path = write_table(union(top), "top")
    paths.append(path)
    own = settled.select("at", "head", "rep", F.col("at").alias("depth"), F.lit(None).cast("binary").alias("turn_key"), none.alias("bytes"), "weight", "ends")
    rest = settled.select("at", "head", "rep").join(turns.withColumnRenamed("conv_id", "rep"), "rep").filter(F.col("depth") > F.col("at")).select(
        "at", "head", "rep", "depth", "turn_key", "bytes", none.alias("weight"), F.lit(None).cast("binary").alias("ends")
    )
    dealt = own.unionByName(rest).repartition(even_parts(turns), "at", "head").sortWithinPartitions("at", "head", "rep", "depth")
    nodes, path = write_table(_swept(dealt).unionByName(_chains(alone, turns)), "nodes")
    paths.append(path)
    facts = settled.unionByName(alone).groupBy(F.col("at").alias("depth"), F.col("head").alias("conv_id")).agg(*[F.first(c).alias(c) for c in ("parent", "own", "path")])
    heads = nodes.filter("head").join(facts, ["depth", "conv_id"]).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("own")).alias("saved_tokens"), "ends", "path",
    )
    heads, path = write_table(heads, "heads")
    paths.append(path)
    found = nodes.filter("not head").drop("head").unionByName(heads.drop("path")).unionByName(_top_nodes(tops, heads))
    found, _ = write_table(found.withColumn("ends_sha256", F.lower(F.hex(F.coalesce("ends", F.unhex(F.sha2(F.lit(""), 256)))))).drop("ends"), "trie")
    for path in paths:
        drop_table(spark, path)
    return found


def _chains(alone: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of containers that hold one class, longer than a container may be: a chain, from running sums instead of a sweep."""
    rows = alone.select("rep", "weight", "n", "at", "ends").join(turns.withColumnRenamed("conv_id", "rep"), "rep").filter(F.col("depth") > F.col("at"))
    zero = F.lit(0).cast("bigint")
    head = alone.select("rep", "weight", "n", "at", "ends", F.col("at").alias("depth"), zero.alias("bytes"))
    rows = rows.select("rep", "weight", "n", "at", "ends", "depth", "bytes").unionByName(head)
    below = Window.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    last, first = F.col("depth") == F.col("n"), F.col("depth") == F.col("at")
    return rows.select(
        F.col("rep").alias("conv_id"), "depth", F.when(~first, F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("weight") - 1) * F.sum("bytes").over(below)).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"), first.alias("head"),
    )


def _top_nodes(tops: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads that burst. Their subtrees' sums come from the containers and the other tops beneath, along the paths."""
    zero = F.lit(0).cast("bigint")
    own = (F.col("n_convs") - 1) * F.col("own")
    given = heads.select("path", "n_leaves", "saved_tokens").unionByName(
        tops.select(F.concat("path", F.array("conv_id")).alias("path"), zero.alias("n_leaves"), own.alias("saved_tokens"))
    )
    sums = given.select(F.posexplode("path").alias("depth", "conv_id"), "n_leaves", "saved_tokens").groupBy(F.col("depth").cast("bigint").alias("depth"), "conv_id").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    above = heads.select("depth", "parent_conv_id").unionByName(tops.filter("parent is not null").select(F.col("at").alias("depth"), F.col("parent").alias("parent_conv_id")))
    children = above.filter("parent_conv_id is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"))
    return tops.withColumnRenamed("at", "depth").join(sums, ["depth", "conv_id"]).join(children, ["depth", "conv_id"]).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"
    )


def rebuilt(turns: DataFrame, span: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, out of ``conv_id, depth, turn_key, bytes``: their turns and the table of their ids.

    Conversation ``c`` takes the first ``h = crc32(c) % most`` turns of conversation ``c - c % span``, if there is one, then its own
    after its first ``h``.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    base, h = F.col("conv_id") - F.col("conv_id") % span, F.crc32(F.col("conv_id").cast("string")) % most
    convs = lengths.select("conv_id", base.alias("base"), h.alias("h"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    begin = turns.filter((F.col("depth") < most) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "base")
    head = convs.join(begin, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "turn_key", "bytes")
    moved = F.col("depth") - F.col("h") + F.least("h", F.coalesce("base_n", F.lit(0)))
    own = turns.join(convs, "conv_id").filter(F.col("depth") > F.col("h")).select("conv_id", moved.alias("depth"), "turn_key", "bytes")
    return head.unionByName(own), convs.select("conv_id")
