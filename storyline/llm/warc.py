"""WARC archives and their fixity audit with Merkle trees.

Pages become WARC records at offsets of archive files. A replica is audited by hashing records, then ordered ranges of
offsets, then files, then groups of files, up to one root. Two replicas are compared from the root down: only the children
of nodes whose hashes differ are looked at, so sound branches cost nothing.

Ranges are aligned to offsets, not to counts, so a missing record spoils its own branch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.session import materialize

#: Bytes of records that one archive file aims at, and of the smallest range.
FILE_BYTES = 1 << 25
RANGE_BITS = 16
#: Each level above joins 16 nodes; a file's offsets need at most this many levels.
FAN_BITS = 4
OFFSET_LEVELS = 5


def record_bytes(url: Column, page: Column, body: Column) -> Column:
    """A WARC resource record; null url and body are empty."""
    content = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), content, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES, keep: tuple[Column, ...] = (), records: bool = False) -> DataFrame:
    """Where the records of ``pages`` (``page_id, url, html``) lie: ``page_id, file, offset, length, sha256``.

    Rows are dealt to files by a hash, so that files have about ``file_bytes`` whatever the table's size, and no page id, url or
    repeated row makes a file large; within a file they follow by id, then hash. Only these short columns are shuffled and
    written, with the columns in ``keep`` and, if ``records``, the record's bytes. Null columns are empty text; repeated rows
    are records of their own. One record may exceed the file size.
    """
    record = record_bytes(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select(
        "page_id",
        F.octet_length(record).cast("bigint").alias("length"),
        F.sha2(record, 256).alias("sha256"),
        F.xxhash64(F.monotonically_increasing_id(), F.col("page_id")).alias("hash"),
        *([record.alias("record")] if records else []),
        *keep,
    )
    rows = materialize(rows, "records")
    total = rows.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    order = Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("file", F.pmod("hash", F.lit(files)))
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).drop("hash")


def merkle(records: DataFrame) -> DataFrame:
    """The tree over ``file, offset, sha256``: ``level, file, node, hash``.

    Level 0 has a row per record (``node`` is its offset); levels 1 to ``OFFSET_LEVELS`` ranges of offsets, 16 times as wide each;
    the next the files; those above groups of 16 files up to the root. A node hashes the ordered list of its children's places
    and hashes: at most 16, or at level 1 the records that begin in ``2 ** RANGE_BITS`` bytes, so no task gathers more.
    """
    level = records.select("file", F.col("offset").alias("node"), F.col("sha256").alias("hash"))
    levels = [level.withColumn("level", F.lit(0))]
    for height in range(1, OFFSET_LEVELS + 1):
        bits = RANGE_BITS if height == 1 else FAN_BITS
        level = _raise(level, [F.col("file"), F.shiftright("node", bits).alias("node")])
        levels.append(level.withColumn("level", F.lit(height)))
    level = _raise(level, [F.col("file"), F.lit(0).cast("bigint").alias("node")])
    height = OFFSET_LEVELS + 1
    levels.append(level.withColumn("level", F.lit(height)))
    widest = level.agg(F.max("file")).first()[0] or 0
    while widest > 0:
        widest >>= FAN_BITS
        height += 1
        level = _raise(level, [F.shiftright("file", FAN_BITS).alias("file"), F.lit(0).cast("bigint").alias("node")])
        levels.append(level.withColumn("level", F.lit(height)))
    tree = levels[0]
    for other in levels[1:]:
        tree = tree.unionByName(other)
    return materialize(tree, "merkle")


def _raise(level: DataFrame, parent: list[Column]) -> DataFrame:
    """The level above: each parent's hash over its children in order."""
    rows = level.select(F.struct(F.col("file").alias("f"), F.col("node").alias("n"), F.col("hash").alias("h")).alias("child"), *parent)
    above = rows.groupBy("file", "node").agg(F.sort_array(F.collect_list("child")).alias("below"))
    line = F.transform("below", lambda c: F.concat_ws(":", c["f"].cast("string"), c["n"].cast("string"), c["h"]))
    return above.select("file", "node", F.sha2(F.concat_ws("|", F.lit("node"), F.concat_ws("|", line)), 256).alias("hash"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two trees of ``merkle``: ``file, offset, status`` (``corrupt``, ``missing`` or ``extra``).

    Starts at the roots and descends level by level; the join of a level is limited to children of differing nodes. Equal
    replicas end after one comparison of roots. Trees of different height are compared from the higher root.
    """
    top = max(primary.agg(F.max("level")).first()[0] or 0, replica.agg(F.max("level")).first()[0] or 0)
    differing: DataFrame | None = None
    for height in range(top, -1, -1):
        pair = []
        for name, tree in (("a", primary), ("b", replica)):
            level = tree.filter(F.col("level") == height).select("file", "node", F.col("hash").alias(name))
            if differing is not None:
                level = level.join(differing, _parents(height, level, differing), "left_semi")
            pair.append(level)
        found = pair[0].join(pair[1], ["file", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
        found = materialize(found, "differing")
        if found.isEmpty():
            return found.select("file", F.col("node").alias("offset"), F.lit("").alias("status"))
        differing = found.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return found.select("file", F.col("node").alias("offset"), status.alias("status"))


def _parents(height: int, level: DataFrame, differing: DataFrame) -> Column:
    """How a node of this level finds its parent."""
    if height > OFFSET_LEVELS:
        return (F.shiftright(level["file"], FAN_BITS) == differing["up_file"]) & (differing["up_node"] == 0)
    if height == OFFSET_LEVELS:
        return (level["file"] == differing["up_file"]) & (differing["up_node"] == 0)
    bits = RANGE_BITS if height == 0 else FAN_BITS
    return (level["file"] == differing["up_file"]) & (F.shiftright(level["node"], bits) == differing["up_node"])
