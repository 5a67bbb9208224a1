"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Rows with equal texts are a group and go to one shard. A group is a vector (bytes, tokens, rows). Groups of at least
``1 / UNITS`` of some total are placed one by one; all others are pooled by hash into ``UNITS`` units. So at most
``4 * UNITS`` vectors, whatever the size of the table, are placed greedily, largest first, each where the dot
product with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.session import materialize

SHARDS = 8
UNITS = 4096
MEASURES = ("size", "tokens", "rows")


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def tokens_of(text: Column) -> Column:
    """Words separated by spaces or line breaks."""
    return (F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("bigint")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (rows: groups, columns: measures).

    Measures are shares of their totals, capacity is an equal share. Largest vectors go first, each to the shard with the
    highest dot product of the vector with what is left there; ties go to the lower number.
    """
    totals = np.maximum(vectors.sum(axis=0), 1)
    shares = vectors / totals
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    found = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -shares.max(axis=1))):
        found[i] = int(np.argmax(left @ shares[i]))
        left[found[i]] -= shares[i]
    return found


def shard(docs: DataFrame, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """``row`` (all columns but the text), ``size``, ``text_crc32``, ``tokens``, ``shard`` and ``slot`` of each row.

    ``slot`` counts from 0 in each shard without gaps. Null texts are one group of size 1 a row; repeated rows are rows of
    their group; an empty table gives an empty result. A group larger than a shard's equal share in some measure can't stay
    whole in balanced shards: its rows are spread over as many pieces as needed (at most ``2 * units``), by a hash of the row.

    The text is read once, for its size, words and keys; only those short columns are written, shuffled and numbered. The
    driver sees at most ``4 * units`` sums.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = F.col("text")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
        size_of(text).alias("size"),
        F.coalesce(tokens_of(text), F.lit(0)).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("key"),
        F.md5(text).alias("digest"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("key", "digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = materialize(groups, "groups")
    total = groups.agg(*[F.sum(m).alias(m) for m in MEASURES]).first()
    total = {m: max(1, total[m] or 0) for m in MEASURES}
    share = F.greatest(*[F.col(m) / F.lit(total[m]) for m in MEASURES])
    # A sum of shares of three measures is 3, so no more than 3 * units groups are heavy.
    heavy = groups.withColumn("share", share).filter(F.col("share") >= 1.0 / units).collect()
    light = (
        groups.filter(share < 1.0 / units)
        .groupBy(F.pmod("key", F.lit(units)).alias("unit"))
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
        .collect()
    )
    vectors, names = [], []
    for r in heavy:
        # More than one piece only if the group exceeds a shard's share; pieces are then small enough to balance.
        pieces = 1 if r["share"] <= 1.0 / shards else min(2 * units, int(np.ceil(r["share"] * 16 * shards)))
        for piece in range(pieces):
            vectors.append([r[m] / pieces for m in MEASURES])
            names.append((r["key"], r["digest"], piece, pieces))
    for r in light:
        vectors.append([r[m] for m in MEASURES])
        names.append((r["unit"], "", -1, 0))
    chosen = place(np.array(vectors, float).reshape(-1, len(MEASURES)), shards)
    spark = docs.sparkSession
    placed = spark.createDataFrame(
        [(*name, int(s)) for name, s in zip(names, chosen)], "_key bigint, _digest string, _piece int, _pieces int, shard int"
    )
    # Both tables have a bound that doesn't depend on the input, so they are sent to the executors.
    pieces = placed.filter("_piece >= 0").groupBy("_key", "_digest").agg(
        F.max("_pieces").alias("_pieces"), F.sort_array(F.collect_list(F.struct("_piece", "shard"))).alias("_shards")
    )
    pools = placed.filter("_piece < 0").select(F.col("_key").alias("_unit"), F.col("shard").alias("_pool"))
    rows = (
        rows.join(F.broadcast(pieces), (F.col("key") == F.col("_key")) & F.col("digest").eqNullSafe(F.col("_digest")), "left")
        .join(F.broadcast(pools), F.pmod("key", F.lit(units)) == F.col("_unit"), "left")
        .withColumn("_piece", F.pmod(F.xxhash64("number"), F.coalesce("_pieces", F.lit(1))).cast("int"))
        .withColumn("shard", F.coalesce(F.get("_shards", F.col("_piece"))["shard"], F.col("_pool")))
    )
    rows = rows.select("row", "size", "tokens", "text_crc32", "shard", "number", F.shiftright("number", 33).alias("part"))
    return _with_slots(rows)


def _with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard: within each part of the input, then by the parts' counts before it."""
    inside = Window.partitionBy("part", "shard").orderBy("number")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    counts = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = materialize(counts, "counts")
    numbered = rows.withColumn("in_part", F.row_number().over(inside) - 1)
    numbered = numbered.join(counts, ["part", "shard"])
    return numbered.select("row", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("in_part")).cast("bigint").alias("slot"))
