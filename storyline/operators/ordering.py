"""Positions in a total order, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.session import materialize


def positions(
    df: DataFrame, groups: list[str], order: list[Column], name: str = "position", key: list[str] | None = None
) -> DataFrame:
    """Add the 1-based position of each row within its group, for groups of any size.

    A range shuffle spreads the rows, a hot group too, because the order columns are part of the range. Each part
    numbers its own rows; only one row per group and part takes part in the running sum that joins them up.
    The order must end in a unique column.

    With ``key``, columns that hold the order and are unique in a group, only groups and key are shuffled by range and written;
    the other columns, texts among them, join their numbers afterwards.
    """
    if key is not None:
        placed = positions(df.select(*groups, *key), groups, order, name)
        return _joined(df, [*groups, *key], placed, [F.col(name)])
    spread = df.repartitionByRange(*[F.col(g) for g in groups], *order).sortWithinPartitions(
        *[F.col(g) for g in groups], *order
    )
    rows = materialize(spread.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    runs = rows.groupBy(*groups, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    # Written, so that its size is known and the rows stay where they are while it is small.
    place = F.col("_before") + F.col("_row") - F.col("_first") + 1
    found = _joined(rows, [*groups, "_part"], materialize(runs, "runs"), [F.col("_first"), F.col("_before")])
    return found.select(*df.columns, place.alias(name))


def _joined(left: DataFrame, keys: list[str], right: DataFrame, columns: list[Column]) -> DataFrame:
    """``left`` with ``columns`` of ``right``. Keys may be null, so they are compared null-safely; this is still an equi-join."""
    right = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *columns)
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return left.join(right, match).drop(*[f"_key{i}" for i in range(len(keys))])


def first_rows(
    df: DataFrame, groups: list[str], order: list[Column], limit: int, name: str = "rank", salts: int = 32
) -> DataFrame:
    """The first ``limit`` rows of each group, with their rank.

    Each task and each of ``salts`` slices of a group keeps at most ``limit`` rows before the last step, so a hot
    group ends in ``salts * limit`` rows at most.
    """
    slices = Window.partitionBy(*groups, "_salt").orderBy(*order)
    whole = Window.partitionBy(*groups).orderBy(*order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in _plain(df)]), F.lit(salts)))
    kept = salted.withColumn("_n", F.row_number().over(slices)).filter(F.col("_n") <= limit).drop("_salt", "_n")
    return kept.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= limit)


def _plain(df: DataFrame) -> list[str]:
    """Short columns a salt can be made from."""
    small = {"bigint", "int", "date", "timestamp", "double", "timestamp_ntz"}
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() in small]
    return names or df.columns


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key in each task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
