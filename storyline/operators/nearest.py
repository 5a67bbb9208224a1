"""Exact nearest partner by cosine distance, spread over tiles.

A block (one issue) is cut into tiles of bounded size, around pivots and within them by the hash of the row id. Each pair of
tiles is one Spark group: a task multiplies two bounded matrices and returns at most one candidate per row, and a partial ``min``
keeps the best. Pairs of tiles that are too far apart for the threshold are left out by the triangle inequality of angles;
all other distances are looked at, so the answer is exact, yet pairs are never emitted: a block of n rows in k tiles moves at
most n * k rows, however large or skewed the block is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.functions.vectors import DISTANCE_DIGITS, TINY, sum_of_squares
from storyline.session import materialize

#: Largest number of rows in a tile: two tiles of vectors with 1,024 doubles are 256 MB in a task. Larger tiles mean
#: fewer copies of each row; blocks of less than 16 such tiles use smaller ones, so that they still fill many tasks.
TILE_ROWS = 16384
SPREAD = 16

#: Rows per tile when the near pairs themselves are the answer: all pairs of two tiles are then at most 100 MB.
PAIR_TILE_ROWS = 2048

#: Directions that tiles are gathered around, at most, and parts of a cell that can be numbered.
PIVOTS = 64
MOST_PARTS = 1 << 32
#: What angles and distances may be off by.
SLACK = 1e-6

#: Cells of a distance matrix a task holds at once; a few such blocks of 16 MB are alive at a time.
MATRIX_CELLS = 1 << 21

#: Bytes of vectors in a tile that has grown with its block, at most.
TILE_BYTES = 1 << 26


def fitting_rows(nodes: DataFrame, keys: list[str], tile_rows: int) -> int:
    """Rows per tile so that the largest block has ``SPREAD`` tiles, at least ``tile_rows`` and at most what ``TILE_BYTES`` hold.

    Each row is sent to every tile of its block, so with tiles of a fixed size what is sent would grow with the square of the block.
    """
    found = nodes.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("dimensions")).agg(F.max("rows"), F.max("dimensions")).first()
    if not found[0]:
        return tile_rows
    return max(tile_rows, min(-(-found[0] // SPREAD), TILE_BYTES // (8 * max(1, found[1]))))


def issue_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per block, written so that its size is known: joining it then moves no vectors unless it is very large."""
    return materialize(df.groupBy(*keys).agg(F.count("*").alias("rows")), "sizes")


def beside_sizes(df: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """The rows of the blocks in ``sizes``, one row per block, beside its columns.

    Those of a single block are literals: a broadcast is built on the driver in a table of 16 MB, even for one row, and rounds would do so each time.
    """
    few = sizes.limit(2).collect()
    if len(few) != 1:
        return df.join(sizes, keys)
    same = [F.col(key) == F.lit(few[0][key]).cast(sizes.schema[key].dataType) for key in keys]
    values = {c: F.lit(few[0][c]).cast(sizes.schema[c].dataType) for c in sizes.columns if c not in keys}
    return reduce(DataFrame.filter, same, df).withColumns(values)


def with_tiles(
    df: DataFrame, keys: list[str], tile_rows: int, tiles: str, tile: str, sizes: DataFrame | None = None, spread: int = SPREAD
) -> DataFrame:
    """Add the number of tiles of the row's block and the row's own tile."""
    rows = F.col("rows")
    number = F.greatest(F.ceil(rows / tile_rows), F.least(F.lit(spread).cast("bigint"), F.ceil(rows * 4 / tile_rows)))
    sizes = issue_sizes(df, keys) if sizes is None else sizes
    return beside_sizes(df, keys, sizes.select(*keys, number.alias(tiles))).withColumn(
        tile, F.pmod(F.xxhash64("id"), F.col(tiles))
    )


def matrix(table: pa.Table, column: str) -> np.ndarray:
    chunks = [c for c in table[column].chunks if len(c)]
    return np.vstack([np.reshape(c.flatten().to_numpy(zero_copy_only=False), (len(c), -1)) for c in chunks])


def narrow_and_matrix(batches: Iterator[pa.RecordBatch], column: str, by: str) -> tuple[pa.Table, np.ndarray]:
    """The rows in order of ``by``, without the vectors, and the vectors as one matrix. Batches are let go one by one, so vectors are held about once."""
    parts, narrow = [], []
    for batch in batches:
        vectors = batch[column]
        parts.append(np.array(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(vectors), -1))
        narrow.append(batch.drop_columns([column]))
        del batch, vectors
    table = pa.Table.from_batches(narrow)
    order = np.argsort(table[by].to_numpy(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    made = np.empty((len(order), max((p.shape[1] for p in parts), default=0)), parts[0].dtype if parts else float)
    parts.reverse()
    at = 0
    while parts:
        part = parts.pop()
        made[place[at : at + len(part)]] = part
        at += len(part)
    return table.take(pa.array(order)), made


def tie_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order among equally near pairs that is the same from both ends and spread out, so that many merge at once."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(1)).astype(np.int64)


def nearest_cells(least: np.ndarray, distance: np.ndarray, row_ids: np.ndarray, other_ids: np.ndarray):
    """The chosen cell of each row: row, column, rounded distance, tie. ``least`` is the smallest value per row.

    Only cells that may round to the least value are rounded and compared, not the whole matrix.
    """
    close = distance <= (least + 2 * 10.0**-DISTANCE_DIGITS)[:, None]
    r, c = np.nonzero(close & np.isfinite(least)[:, None])
    rounded, tie = np.round(distance[r, c], DISTANCE_DIGITS), tie_order(row_ids[r], other_ids[c])
    order = np.lexsort((other_ids[c], tie, rounded, r))
    first = order[np.unique(r[order], return_index=True)[1]]
    return r[first], c[first], rounded[first], tie[first]


def first_choices(own: np.ndarray, partner: np.ndarray, near: np.ndarray, tie: np.ndarray):
    """The best of the candidates of each ``own``, so that a task returns one per row however many blocks it went through."""
    order = np.lexsort((partner, tie, near, own))
    best = order[np.unique(own[order], return_index=True)[1]]
    return own[best], partner[best], near[best], tie[best]


class Best:
    """The best candidate of each row so far, whatever the number of blocks that offer one: what a task holds doesn't grow with them."""

    def __init__(self, rows: int):
        self.near, self.tie, self.partner = np.full(rows, np.inf), np.zeros(rows, np.int64), np.full(rows, -1)
        self.name = np.zeros(rows, np.int64)

    def offer(self, row: np.ndarray, partner: np.ndarray, name: np.ndarray, near: np.ndarray, tie: np.ndarray) -> None:
        """Candidates for distinct rows. Of equally near ones the least tie, then the least ``name`` (the partner's id) is kept."""
        held, tied = self.near[row], self.tie[row]
        better = (near < held) | ((near == held) & ((tie < tied) | ((tie == tied) & (name < self.name[row]))))
        row = row[better]
        self.near[row], self.tie[row], self.partner[row], self.name[row] = near[better], tie[better], partner[better], name[better]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, partner's place and id, distance, tie of each row that has a candidate."""
        row = np.flatnonzero(np.isfinite(self.near))
        return row, self.partner[row], self.name[row], self.near[row], self.tie[row]


def _best_in(rows: np.ndarray, row_ids: np.ndarray, row_own: np.ndarray, others: np.ndarray, other_ids: np.ndarray):
    """For each row the nearest of ``others`` that is not ``row_own``: positions, partner ids, distances, ties."""
    none = np.array([], np.int64)
    if not len(rows) or not len(others):
        return [none, none, none, none]
    step = max(1, MATRIX_CELLS // len(others))
    found = []
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        likeness = rows[part] @ others.T
        likeness[row_own[part][:, None] == other_ids[None, :]] = -np.inf
        r, c, distance, tie = nearest_cells(1.0 - likeness.max(axis=1), 1.0 - likeness, row_ids[part], other_ids)
        found.append((r + start, other_ids[c], distance, tie))
    return [np.concatenate(column) for column in zip(*found)]


def _result(source: pa.Table, keys: list[str], at: np.ndarray, ids: np.ndarray, found) -> pa.Table:
    columns = {key: source[key].take(pa.array(at)) for key in keys}
    columns["id"] = pa.array(ids, pa.int64())
    columns["partner"] = pa.array(found[1], pa.int64())
    columns["distance"] = pa.array(found[2], pa.float64())
    columns["tie"] = pa.array(found[3], pa.int64())
    return pa.table(columns)


def keep_best(candidates: DataFrame, keys: list[str], below: float | None) -> DataFrame:
    if below is not None:
        candidates = candidates.filter(F.col("distance") < below)
    return (
        candidates.groupBy(*keys, "id")
        .agg(F.min(F.struct("distance", "tie", "partner")).alias("best"))
        .select(*keys, "id", "best.partner", "best.distance", "best.tie")
    )


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = ", ".join(f"`{key}` {df.schema[key].dataType.simpleString()}" for key in keys)
    return types + ", id bigint, partner bigint, distance double, tie bigint"


def tile_pairs(tiled: DataFrame) -> DataFrame:
    """Send each row to every unordered pair of tiles that holds its own tile."""
    pair = lambda k: F.struct(F.least(k, "tile").alias("p"), F.greatest(k, "tile").alias("q"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)
    return tiled.withColumn("pair", F.explode(F.transform(every, pair))).withColumn(
        "p", F.col("pair.p")
    ).withColumn("q", F.col("pair.q")).drop("pair", "tiles")


def choose_pivots(nodes: DataFrame, tile_rows: int = TILE_ROWS) -> np.ndarray:
    """Directions to gather tiles around: at most ``PIVOTS`` unit vectors of rows taken by hash, none if one tile would do."""
    wanted = min(PIVOTS, nodes.count() // max(1, tile_rows))
    if wanted < 2:
        return np.zeros((0, 0))
    rows = nodes.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    found = np.array([r["vec"] for r in rows])
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), TINY)


def with_cells(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the pivot nearest to each row, the angle between the two, and the length of the vector. Rows stay where they are."""
    kept = [c for c in nodes.columns if c not in ("cell", "angle", "norm")]
    plain = nodes.select(*kept)
    if not len(pivots):
        length = F.sqrt(sum_of_squares(F.col("vec")))
        return plain.withColumns({"cell": F.lit(0).cast("bigint"), "angle": F.lit(float(np.pi)), "norm": length})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(pa.table({"vec": batch["vec"]}), "vec")
            norm = np.linalg.norm(vectors, axis=1)
            likeness = (vectors / np.maximum(norm, TINY)[:, None]) @ pivots.T
            cell = likeness.argmax(axis=1)
            angle = np.arccos(np.clip(likeness[np.arange(len(cell)), cell], -1, 1))
            columns = [batch[c] for c in kept] + [pa.array(cell.astype(np.int64)), pa.array(angle), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "cell", "angle", "norm"])

    schema = plain.withColumns({"cell": F.lit(0).cast("bigint"), "angle": F.lit(0.0), "norm": F.lit(0.0)}).schema
    return plain.mapInArrow(run, schema)


def near_tiles(
    nodes: DataFrame, keys: list[str], below: float | None, pivots: np.ndarray, tile_rows: int, sizes: DataFrame | None = None
) -> DataFrame:
    """Send each row of ``nodes`` (with cells, and ``fresh``) to the pairs of tiles ``p, q`` that its own tile has to meet.

    A tile is a part of a cell. Two vectors of cells whose pivots are ``t`` apart are at least ``t`` less their own angles to the
    pivots apart, by the triangle inequality; so the largest angle and length in each cell bound every distance between
    two cells, and pairs of cells that can't come below ``below`` are left out. So are pairs without a fresh row.
    """
    if not len(pivots):
        return tile_pairs(with_tiles(nodes.drop("cell", "angle", "norm"), keys, tile_rows, "tiles", "tile", sizes))
    spark = nodes.sparkSession
    cells = nodes.groupBy(*keys, "cell").agg(
        F.count("*").alias("rows"), F.max("angle").alias("wide"), F.max("norm").alias("long"), F.count_if("fresh").alias("renewed")
    )
    # One row per block and cell, written so that joins know its size.
    tiles = F.greatest(F.lit(1), F.round(F.col("rows") / tile_rows)).cast("bigint")
    cells = materialize(cells.withColumn("tiles", tiles), "cells")
    far = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    apart = spark.createDataFrame([(i, j, float(far[i, j])) for i in range(len(far)) for j in range(len(far))], "cell bigint, other bigint, apart double")
    other = cells.select(*keys, F.col("cell").alias("other"), F.col("tiles").alias("other_tiles"), F.col("wide").alias("other_wide"), F.col("long").alias("other_long"), F.col("renewed").alias("other_renewed"))
    pairs = cells.join(other, keys).join(apart, ["cell", "other"]).filter("renewed + other_renewed > 0")
    if below is not None:
        gap = F.greatest(F.lit(0.0), F.col("apart") - F.col("wide") - F.col("other_wide") - SLACK)
        nearest = 1 - F.col("long") * F.col("other_long") * F.greatest(F.lit(0.0), F.cos(gap))
        pairs = pairs.filter((nearest < below + SLACK) | (F.col("cell") == F.col("other")))
    reach = pairs.groupBy(*keys, "cell").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("other", "other_tiles")).alias("reach"))
    reach = materialize(reach, "reach")
    number = lambda cell, part: cell * MOST_PARTS + part
    every = F.flatten(F.transform("reach", lambda r: F.transform(F.sequence(F.lit(0).cast("bigint"), r["other_tiles"] - 1), lambda t: number(r["other"], t))))
    placed = nodes.join(reach, [*keys, "cell"]).withColumn("tile", number(F.col("cell"), F.pmod(F.xxhash64("id"), F.col("tiles"))))
    spread = placed.withColumn("_other", F.explode(every)).withColumns({"p": F.least("tile", "_other"), "q": F.greatest("tile", "_other")})
    return spread.drop("_other", "reach", "tiles", "cell", "angle", "norm")


def pair_blocks(vectors: np.ndarray, tile: np.ndarray, p: int, q: int, fresh: np.ndarray):
    """Blocks ``(rows, columns, distances)`` that hold each pair of rows of a pair of tiles once, if one of the two is fresh.

    Each distance is computed once, so both ends of a pair see the same number. What isn't a pair is infinite.
    """
    right = np.flatnonzero(tile == q)
    left = right if p == q else np.flatnonzero(tile != q)
    new, old = left[fresh[left]], left[~fresh[left]]
    jobs = [(new, right[~fresh[right]]), (new, new)] if p == q else [(new, right), (old, right[fresh[right]])]
    for rows, columns in jobs:
        inner = p == q and rows is columns
        if not len(rows) or not len(columns):
            continue
        step = max(1, MATRIX_CELLS // len(columns))
        # Rows that lie side by side, as tiles do, are not copied.
        side = columns[-1] - columns[0] + 1 == len(columns)
        ahead = vectors[columns[0] : columns[-1] + 1] if side else vectors[columns]
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            others = columns[start:] if inner else columns
            distance = vectors[part] @ (ahead[start:] if inner else ahead).T
            np.subtract(1.0, distance, out=distance)
            if inner:
                distance[np.tril_indices(len(part), 0, len(others))] = np.inf
            yield part, others, distance


def nearest_within(
    nodes: DataFrame,
    keys: list[str],
    below: float | None = None,
    tile_rows: int = TILE_ROWS,
    pivots: np.ndarray | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """For each node the nearest other node of its block: ``keys, id, partner, distance, tie``.

    ``nodes`` has ``keys, id, vec``; the distance is ``1 - vec . vec``, so mean vectors of groups give their average-linkage
    distance. If it has ``fresh``, only pairs with a fresh node are looked at: a table of partners is renewed by the least of what
    it holds and what is found here. With ``pivots`` it has the columns of :func:`with_cells`.
    """
    pivots = np.zeros((0, 0)) if pivots is None else pivots
    if "fresh" not in nodes.columns:
        nodes = nodes.withColumn("fresh", F.lit(True))
    if "cell" not in nodes.columns:
        nodes = with_cells(nodes, pivots)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vectors = narrow_and_matrix(batches, "vec", "tile")
        ids, tile, fresh = table["id"].to_numpy(), table["tile"].to_numpy(), table["fresh"].to_numpy()
        best = Best(len(ids))
        for rows, columns, distance in pair_blocks(vectors, tile, table["p"][0].as_py(), table["q"][0].as_py(), fresh):
            for own, others, found in ((rows, columns, distance), (columns, rows, distance.T)):
                r, c, near, tie = nearest_cells(found.min(axis=1), found, ids[own], ids[others])
                best.offer(own[r], others[c], ids[others[c]], near, tie)
        row, _, partner, near, tie = best.found()
        own = ids[row]
        yield from _result(table, keys, np.zeros(len(own), np.int64), own, (None, partner, near, tie)).to_batches()

    spread = near_tiles(nodes.select(*keys, "id", "vec", "fresh", "cell", "angle", "norm"), keys, below, pivots, tile_rows, sizes)
    return keep_best(spread.groupBy(*keys, "p", "q").applyInArrow(search, _schema(nodes, keys)), keys, below)


def renew_partners(nodes: DataFrame, keys: list[str], below: float, tile_rows: int, sizes: DataFrame) -> DataFrame:
    """As :func:`nearest_within` when few nodes are fresh: ``keys, id, partner, distance, tie``.

    Only fresh nodes are sent to all tiles, and all nodes to the tiles of fresh ones, which may be a single one. ``nodes`` also has what each
    one holds (``distance, tie``, null if fresh); of a node that is not fresh only a better partner is returned. ``sizes`` has ``keys, rows, renewed``.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows and right.num_rows:
            own_ids, own, ids, others = left["id"].to_numpy(), matrix(left, "vec"), right["id"].to_numpy(), matrix(right, "vec")
            fresh = right["fresh"].to_numpy()
            again = np.flatnonzero(fresh)
            held = np.where(fresh, np.inf, right["distance"].fill_null(np.inf).to_numpy())
            held_tie = right["tie"].fill_null(np.iinfo(np.int64).max).to_numpy()
            mine, theirs = Best(len(own_ids)), Best(len(ids))
            step = max(1, MATRIX_CELLS // len(ids))
            for start in range(0, len(own), step):
                part = slice(start, start + step)
                distance = own[part] @ others.T
                np.subtract(1.0, distance, out=distance)
                # Two fresh nodes meet in two places; each pair is looked at once, so that both ends see the same number.
                distance[:, again] = np.where(ids[again][None, :] > own_ids[part][:, None], distance[:, again], np.inf)
                r, c, near, tie = nearest_cells(distance.min(axis=1), distance, own_ids[part], ids)
                use = near < below
                mine.offer(start + r[use], c[use], ids[c[use]], near[use], tie[use])
                least = distance.min(axis=0)
                better = np.flatnonzero((least < below + SLACK) & (least <= held + 2 * 10.0**-DISTANCE_DIGITS))
                if not len(better):
                    continue
                r, c, near, tie = nearest_cells(least[better], distance[:, better].T, ids[better], own_ids[part])
                row = better[r]
                use = (near < below) & (fresh[row] | (near < held[row]) | ((near == held[row]) & (tie < held_tie[row])))
                theirs.offer(row[use], start + c[use], own_ids[part][c[use]], near[use], tie[use])
            for names, best in ((own_ids, mine), (ids, theirs)):
                row, _, partner, near, tie = best.found()
                made.append((names[row], partner, near, tie))
        none = np.zeros(0, np.int64)
        found, partner, near, tie = first_choices(*(np.concatenate(x) for x in zip(*made))) if made else (none, none, np.zeros(0), none)
        return _result(left, keys, np.zeros(len(found), np.int64), found, (None, partner, near, tie))

    left, right = met_by_fresh(nodes.select(*keys, "id", "vec", "fresh", "distance", "tie"), keys, tile_rows, sizes)
    left = left.select(*keys, "id", "vec", "p", "q")
    matched = left.groupBy(*keys, "p", "q").cogroup(right.groupBy(*keys, "p", "q")).applyInArrow(search, _schema(nodes, keys))
    return keep_best(matched, keys, below)


def met_by_fresh(rows: DataFrame, keys: list[str], tile_rows: int, sizes: DataFrame, by: str = "id") -> tuple[DataFrame, DataFrame]:
    """Fresh rows sent to every tile ``q`` of all rows, and all rows sent to every tile ``p`` of fresh ones; tiles are made by the hash of ``by``.

    ``sizes`` has ``keys, rows, renewed``. Blocks without a fresh row are left out.
    """
    number = F.greatest(F.ceil(F.col("rows") / tile_rows), F.least(F.lit(SPREAD).cast("bigint"), F.ceil(F.col("rows") * 4 / tile_rows)))
    tiles = sizes.filter("renewed > 0").select(*keys, number.alias("_all"), F.ceil(F.col("renewed") / tile_rows).alias("_fresh"))
    placed = beside_sizes(rows, keys, tiles)
    spread = lambda column: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(column) - 1))
    own = lambda column: F.pmod(F.xxhash64(by), F.col(column))
    left = placed.filter("fresh").withColumn("p", own("_fresh")).withColumn("q", spread("_all"))
    right = placed.withColumn("q", own("_all")).withColumn("p", spread("_fresh"))
    kept = [*rows.columns, "p", "q"]
    # Aliases give the right side columns of its own.
    return left.select(*kept), right.select(*[F.col(c).alias(c) for c in kept])


def nearest_other(
    points: DataFrame, groups: DataFrame, keys: list[str], tile_rows: int = TILE_ROWS
) -> DataFrame:
    """For each point the nearest group that is not its own: ``keys, id, partner, distance``.

    ``points`` has ``keys, id, own, vec``; ``groups`` has ``keys, id, vec``.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = np.array([], np.int64)
            return _result(left, keys, none, none, [none] * 4)
        ids = left["id"].to_numpy()
        found = _best_in(matrix(left, "vec"), ids, left["own"].to_numpy(), matrix(right, "vec"), right["id"].to_numpy())
        at = found[0].astype(np.int64)
        return _result(left, keys, at, ids[at], found)

    a = with_tiles(points.select(*keys, "id", "own", "vec"), keys, tile_rows, "left_tiles", "p")
    # Aliases give the right side columns of its own, also when both sides come from one table.
    groups = groups.select(*[F.col(c).alias(c) for c in (*keys, "id", "vec")])
    b = with_tiles(groups, keys, tile_rows, "right_tiles", "q")
    a_tiles = materialize(a.select(*keys, "left_tiles").distinct(), "tiles")
    b_tiles = materialize(b.select(*keys, "right_tiles").distinct(), "tiles")
    span = lambda column: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(column) - 1))
    a = a.join(b_tiles, keys).withColumn("q", span("right_tiles")).select(*keys, "id", "own", "vec", "p", "q")
    b = b.join(a_tiles, keys).withColumn("p", span("left_tiles")).select(*keys, "id", "vec", "p", "q")
    matched = a.groupBy(*keys, "p", "q").cogroup(b.groupBy(*keys, "p", "q")).applyInArrow(search, _schema(points, keys))
    return keep_best(matched, keys, None).drop("tie")


def near_pairs(
    nodes: DataFrame, keys: list[str], below: float, tile_rows: int = PAIR_TILE_ROWS, count: str | None = None, ids: str | None = None
) -> DataFrame:
    """All pairs of nodes nearer than ``below``, smaller id first. Far pairs never leave a task.

    Pairs leave a task block by block, so tiles may grow with the issue. With ``count``, a column of the nodes, both nodes' values come along,
    and so do the lists in ``ids``, which tell nodes apart: then nodes with one id are a pair as well.
    """
    tile_rows = fitting_rows(nodes, keys, tile_rows)
    lists = ids

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, vectors = table["id"].to_numpy(), matrix(table, "vec")
        copies = table[count].to_numpy() if count else None
        listed = table[lists].combine_chunks() if lists else None
        tile, q = table["tile"].to_numpy(), table["q"][0].as_py()
        inner = table["p"][0].as_py() == q
        group = {key: table[key][0] for key in keys}
        del table
        right = np.flatnonzero(tile == q)
        left = right if inner else np.flatnonzero(tile != q)
        others = vectors[right]
        step = max(1, MATRIX_CELLS // max(1, len(right)))
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            # Zero is added, so that no distance is -0.
            distance = np.round(1.0 - vectors[rows] @ others.T, DISTANCE_DIGITS) + 0.0
            near = distance < below
            if inner:
                near &= rows[:, None] < right[None, :] if lists else ids[rows][:, None] < ids[right][None, :]
            r, c = np.nonzero(near)
            one, two = rows[r], right[c]
            turned = ids[one] > ids[two]
            one, two = np.where(turned, two, one), np.where(turned, one, two)
            near = distance[r, c]
            del distance
            for part in _portions(copies[one] + copies[two]) if lists else [slice(None)]:
                a, b = one[part], two[part]
                columns = {key: pa.repeat(value, len(a)) for key, value in group.items()}
                columns["id"], columns["partner"] = pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())
                columns["distance"] = pa.array(near[part], pa.float64())
                if count:
                    columns[count], columns[f"partner_{count}"] = pa.array(copies[a], pa.int64()), pa.array(copies[b], pa.int64())
                if lists:
                    columns[lists], columns[f"partner_{lists}"] = listed.take(pa.array(a)), listed.take(pa.array(b))
                yield pa.RecordBatch.from_pydict(columns)

    kept = [*keys, "id", "vec", *([count] if count else []), *([lists] if lists else [])]
    tiled = tile_pairs(with_tiles(nodes.select(*kept), keys, tile_rows, "tiles", "tile"))
    schema = _schema(nodes, keys).rsplit(",", 1)[0] + (f", {count} bigint, partner_{count} bigint" if count else "")
    schema += f", {lists} array<bigint>, partner_{lists} array<bigint>" if lists else ""
    return tiled.groupBy(*keys, "p", "q").applyInArrow(search, schema)


def _portions(weights: np.ndarray, most: int = MATRIX_CELLS // 4) -> Iterator[slice]:
    """Runs of rows whose weights sum up to ``most`` about, so that what is listed per row stays bounded."""
    if len(weights):
        number = np.cumsum(weights) // most
        cuts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1, len(weights)]
        yield from map(slice, cuts[:-1].tolist(), cuts[1:].tolist())
