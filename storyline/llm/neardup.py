"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells, one vector kept per group.

Exact: a pair is compared wherever it may be. A vector belongs to the cell of its nearest centre and also visits each cell that
may hold a partner: the partner lies on the other side of the plane between two centres, and a vector farther from
that plane than the largest angle allows can have no partner there. Equal vectors are folded into one beforehand, and
cells are cut into tiles, so a hot cell is many bounded groups. Each pair of tiles is one group, to which only vectors that visit the
other one's cell are sent, so a vector travels once per tile it has to meet: a few times, as cells are few and tiles as large as a
task holds. Pairs are counted and joined up in the task; none is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import least_linked, stream_groups
from storyline.operators.components import connected_components, least_reached
from storyline.session import materialize

COSINE = 0.93
#: Vectors that one cell aims at, at least, and cells of one label at most: without structure a vector is sent to each of them.
CELL_ROWS = 2000
MOST_CELLS = 8
#: Centres of all labels that are fitted and sent out together; more labels take more passes.
CELLS_PER_PASS = 2048
#: Vectors per cell that the centres are fitted on.
FIT_PER_CELL = 32
FIT_ROUNDS = 8
#: Bytes of vectors in a tile, and products of two tiles that a task holds at once (8 MB).
TILE_BYTES = 1 << 24
PRODUCTS = 1 << 20
#: Tiles of a cell that can be numbered.
MOST_TILES = 1 << 32
#: Room for rounding of products of unit vectors.
SLACK = 1e-9


def centres_of(vectors: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows: ``cells`` unit centres at most. The rows' order decides the start."""
    centres = np.unique(vectors[: 4 * cells], axis=0)
    centres = centres[np.random.default_rng(3).permutation(len(centres))[:cells]]
    for _ in range(rounds):
        home = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def visited(vectors: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and which cells (matrix) may hold a partner of it, its home included."""
    near = vectors @ centres.T
    home = near.argmax(axis=1)
    gap = near[np.arange(len(near)), home][:, None] - near
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
    # A unit vector's distance from the plane between two centres is gap / apart; a partner on the other side is at an
    # angle of at least its arc sine.
    reach = np.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else np.inf
    return home, gap <= reach * apart + SLACK


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Groups of ``vec_id, embedding, label``: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least ``cosine``. Null and
    zero vectors, and those with a null or non-finite component, link with nothing; vectors of different lengths don't either.
    ``component_id`` is the least id reachable (an unlinked vector's own; null ids only among themselves). Repeated rows are
    vectors of their own.

    Distinct vectors, not rows, are compared. The driver holds at most ``CELLS_PER_PASS`` centres at a time, fitted on about
    ``FIT_PER_CELL`` vectors a cell. All vectors are then assigned and compared.
    """
    value = F.transform("embedding", lambda x: x.cast("double"))
    # Single floats stay so on their way: half the bytes, the same doubles in the task.
    kept = F.col("embedding") if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else value
    usable = F.col("label").isNotNull() & F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = embeddings.select(
        "vec_id", "label", F.when(usable, kept).alias("vec"), F.monotonically_increasing_id().alias("number")
    )
    # The two hashes and the length stand for the vector; a class is all rows with the same ones and the same label.
    keys = ["label", "size", "key", "twin"]
    rows = materialize(
        rows.withColumns({"size": F.size("vec"), "key": F.xxhash64("vec"), "twin": F.xxhash64(F.reverse("vec"), F.lit(1))}), "vectors"
    )
    linkable = rows.filter(F.col("vec").isNotNull())
    classes = linkable.groupBy(*keys).agg(F.count("*").alias("copies"), F.min("number").alias("id"))
    classes = materialize(classes, "classes")
    distinct = linkable.join(classes.select(F.col("id").alias("number"), "copies"), "number").select(
        F.col("number").alias("id"), "copies", "label", "size", "vec"
    )
    cells = _cells(distinct, cell_rows, cosine)
    compared = _compare(cells, cosine)
    links = compared.groupBy("id").agg(F.sum("links").alias("near"))
    edges = compared.filter(F.col("target") != F.col("id")).select(F.col("id").alias("a"), F.col("target").alias("b"))
    groups = connected_components(classes.select("id"), edges, [])
    classes = classes.join(groups, "id").join(links, "id", "left")
    named = materialize(
        rows.join(classes.select(*keys, F.col("cluster_id").alias("class"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")), keys, "left")
        .select("vec_id", "n_links", "class"),
        "named",
    )
    least = materialize(named.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("least")), "least")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return named.join(least, "class", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _cells(distinct: DataFrame, cell_rows: int, cosine: float) -> DataFrame:
    """Each distinct vector with its cell and those it visits: ``label, size, cell, visits, id, copies, vec``."""
    sizes = distinct.groupBy("label", "size").agg(F.count("*").alias("rows"))
    made = []
    columns = ["label", "size", "cell", "visits", "id", "copies", "vec"]
    none = distinct.withColumns({"cell": F.lit(0), "visits": F.array(F.lit(0))}).select(*columns)
    small = none.join(sizes.filter(F.col("rows") <= cell_rows).select("label", "size"), ["label", "size"], "left_semi")

    def by_kind(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        """Assign the vectors of each label and length in a batch."""
        for batch in batches:
            kinds = np.array([f"{n}|{z}" for n, z in zip(batch["label"].to_pylist(), batch["size"].to_pylist())])
            for kind in np.unique(kinds):
                part = batch.filter(pa.array(kinds == kind))
                yield assign(part, shared.value[(str(part["label"][0].as_py()), part["size"][0].as_py())])

    def assign(batch: pa.RecordBatch, centres: np.ndarray) -> pa.RecordBatch:
        home, visits = visited(unit(batch["vec"]), centres, cosine)
        visits[np.arange(len(home)), home] = True
        ends = np.r_[0, np.cumsum(visits.sum(axis=1))]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(visits)[1].astype(np.int32)))
        cells = [pa.array(home.astype(np.int32)), listed]
        return pa.RecordBatch.from_arrays([batch["label"], batch["size"], *cells, batch["id"], batch["copies"], batch["vec"]], columns)

    for group in _passes(sizes.filter(F.col("rows") > cell_rows), cell_rows):
        wanted = distinct.sparkSession.createDataFrame([(str(n), z, c, r) for n, z, c, r in group], "name string, size int, cells int, rows bigint")
        part = distinct.join(F.broadcast(wanted.withColumnRenamed("size", "_size")), (F.col("label").cast("string") == F.col("name")) & (F.col("size") == F.col("_size")))
        share = F.col("cells") * FIT_PER_CELL / F.col("rows")
        sample = part.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("name", "size", "id", "vec").limit(4 * CELLS_PER_PASS * FIT_PER_CELL)
        rows: dict[tuple, list] = {}
        for r in sample.collect():
            rows.setdefault((r["name"], r["size"]), []).append((r["id"], r["vec"]))
        centres = {}
        for n, z, c, _ in group:
            found = [v for _, v in sorted(rows.get((str(n), z), []))]
            centres[(str(n), z)] = centres_of(unit(pa.array(found)), c) if found else np.zeros((1, z))
        shared = distinct.sparkSession.sparkContext.broadcast(centres)
        made.append(part.select(distinct.columns).mapInArrow(lambda batches, shared=shared: by_kind(batches, shared), none.schema))
    every = small
    for other in made:
        every = every.unionByName(other)
    return materialize(every, "cells")


def _passes(sizes: DataFrame, cell_rows: int) -> Iterator[list[tuple]]:
    """Large labels with their numbers of cells, as many at a time as their centres stay within ``CELLS_PER_PASS``."""
    group: list[tuple] = []
    for r in sizes.toLocalIterator():
        cells = min(MOST_CELLS, -(-r["rows"] // cell_rows))
        if group and sum(g[2] for g in group) + cells > CELLS_PER_PASS:
            yield group
            group = []
        group.append((r["label"], r["size"], cells, r["rows"]))
    if group:
        yield group


def unit(column: pa.Array) -> np.ndarray:
    """Rows of doubles, scaled by their largest component first so that no square overflows or vanishes."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _compare(cells: DataFrame, cosine: float) -> DataFrame:
    """Per vector and tile pair: copies linked with it, and the least vector its links reach: ``id, links, target``."""
    keys = ["label", "size"]
    # A tile holds doubles in the task.
    number = F.ceil(F.count("*") * 8 * F.greatest("size", F.lit(1)) / TILE_BYTES)
    tiles = cells.groupBy(*keys, "cell").agg(number.alias("tiles"))
    tiles = tiles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "tiles"))).alias("tiles"))
    tiled = cells.join(materialize(tiles, "tiles"), keys)
    code = lambda cell, tile: cell.cast("bigint") * MOST_TILES + tile
    of = lambda cell: F.coalesce(F.try_element_at("tiles", cell), F.lit(0))
    # A cell that is visited may be nobody's home.
    there = F.filter("visits", lambda cell: of(cell) > 0)
    met = F.flatten(F.transform(there, lambda cell: F.transform(F.sequence(F.lit(0).cast("bigint"), of(cell) - 1), lambda tile: code(cell, tile))))
    tiled = tiled.withColumn("tile", code(F.col("cell"), F.pmod(F.xxhash64("id"), of(F.col("cell"))))).withColumn("_other", F.explode(met))
    tiled = tiled.withColumns({"p": F.least("tile", "_other"), "q": F.greatest("tile", "_other")})
    # One number per group: label, vector length and pair of tiles.
    tiled = tiled.withColumn("block", F.xxhash64(*keys, "p", "q")).select("block", "size", "p", "q", "tile", "id", "copies", "vec")

    def compare(found: pa.Table) -> pa.Table | None:
        tile, q = found["tile"].to_numpy(), found["q"][0].as_py()
        right = np.flatnonzero(tile == q)
        left = right if found["p"][0].as_py() == q else np.flatnonzero(tile != q)
        if not len(left) or not len(right):
            return None
        ids, copies, vectors = found["id"].to_numpy(), found["copies"].to_numpy(), unit(found["vec"].combine_chunks())
        counts, ends, others = np.zeros(len(ids), np.int64), [], vectors[right].T
        step = max(1, PRODUCTS // len(right))
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            near = vectors[rows] @ others >= cosine
            near &= ids[rows][:, None] != ids[right][None, :]
            if not near.any():
                continue
            counts[rows] += near @ copies[right]
            if left is not right:
                counts[right] += near.T @ copies[rows]
            low_left, low_right = least_linked(near, ids[rows], ids[right])
            for own, low in ((ids[rows], low_left), (ids[right], low_right)):
                moved = low != own
                ends.append((own[moved], low[moved]))
        if not ends:
            return None
        target = ids.copy()
        linked, least = least_reached(*(np.concatenate(x) for x in zip(*ends)))
        order = np.argsort(ids)
        target[order[np.searchsorted(ids[order], linked)]] = least
        hit = (counts > 0) | (target != ids)
        return pa.table({"id": ids[hit], "links": counts[hit], "target": target[hit]})

    dealt = tiled.repartition("block").sortWithinPartitions("block", "size", "p", "q")
    schema = "id bigint, links bigint, target bigint"
    compared = dealt.mapInArrow(lambda batches: stream_groups(batches, ["block", "size", "p", "q"], compare), schema)
    return materialize(compared, "compared")
