"""Agglomerative clustering on cosine distance, cut at a threshold.

Average and complete linkage are reducible: two groups that are each other's nearest stay so until they merge, so
all mutual pairs of a round merge at once and the result is that of one-by-one greedy merging. For unit vectors
the average distance of two groups is ``1 - mean_a . mean_b``; a group is one row with its size and mean vector,
and no matrix of pairs is kept.

* Issues of at most ``local_limit`` rows are bounded groups: one shuffle brings an issue to one task.
* Larger issues run in rounds over the cluster (``nearest_within`` finds the pairs). Equal vectors are folded into
  one weighted row first. Each round is a table in the shared folder, and once an issue has shrunk to the limit
  it is finished in a task as well.

Both give a *tree*: ``keys, id, path`` where ``path`` lists the groups the row went on to join, with merge
heights. The clusters of every lower threshold can be read from it. A group is named by its least ``id``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions.vectors import DISTANCE_DIGITS, TINY, cosine_distance, l2_normalize, sum_of_squares
from storyline.operators.components import connected_components
from storyline.operators.nearest import (
    MATRIX_CELLS, TILE_ROWS, Best, choose_pivots, first_choices, fitting_rows, issue_sizes, keep_best, matrix, met_by_fresh, near_pairs, near_tiles, nearest_cells,
    nearest_within, pair_blocks, renew_partners, tie_order, tile_pairs, with_cells, with_tiles,
)
from storyline.operators.ordering import positions
from storyline.session import drop_table, materialize, new_path, write_table

#: Rows of an issue that one task takes whole: a 4,096 square of doubles is 128 MB.
LOCAL_LIMIT = 4096

#: Slices that a forest's edges are cut into at a time.
SLICES = 16

#: Copies that stand as one row of a join that lists its articles.
PART_ROWS = 256

LINKAGES = ("average", "complete", "single")
PATH = "array<struct<cluster:bigint,height:double>>"


def check_linkage(linkage: str) -> None:
    if linkage == "ward":
        raise ValueError("ward linkage needs euclidean distances; only cosine is supported")
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage: {linkage}")


def unit_rows(articles: DataFrame, keys: list[str], id_column: str = "seq", vector: str = "embedding") -> DataFrame:
    """``keys, id, vec`` with unit vectors; a zero or missing vector is null, it never merges."""
    plain = articles.select(*keys, F.col(id_column).cast("bigint").alias("id"), l2_normalize(F.col(vector)).alias("vec"))
    usable = F.col("vec").isNotNull() & (F.round(sum_of_squares(F.col("vec")), 6) == 1)
    return plain.withColumn("vec", F.when(usable, F.col("vec")))


def similarity_join(
    articles: DataFrame, keys: list[str], below: float, id_column: str = "seq", vector: str = "embedding", members: DataFrame | None = None
) -> DataFrame:
    """Pairs of articles of an issue nearer than ``below``: ``keys, id, partner, distance, copies, partner_copies``.

    Equal vectors stand as one row with their number, so a group of copies does not become all its pairs; a row with
    ``id = partner`` says that the group has copies. Clustering does not need this table.

    With ``members``, the table of :func:`copy_groups`, rows also hold the articles on both sides, ``ids`` and ``partner_ids`` (null for
    one alone), and if both are the same ones (``within``), for :func:`expand_pairs`. A group of copies then stands as a row per ``PART_ROWS`` of them, so that no list grows with it.
    """
    usable = _joinable(articles, keys, id_column, vector)
    nodes, _ = _fold_copies(usable, keys)
    counted = nodes.select(*keys, "id", "vec", F.col("n").alias("copies"))
    if members is not None:
        counted = _with_members(nodes, members, keys)
    found = near_pairs(counted, keys, below, count="copies", ids="ids" if members is not None else None)
    lists = [] if members is None else ["ids", F.col("ids").alias("partner_ids"), F.lit(True).alias("within")]
    found = found if members is None else found.withColumn("within", F.lit(False))
    same = counted.filter("copies > 1").select(
        *keys, "id", F.col("id").alias("partner"), F.lit(0.0).alias("distance"), "copies", F.col("copies").alias("partner_copies"), *lists
    )
    return found.select(*same.columns).unionByName(same)


def _joinable(articles: DataFrame, keys: list[str], id_column: str, vector: str) -> DataFrame:
    """Rows that can be in a pair: those with an id and a usable vector."""
    return unit_rows(articles, keys, id_column, vector).filter(F.col("vec").isNotNull() & F.col("id").isNotNull())


def _with_members(nodes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with their articles: ``keys, id, vec, copies, ids``, a row per ``PART_ROWS`` articles, written.

    A node is told by its least id and the hash of its vector, as an id may come with several vectors.
    """
    by = [*keys, "node", "vec_hash"]
    named = nodes.withColumnRenamed("id", "node")
    several = named.filter("n > 1").select(*by, F.ceil(F.col("n") / PART_ROWS).alias("_parts"))
    # Articles are dealt to parts in turn, not by their id, which may repeat.
    dealt = members.join(several, by).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")))
    lists = dealt.groupBy(*by, "_part").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.collect_list("id").alias("ids"))
    lists = materialize(lists.drop("_part"), "members")
    alone = named.filter("n = 1").select(*keys, F.col("node").alias("id"), "vec", F.col("n").alias("copies"), F.lit(None).cast("array<bigint>").alias("ids"))
    return materialize(lists.join(named.select(*by, "vec"), by).select(*alone.columns).unionByName(alone), "listed")


def copy_groups(articles: DataFrame, keys: list[str], id_column: str = "seq", vector: str = "embedding") -> DataFrame:
    """The members behind the rows of :func:`similarity_join`: ``keys, id, node, vec_hash``, each article with the id its vector stands under."""
    return _fold_copies(_joinable(articles, keys, id_column, vector), keys)[1]


def expand_pairs(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of articles behind folded pairs, smaller id first: ``keys, id, partner, distance``. As many rows as there are pairs.

    Pairs that hold their articles are expanded where they are; only others join ``members``, which moves them twice.
    """
    if "ids" in pairs.columns:
        left = pairs.select(*keys, "id", "partner", "distance", "partner_ids", "within", F.explode(F.coalesce("ids", F.array("id"))).alias("a"))
        every = left.select(*keys, "id", "partner", "distance", "within", "a", F.explode(F.coalesce("partner_ids", F.array("partner"))).alias("b"))
        every = every.filter(~F.col("within") | (F.col("a") < F.col("b"))).filter("a <> b")
        return every.select(*keys, F.least("a", "b").alias("id"), F.greatest("a", "b").alias("partner"), "distance")
    left = members.select(*keys, F.col("node").alias("id"), F.col("id").alias("a"))
    right = members.select(*keys, F.col("node").alias("partner"), F.col("id").alias("b"))
    every = pairs.select(*keys, "id", "partner", "distance").join(left, [*keys, "id"]).join(right, [*keys, "partner"])
    once = every.filter((F.col("id") != F.col("partner")) | (F.col("a") < F.col("b")))
    return once.select(*keys, F.least("a", "b").alias("id"), F.greatest("a", "b").alias("partner"), "distance")


def _merge_in_task(threshold: float, linkage: str, keys: list[str]):
    """The rounds of one bounded issue: merge all mutual nearest pairs, renew the distances, repeat."""

    def rounds(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        all_ids = table["id"].to_numpy()
        usable = np.flatnonzero(table["vec"].is_valid().to_numpy(zero_copy_only=False))
        parent, height = {}, {}
        if len(usable):
            vectors, ids = matrix(table.take(pa.array(usable)), "vec"), all_ids[usable]
            size = table["n"].to_numpy()[usable].astype(np.float64)
            distance = 1.0 - vectors @ vectors.T
            while len(ids) > 1:
                np.fill_diagonal(distance, np.inf)
                r, c, near, _ = nearest_cells(distance.min(axis=1), distance, ids, ids)
                least = np.full(len(ids), np.inf)
                least[r] = near
                if not (least < threshold).any():
                    break
                best = np.full(len(ids), -1)
                best[r] = np.where(near < threshold, c, -1)
                a = np.flatnonzero((best >= 0) & (best[best] == np.arange(len(ids))) & (np.arange(len(ids)) < best))
                b = best[a]
                for one, other in zip(a, b):
                    parent[ids[other]], height[ids[other]] = ids[one], least[one]
                for side in (distance, distance.T):
                    if linkage == "average":
                        weight = (size[a] / (size[a] + size[b]))[:, None]
                        side[a] = weight * side[a] + (1 - weight) * side[b]
                    else:
                        side[a] = (np.maximum if linkage == "complete" else np.minimum)(side[a], side[b])
                size[a] += size[b]
                # What has no partner below the threshold never gets one: a merged group is no nearer than its parts.
                stay = least < threshold
                stay[b] = False
                ids, size, distance = ids[stay], size[stay], distance[np.ix_(stay, stay)]
        paths, root = [], {}
        for start in all_ids:
            node, path = start, []
            while node in parent:
                path.append({"cluster": parent[node], "height": height[node]})
                node = parent[node]
            paths.append(path)
            root[start] = node
        distance = np.ones(len(all_ids))
        if len(usable):
            _, group = np.unique([root[i] for i in all_ids[usable]], return_inverse=True)
            total = np.zeros((group.max() + 1, vectors.shape[1]))
            np.add.at(total, group, vectors)
            total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), TINY)
            distance[usable] = 1.0 - (vectors * total[group]).sum(axis=1)
        columns = {key: table[key] for key in keys}
        columns["id"] = table["id"]
        columns["path"] = pa.array(paths, pa.list_(pa.struct([("cluster", pa.int64()), ("height", pa.float64())])))
        columns["distance"] = pa.array(np.round(distance, DISTANCE_DIGITS))
        return pa.table(columns)

    return rounds


def _tree_schema(df: DataFrame, keys: list[str]) -> str:
    types = ", ".join(f"`{key}` {df.schema[key].dataType.simpleString()}" for key in keys)
    return f"{types}, id bigint, path {PATH}, distance double"


def _local_tree(nodes: DataFrame, keys: list[str], threshold: float, linkage: str) -> DataFrame:
    """Trees of bounded issues, one task per issue."""
    work = _merge_in_task(threshold, linkage, keys)
    return nodes.select(*keys, "id", "n", "vec").groupBy(*keys).applyInArrow(work, _tree_schema(nodes, keys))


def _fold_copies(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of an issue as one weighted node, and the map ``keys, id, node, vec_hash``.

    Grouping combines before the shuffle, so a vector that fills a third of the table arrives once per task; the
    map joins rows to one row per distinct vector, which adaptive execution splits when a vector is that common.
    """
    hashed = rows.withColumn("vec_hash", F.xxhash64("vec"))
    nodes = hashed.groupBy(*keys, "vec_hash", "vec").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    nodes = materialize(nodes, "nodes")
    members = hashed.join(nodes.drop("n"), [*keys, "vec_hash", "vec"]).select(*keys, "id", "node", "vec_hash")
    return nodes.select(*keys, F.col("node").alias("id"), "n", "vec", "vec_hash"), members


def mutual_pairs(best: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that are each other's nearest: ``keys, parent, child, height``."""
    return (
        best.groupBy(*keys, F.least("id", "partner").alias("parent"), F.greatest("id", "partner").alias("child"))
        .agg(F.count("*").alias("ends"), F.max("distance").alias("height"))
        .filter("ends = 2")
        .drop("ends")
    )


def _weighted_mean(parts: Column) -> Column:
    """Mean vector of the two parts of a merged group."""
    a, b = parts[0], parts[1]
    sizes = F.array_repeat(F.struct(a["n"].alias("a"), b["n"].alias("b")), F.size(a["vec"]))
    pairs = F.arrays_zip(a["vec"].alias("x"), b["vec"].alias("y"), sizes.alias("n"))
    return F.transform(pairs, lambda p: (p["n"]["a"] * p["x"] + p["n"]["b"] * p["y"]) / (p["n"]["a"] + p["n"]["b"]))


def _touched(merges: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Both groups of every merge, under the given column name, with ``parent``."""
    return merges.select(*keys, F.col("parent").alias(name), "parent").unionByName(merges.select(*keys, F.col("child").alias(name), "parent"))


def _plan(best: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """What becomes of each group with a partner: ``keys, id, target, height, fresh, partner, distance, tie``, without vectors.

    ``target`` is the group it merges into, null if it stays. A group without a partner below the threshold never gets one, since a merged
    group is no nearer than the nearer of its parts; such groups are final and leave the rounds. For the same reason a group keeps its
    partner unless that one merged: only merged groups and those that lost their partner are ``fresh``. The joins are merge joins, so that
    no round sends its merges through the driver.
    """
    moves = _touched(merges, keys, "id").select(*keys, "id", F.col("parent").alias("target"))
    lost = _touched(merges, keys, "partner").select(*keys, "partner", F.lit(True).alias("lost"))
    found = best.join(moves.hint("merge"), [*keys, "id"], "left").join(lost.hint("merge"), [*keys, "partner"], "left")
    fresh = F.col("target").isNotNull() | F.col("lost").isNotNull()
    held = [F.when(~fresh, F.col(c)).alias(c) for c in ("partner", "distance", "tie")]
    return found.select(*keys, "id", "target", F.when(F.col("target").isNotNull(), F.col("distance")).alias("height"), fresh.alias("fresh"), *held)


def _next_nodes(nodes: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """The groups after a round, with the partners that still hold.

    Vectors are dealt out by id once, for both joins. These are merge joins, as the plan has a row for every group in every round, which would else go
    through the driver each time while it is small enough to be broadcast.
    """
    vectors = nodes.select(*keys, "id", "n", "vec")
    stay = vectors.join(plan.filter("target is null").drop("target", "height").hint("merge"), [*keys, "id"])
    parts = vectors.join(plan.filter("target is not null").select(*keys, "id", "target").hint("merge"), [*keys, "id"])
    both = parts.groupBy(*keys, "target").agg(F.collect_list(F.struct("n", "vec")).alias("parts"))
    size = F.col("parts")[0]["n"] + F.col("parts")[1]["n"]
    merged = both.select(*keys, F.col("target").alias("id"), size.alias("n"), _weighted_mean(F.col("parts")).alias("vec"), F.lit(True).alias("fresh"), *_no_partner())
    return stay.unionByName(merged)


def _no_partner() -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in (("partner", "bigint"), ("distance", "double"), ("tie", "bigint"))]


def follow(paths: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Extend ``keys, id, path`` by the path of the group each one ends in, until all end in a root.

    ``links`` has ``keys, id, path`` for every group that was merged away. Each pass doubles the known length, without the driver.
    """
    while True:
        end = F.element_at("path", -1)["cluster"]
        onward = links.select(*keys, F.col("id").alias("end"), F.col("path").alias("rest"))
        longer = links.withColumn("end", end).join(onward.hint("merge"), [*keys, "end"], "left")
        grown = longer.select(
            *keys,
            "id",
            F.concat("path", F.coalesce("rest", F.array().cast(PATH))).alias("path"),
            F.col("rest").isNotNull().alias("more"),
        )
        links = materialize(grown, "paths")
        if links.filter("more").isEmpty():
            break
        links = links.drop("more")
    end = F.when(F.size("path") > 0, F.element_at("path", -1)["cluster"]).otherwise(F.col("id"))
    onward = links.select(*keys, F.col("id").alias("end"), F.col("path").alias("rest"))
    return (
        paths.withColumn("end", end)
        .join(onward.hint("merge"), [*keys, "end"], "left")
        .select(*keys, "id", F.concat("path", F.coalesce("rest", F.array().cast(PATH))).alias("path"))
    )


def _average_rounds(nodes: DataFrame, keys: list[str], threshold: float, local_limit: int, tile_rows: int) -> DataFrame:
    """Merges of average linkage, in rounds: ``keys, id, path`` of every group that was merged away.

    Each group holds its best partner; a round merges all mutual pairs and renews the partners of the fresh groups alone. While most
    groups are fresh, pairs of tiles meet; later only fresh groups are sent to all tiles. Tables of past rounds are dropped, but for
    the narrow plans that the merges are read from.
    """
    spark = nodes.sparkSession
    tile_rows = fitting_rows(nodes, keys, tile_rows)
    pivots = choose_pivots(nodes, tile_rows)
    start = nodes.select(*keys, "id", "n", "vec", F.lit(True).alias("fresh"), *_no_partner())
    nodes, path = write_table(start, "nodes")
    plans, rounds, plan_schema = new_path(spark, "plans"), 0, None
    links, active = [], None
    while True:
        sizes = nodes.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if("fresh").alias("renewed"))
        sizes = materialize(sizes, "sizes")
        fits = F.col("rows") <= local_limit
        large = [F.sum(F.when(~fits, F.col(c))).alias(c) for c in ("rows", "renewed")]
        # A few totals, not a list of issues. Finished groups have left ``nodes``.
        found = sizes.agg(F.count_if(fits).alias("small"), *large, F.sum("rows").alias("all")).first()
        if found.small:
            ready = nodes.join(sizes.filter(fits), keys, "left_semi")
            finished = _local_tree(ready, keys, threshold, "average").filter(F.size("path") > 0)
            links.append(materialize(finished.select(*keys, "id", F.slice("path", 1, 1).alias("path")), "links"))
            nodes, sizes = nodes.join(sizes.filter(~fits), keys, "left_semi"), sizes.filter(~fits)
        if not found.rows:
            break
        _check_progress(active, found.all)
        active = found.rows
        held = nodes.filter("partner is not null").select(*keys, "id", "partner", "distance", "tie")
        if 2 * found.renewed < found.rows:
            renewed = renew_partners(nodes, keys, threshold, tile_rows, sizes)
        else:
            renewed = nearest_within(nodes.select(*keys, "id", "vec", "fresh"), keys, threshold, tile_rows, pivots, sizes)
        best = materialize(keep_best(renewed.unionByName(held), keys, threshold), "best")
        plan = _plan(best, mutual_pairs(best, keys), keys)
        plan_schema = plan.schema
        plan.write.parquet(f"{plans}/round={rounds}")
        plan = spark.read.schema(plan_schema).parquet(f"{plans}/round={rounds}")
        nodes, following = write_table(_next_nodes(nodes, plan, keys), "nodes")
        drop_table(spark, path)
        path, rounds = following, rounds + 1
    if rounds:
        merged = spark.read.schema(plan_schema).parquet(plans).filter("target <> id")
        step = F.array(F.struct(F.col("target").alias("cluster"), "height")).cast(PATH)
        links.append(merged.select(*keys, "id", step.alias("path")))
    return reduce(DataFrame.unionByName, links) if links else _no_links(start, keys)


def _distributed_tree(
    rows: DataFrame, keys: list[str], threshold: float, linkage: str, local_limit: int, tile_rows: int
) -> DataFrame:
    """Trees of issues too large for one task."""
    usable = rows.filter(F.col("vec").isNotNull())
    nodes, members = _fold_copies(usable, keys)
    if linkage == "average":
        links = _average_rounds(nodes, keys, threshold, local_limit, tile_rows)
    elif linkage == "single":
        edges = spanning_forest(nodes.select(*keys, "id", "vec"), keys, threshold, tile_rows)
        links = _forest_merges(edges, keys, local_limit)
    else:
        links = _complete_rounds(nodes.select(*keys, "id", "vec"), keys, threshold, tile_rows)
    links = materialize(links, "links")
    copy = F.array(F.struct(F.col("node").alias("cluster"), F.lit(0.0).alias("height"))).cast(PATH)
    start = members.select(
        *keys, "id", F.when(F.col("id") == F.col("node"), F.array().cast(PATH)).otherwise(copy).alias("path")
    )
    tree = materialize(follow(start, links, keys), "tree")
    whole = tree.withColumn("cluster_id", cluster_at(F.col("path"), F.col("id"), F.lit(threshold)))
    far = centroid_distances(whole.join(usable, [*keys, "id"]), keys)
    return far.select(*keys, "id", "path", "distance").unionByName(_alone(rows, keys, F.array().cast(PATH).alias("path")))


def _alone(rows: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """Rows without a usable vector: groups of one."""
    return rows.filter(F.col("vec").isNull()).select(*keys, "id", label, F.lit(1.0).alias("distance"))


def centroid_distances(labelled: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """Replace the unit vector of each row by its distance from the mean of its cluster.

    Partial sums leave each task, not vectors; the rows then meet one vector per cluster.
    """
    center = vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("_center")
    # Written, so that the rows of a hot cluster can be split when they meet its centre.
    centers = materialize(labelled.groupBy(*keys, "cluster_id").agg(center), "centers")
    distance = F.round(cosine_distance(F.col(vector), F.col("_center")), DISTANCE_DIGITS)
    return labelled.join(centers, [*keys, "cluster_id"]).withColumn("distance", distance).drop("_center", vector)


def _large_issues(articles: DataFrame, keys: list[str], local_limit: int) -> DataFrame:
    """Issues that no single task may take; there are at most ``rows / local_limit`` of them."""
    counts = articles.groupBy(*keys).agg(F.count("*").alias("rows"))
    return materialize(counts.filter(F.col("rows") > local_limit).select(*keys), "large")


def merge_tree(
    articles: DataFrame,
    keys: list[str],
    threshold: float,
    linkage: str = "average",
    id_column: str = "seq",
    vector: str = "embedding",
    local_limit: int = LOCAL_LIMIT,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Merge history up to ``threshold``: ``keys, id, path, distance``, for every linkage and issues of any size.

    Issues of at most ``local_limit`` rows are many small groups, one task each; larger ones run in rounds. Both give the same
    merges. ``articles`` is read more than once, so what a provider made has to be a written table.
    """
    check_linkage(linkage)
    rows = unit_rows(articles, keys, id_column, vector)
    large = _large_issues(articles, keys, local_limit)
    weighted = rows.withColumn("n", F.lit(1).cast("bigint"))
    if large.isEmpty():
        return _local_tree(weighted, keys, threshold, linkage)
    local = _local_tree(weighted.join(large, keys, "left_anti"), keys, threshold, linkage)
    rows = materialize(rows.join(large, keys, "left_semi"), "vectors")
    return local.unionByName(_distributed_tree(rows, keys, threshold, linkage, local_limit, tile_rows))


def cluster_at(path: Column, own: Column, threshold: Column) -> Column:
    """The group of a row when only merges below ``threshold`` count."""
    taken = F.filter(path, lambda step: step["height"] < threshold)
    return F.coalesce(F.try_element_at(taken, F.lit(-1))["cluster"], own)


def cut(tree: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Labels at a threshold: ``keys, id, cluster_id``."""
    return tree.select(*keys, "id", _label(threshold))


def _label(threshold: float) -> Column:
    return cluster_at(F.col("path"), F.col("id"), F.lit(threshold)).alias("cluster_id")


def cut_many(tree: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Labels at several thresholds from one tree: ``keys, threshold, id, cluster_id`` and other columns it has."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    label = cluster_at(F.col("path"), F.col("id"), F.col("threshold"))
    return tree.withColumn("threshold", grid).withColumn("cluster_id", label).drop("path")


def _single_linkage(
    rows: DataFrame, keys: list[str], threshold: float, tile_rows: int
) -> DataFrame:
    """Components of the graph of pairs below the threshold.

    Each pair of tiles returns a spanning forest of its own pairs, at most one row per vector, which keeps the
    components of the whole graph without emitting its edges.
    """
    types = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)

    def forest(table: pa.Table) -> pa.Table:
        ids, vectors = table["id"].to_numpy(), matrix(table, "vec")
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        waiting = np.ones(len(ids), bool)
        hubs, members = [], []
        for start in range(len(ids)):
            if not waiting[start]:
                continue
            waiting[start] = False
            frontier = np.array([start])
            while len(frontier):
                rest = np.flatnonzero(waiting)
                if not len(rest):
                    break
                reached = np.zeros(len(rest), bool)
                step = max(1, MATRIX_CELLS // len(rest))
                for low in range(0, len(frontier), step):
                    block = np.round(1.0 - vectors[frontier[low : low + step]] @ vectors[rest].T, DISTANCE_DIGITS)
                    reached |= (block < threshold).any(axis=0)
                frontier = rest[reached]
                waiting[frontier] = False
                hubs.extend([ids[start]] * len(frontier))
                members.extend(ids[frontier])
        columns = {key: table[key].take(pa.array(np.zeros(len(hubs), np.int64))) for key in keys}
        columns["a"], columns["b"] = pa.array(hubs, pa.int64()), pa.array(members, pa.int64())
        return pa.table(columns)

    tiled = tile_pairs(with_tiles(rows, keys, fitting_rows(rows, keys, tile_rows), "tiles", "tile"))
    edges = tiled.groupBy(*keys, "p", "q").applyInArrow(forest, f"{types}, a bigint, b bigint")
    return connected_components(rows.select(*keys, "id"), edges, keys)


def _unit_groups(starts: np.ndarray, rows: int, most: int):
    """Runs of consecutive units of at most ``most`` rows in all, or one unit: ``(first unit, last unit + 1)``."""
    ends = np.r_[starts[1:], rows]
    first = 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or ends[k] - starts[first] > most:
            yield first, k
            first = k


def _complete_rounds(rows: DataFrame, keys: list[str], threshold: float, tile_rows: int) -> DataFrame:
    """Merges of complete linkage, in rounds: ``keys, id, path`` of every group that was merged away.

    The distance of two groups is the largest over their members, so members stay. They keep to the tile of their group, and a
    pair of tiles returns the best pair per group. A group of more than a tile is spread over parts: pairs with it are returned
    with a partial maximum and count only when every combination of parts stayed below the threshold. The linkage is reducible, so
    a group without a partner below the threshold never gets one and leaves the rounds, and a group keeps its partner unless
    that one merged: only merged groups and those that lost their partner are compared again, and only these are sent to all tiles.
    """
    spark = rows.sparkSession
    types = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    tile_rows = fitting_rows(rows, keys, tile_rows)

    def units(table: pa.Table):
        """Vectors by unit (a part of a group): the first row of each, its group, its number of parts, and if it is fresh."""
        table = table.sort_by([("cluster_id", "ascending"), ("part", "ascending")])
        unit = np.stack([table["cluster_id"].to_numpy(), table["part"].to_numpy()], axis=1)
        starts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1)])
        return matrix(table, "vec"), starts, unit[starts, 0], table["parts"].to_numpy()[starts], table["fresh"].to_numpy()[starts]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        best, wide = [(none, none, np.zeros(0), none)], [(none, none, np.zeros(0), none)]
        if left.num_rows and right.num_rows:
            own, own_starts, names, own_parts, _ = units(left)
            vectors, starts, others, parts, fresh = units(right)
            most = max(1, MATRIX_CELLS // len(vectors))
            single = len(starts) == len(vectors)
            ahead, behind = Best(len(names)), Best(len(others))
            for first, last in _unit_groups(own_starts, len(own), most):
                begin, end = own_starts[first], own_starts[last] if last < len(own_starts) else len(own)
                distance = None
                for low in range(begin, end, most):  # more than one step only if a single unit is that large
                    block = own[low : min(end, low + most)] @ vectors.T
                    np.subtract(1.0, block, out=block)
                    if not single:
                        block = np.maximum.reduceat(block, starts, axis=1)
                    if last - first == len(block):
                        distance = block
                    elif last - first > 1:
                        distance = np.maximum.reduceat(block, own_starts[first:last] - begin, axis=0)
                    else:
                        block = np.maximum.reduce(block, axis=0, keepdims=True)
                        distance = block if distance is None else np.maximum(distance, block)
                distance = np.round(distance, DISTANCE_DIGITS)
                mine = names[first:last]
                allowed = distance < threshold
                allowed &= mine[:, None] != others[None, :]
                # Two fresh groups meet in two places; each pair is looked at once, so that both ends see the same number.
                again = np.flatnonzero(fresh)
                allowed[:, again] &= others[again][None, :] > mine[:, None]
                spread = (own_parts[first:last][:, None] > 1) | (parts[None, :] > 1)
                if spread.any():
                    r, c = np.nonzero(allowed & spread)
                    d, needed = distance[r, c], own_parts[first:last][r] * parts[c]
                    wide += [(mine[r], others[c], d, needed), (others[c], mine[r], d, needed)]
                    allowed &= ~spread
                distance[~allowed] = np.inf
                r, c, near, tie = nearest_cells(distance.min(axis=1), distance, mine, others)
                ahead.offer(first + r, c, others[c], near, tie)
                r, c, near, tie = nearest_cells(distance.min(axis=0), distance.T, others, mine)
                behind.offer(r, first + c, mine[c], near, tie)
            for own_names, kept in ((names, ahead), (others, behind)):
                row, _, partner, near, tie = kept.found()
                best.append((own_names[row], partner, near, tie))
        found, whole = (tuple(np.concatenate(x) for x in zip(*made)) for made in (best, wide))
        found = first_choices(*found)
        number = len(found[0]) + len(whole[0])
        columns = {key: (left if left.num_rows else right)[key].take(pa.array(np.zeros(number, np.int64))) for key in keys}
        columns["id"], columns["partner"] = (pa.array(np.concatenate([found[i], whole[i]]).astype(np.int64)) for i in (0, 1))
        columns["distance"] = pa.array(np.concatenate([found[2], whole[2]]))
        columns["tie"] = pa.array(np.concatenate([found[3], tie_order(whole[0], whole[1])]))
        columns["needed"] = pa.array(np.concatenate([np.ones(len(found[0]), np.int64), whole[3]]))
        return pa.table(columns)

    schema = f"{types}, id bigint, partner bigint, distance double, tie bigint, needed bigint"
    state, path = write_table(rows.select(*keys, "id", "vec", F.col("id").alias("cluster_id"), F.lit(True).alias("fresh")), "state")
    held, links, waiting = None, [], None
    while True:
        # Written, so that its size is known: only groups wider than a tile are joined.
        size = materialize(state.groupBy(*keys, "cluster_id").agg(F.count("*").alias("rows"), F.bool_or("fresh").alias("fresh")), "sizes")
        _check_progress(waiting, size.count())
        counts = materialize(size.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("fresh"), F.col("rows")).otherwise(0)).alias("renewed")), "counts")
        wide = size.filter(F.col("rows") > tile_rows).select(*keys, "cluster_id", F.ceil(F.col("rows") / tile_rows).alias("parts"))
        placed = state.join(wide, [*keys, "cluster_id"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("unit", F.xxhash64("cluster_id", "part"))
        left, right = met_by_fresh(placed.drop("id"), keys, tile_rows, counts, "unit")
        found = (
            left.groupBy(*keys, "p", "q").cogroup(right.groupBy(*keys, "p", "q"))
            .applyInArrow(search, schema)
            .groupBy(*keys, "id", "partner")
            .agg(F.max("distance").alias("distance"), F.max("tie").alias("tie"), F.count("*").alias("seen"), F.max("needed").alias("needed"))
            # Parts of a group may lie in one tile, so combinations are counted for spread groups alone.
            .filter("needed = 1 or seen = needed")
            .select(*keys, "id", "partner", "distance", "tie")
        )
        best = materialize(keep_best(found if held is None else found.unionByName(held), keys, threshold), "best")
        waiting = best.count()
        if not waiting:
            break
        merges = mutual_pairs(best, keys)
        following = materialize(_plan(best, merges, keys), "following")
        step = F.array(F.struct(F.col("target").alias("cluster"), "height")).cast(PATH)
        links.append(following.filter("target <> id").select(*keys, "id", step.alias("path")))
        held = following.filter("not fresh").select(*keys, "id", "partner", "distance", "tie")
        moves = following.select(*keys, F.col("id").alias("cluster_id"), F.coalesce("target", "id").alias("target"), F.col("fresh").alias("renewed"))
        # A merge join: the moves have a row for every group, which would go through the driver each round if they were broadcast.
        moved = state.join(moves.hint("merge"), [*keys, "cluster_id"]).select(*keys, "id", "vec", F.col("target").alias("cluster_id"), F.col("renewed").alias("fresh"))
        state, written = write_table(moved, "state")
        drop_table(spark, path)
        path = written
    return reduce(DataFrame.unionByName, links) if links else _no_links(rows, keys)


def spanning_forest(rows: DataFrame, keys: list[str], threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """A minimum spanning forest of the pairs nearer than ``threshold``: ``keys, a, b, distance, tie``, at most one row per vector.

    In each round every component takes its lightest edge to another one, found by a minimum over pairs of tiles, and the components
    that these edges join become one, so the number of rounds is logarithmic. Edges have a total order that both ends share, so
    no circle forms. A component without such an edge is complete and leaves the rounds.
    """
    spark = rows.sparkSession
    types = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    tile_rows = fitting_rows(rows, keys, tile_rows)
    pivots = choose_pivots(rows, tile_rows)

    def search(table: pa.Table) -> pa.Table:
        ids, vectors, group = table["id"].to_numpy(), matrix(table, "vec"), table["cluster_id"].to_numpy()
        fresh = np.ones(len(ids), bool)
        best = Best(len(ids))
        for left, right, distance in pair_blocks(vectors, table["tile"].to_numpy(), table["p"][0].as_py(), table["q"][0].as_py(), fresh):
            distance[group[left][:, None] == group[right][None, :]] = np.inf
            for own, others, found in ((left, right, distance), (right, left, distance.T)):
                r, c, near, tie = nearest_cells(found.min(axis=1), found, ids[own], ids[others])
                use = near < threshold
                best.offer(own[r[use]], others[c[use]], ids[others[c[use]]], near[use], tie[use])
        a, b, _, near, tie = best.found()
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        order = np.lexsort((high, low, tie, near, group[a]))
        first = order[np.unique(group[a][order], return_index=True)[1]]
        columns = {key: table[key].take(pa.array(np.zeros(len(first), np.int64))) for key in keys}
        for name, values in (("id", group[a]), ("other", group[b]), ("a", low), ("b", high), ("distance", near), ("tie", tie)):
            columns[name] = pa.array(values[first])
        return pa.table(columns)

    schema = f"{types}, id bigint, other bigint, a bigint, b bigint, distance double, tie bigint"
    state, path = write_table(with_cells(rows.withColumns({"cluster_id": F.col("id"), "fresh": F.lit(True)}), pivots), "state")
    edges = []
    while True:
        spread = near_tiles(state, keys, threshold, pivots, tile_rows)
        found = spread.groupBy(*keys, "p", "q").applyInArrow(search, schema)
        least = found.groupBy(*keys, "id").agg(F.min(F.struct("distance", "tie", "a", "b", "other")).alias("edge"))
        least = materialize(least.select(*keys, "id", "edge.*"), "edges")
        if least.isEmpty():
            break
        edges.append(least.select(*keys, "a", "b", "distance", "tie").distinct())
        joined = connected_components(least.select(*keys, "id"), least.select(*keys, F.col("id").alias("a"), F.col("other").alias("b")), keys)
        labels = joined.select(*keys, F.col("id").alias("cluster_id"), F.col("cluster_id").alias("target"))
        moved = state.join(labels, [*keys, "cluster_id"]).withColumn("cluster_id", F.col("target")).drop("target")
        state, written = write_table(moved, "state")
        drop_table(spark, path)
        path = written
    none = rows.limit(0).select(*keys, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"), F.col("id").alias("tie"))
    return materialize(reduce(DataFrame.unionByName, edges, none), "forest")


def _forest_merges(edges: DataFrame, keys: list[str], local_limit: int) -> DataFrame:
    """The merge history of single linkage from its spanning forest: ``keys, id, path`` of every group that was merged away.

    Edges in order of their length are cut into slices of equal size. What a slice merges follows from its own edges once their ends are named
    by the components of all shorter ones; so all slices are worked on side by side, and cut again until they have at most
    ``local_limit`` edges, which a task takes whole. The number of steps is logarithmic, also when one group takes up all others one by one. Vectors take no part.
    """
    types = ", ".join(f"`{key}` {edges.schema[key].dataType.simpleString()}" for key in keys)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("distance", "ascending"), ("tie", "ascending"), ("a", "ascending"), ("b", "ascending")])
        name: dict[int, int] = {}

        def find(x: int) -> int:
            while name.get(x, x) != x:
                name[x] = name.get(name[x], name[x])
                x = name[x]
            return x

        ids, paths = [], []
        for a, b, height in zip(*(table[c].to_pylist() for c in ("a", "b", "distance"))):
            a, b = sorted((find(a), find(b)))
            name[b] = a
            ids.append(b)
            paths.append([{"cluster": a, "height": height}])
        columns = {key: table[key].take(pa.array(np.zeros(len(ids), np.int64))) for key in keys}
        columns["id"] = pa.array(ids, pa.int64())
        columns["path"] = pa.array(paths, pa.list_(pa.struct([("cluster", pa.int64()), ("height", pa.float64())])))
        return pa.table(columns)

    by, columns = [*keys, "_cut"], ["a", "b", "distance", "tie"]
    edges = edges.select(*keys, F.lit(0).cast("bigint").alias("_cut"), *columns)
    links = []
    while True:
        edges = materialize(edges, "edges")
        counts = issue_sizes(edges, by)
        fits = F.col("rows") <= max(1, local_limit)
        small = edges.join(counts.filter(fits), by, "left_semi")
        links.append(small.groupBy(*by).applyInArrow(merge, f"{types}, id bigint, path {PATH}"))
        if counts.filter(~fits).isEmpty():
            break
        order = [F.col(c) for c in ("distance", "tie", "a", "b")]
        # Lengths in order, so that equal ones keep theirs in every slice.
        placed = positions(edges.join(counts.filter(~fits), by, "left_semi"), by, order, "_place").join(counts, by)
        cut = materialize(placed.withColumn("_slice", F.floor((F.col("_place") - 1) * SLICES / F.col("rows"))).select(*by, *columns, "_slice"), "cut")
        # Shorter edges go to each later slice of their part.
        shorter = cut.filter(F.col("_slice") < SLICES - 1).withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, F.lit(SLICES - 1).cast("bigint")))).select(*by, "_slice", "a", "b")
        ends = shorter.select(*by, "_slice", F.col("a").alias("id")).unionByName(shorter.select(*by, "_slice", F.col("b").alias("id"))).distinct()
        names = connected_components(ends, shorter, [*by, "_slice"])
        edges = cut
        for end in ("a", "b"):
            named = names.select(*by, "_slice", F.col("id").alias(end), F.col("cluster_id").alias("_name"))
            edges = edges.join(named, [*by, "_slice", end], "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
        edges = edges.select(*keys, (F.col("_cut") * SLICES + F.col("_slice")).alias("_cut"), *columns)
    return reduce(DataFrame.unionByName, links)


def _check_progress(waiting: int | None, left: int | None) -> None:
    """Candidates without any mutual pair would mean that two tasks saw different distances for one pair.

    ``waiting`` groups had a partner in the last round; if as many are left, none of them merged.
    """
    if waiting is not None and left == waiting:
        raise RuntimeError("no pair merged although candidates remain")


def _no_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.limit(0).select(*keys, "id", F.array().cast(PATH).alias("path"))


def assign(
    articles: DataFrame,
    keys: list[str],
    threshold: float,
    linkage: str = "average",
    id_column: str = "seq",
    vector: str = "embedding",
    local_limit: int = LOCAL_LIMIT,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Labels at a threshold: ``keys, id, cluster_id, distance``, the distance being that from the cluster's mean.

    Merges happen strictly below the threshold.
    """
    check_linkage(linkage)
    if linkage == "single":
        return _single_labels(articles, keys, threshold, id_column, vector, local_limit, tile_rows)
    tree = merge_tree(articles, keys, threshold, linkage, id_column, vector, local_limit, tile_rows)
    return tree.select(*keys, "id", _label(threshold), "distance")


def _single_labels(
    articles: DataFrame, keys: list[str], threshold: float, id_column: str, vector: str, local_limit: int, tile_rows: int
) -> DataFrame:
    """Groups of single linkage at one threshold: the same as its merge history gives, found in one pass over the pairs."""
    rows = unit_rows(articles, keys, id_column, vector)
    large = _large_issues(articles, keys, local_limit)
    weighted = rows.withColumn("n", F.lit(1).cast("bigint"))
    done = [*keys, "id", _label(threshold), "distance"]
    if large.isEmpty():
        return _local_tree(weighted, keys, threshold, "single").select(*done)
    local = _local_tree(weighted.join(large, keys, "left_anti"), keys, threshold, "single").select(*done)
    rest = materialize(rows.join(large, keys, "left_semi"), "vectors")
    usable = rest.filter(F.col("vec").isNotNull())
    nodes, members = _fold_copies(usable, keys)
    labels = _single_linkage(nodes.select(*keys, "id", "vec"), keys, threshold, tile_rows)
    labels = members.join(labels.withColumnRenamed("id", "node"), [*keys, "node"]).select(*keys, "id", "cluster_id")
    far = centroid_distances(materialize(labels, "labels").join(usable, [*keys, "id"]), keys)
    return local.unionByName(far).unionByName(_alone(rest, keys, F.col("id").alias("cluster_id")))


def cluster_articles(
    articles: DataFrame, keys: list[str], threshold: float, id_column: str = "seq", vector: str = "embedding", **options
) -> DataFrame:
    """Articles with ``cluster_id`` and ``distance`` in place of their vector, which is not moved a second time."""
    labels = assign(articles, keys, threshold, id_column=id_column, vector=vector, **options)
    return articles.drop(vector).join(labels.withColumnRenamed("id", id_column), [*keys, id_column])


def with_cluster_size(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Add the number of rows of the cluster. The sizes are written, so that a hot cluster's rows can be split in the join."""
    sizes = materialize(clustered.groupBy(*keys, "cluster_id").agg(F.count("*").alias("cluster_size")), "sizes")
    return clustered.join(sizes, [*keys, "cluster_id"])


def unclustered(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Articles that stayed alone: the only row of a group is any row of it, so one aggregate finds them, without a join."""
    whole = F.struct(*[F.col(f"`{c}`") for c in clustered.columns])
    alone = clustered.groupBy(*keys, "cluster_id").agg(F.count("*").alias("_n"), F.min(whole).alias("_row"))
    return alone.filter("_n = 1").select("_row.*")
