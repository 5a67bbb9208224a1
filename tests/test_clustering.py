from __future__ import annotations

import numpy as np
import pytest
from brute import greedy
from pyspark.sql import functions as F

from storyline.operators import clustering as C
from storyline.operators import nearest as N
from storyline.session import materialize

KEYS = ["show"]


def frame(spark, blocks):
    rows = [(show, i, [float(x) for x in v]) for show, vectors in blocks.items() for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "show string, seq bigint, embedding array<double>")


def labels(df, size):
    found = {r.id: r.cluster_id for r in df.collect()}
    assert len(found) == size
    return np.array([found[i] for i in range(size)])


def clumps(seed, n, dims=6, groups=5, noise=0.6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    return centers[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dims))


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5])
def test_equals_greedy_merging_in_task(spark, linkage, threshold):
    blocks = {f"s{i}": clumps(i, 30 + i) for i in range(4)}
    found = C.assign(frame(spark, blocks), KEYS, threshold, linkage)
    for show, vectors in blocks.items():
        assert (labels(found.filter(f"show = '{show}'"), len(vectors)) == greedy(vectors, threshold, linkage)).all()


@pytest.mark.parametrize("linkage,threshold", [("average", 0.3), ("complete", 0.4), ("single", 0.08)])
def test_equals_greedy_merging_across_tasks(spark, linkage, threshold):
    vectors = clumps(7, 60)
    vectors[50:] = vectors[3]  # a group of copies
    vectors[20] = 0  # never merges
    df = frame(spark, {"big": vectors, "small": vectors[:9]})
    found = C.assign(df, KEYS, threshold, linkage, local_limit=12, tile_rows=16)
    expected = greedy(np.delete(vectors, 20, axis=0), threshold, linkage)
    back = np.delete(np.arange(60), 20)
    whole = np.full(60, 20)
    whole[back] = back[expected]
    assert (labels(found.filter("show = 'big'"), 60) == whole).all()
    assert (labels(found.filter("show = 'small'"), 9) == greedy(vectors[:9], threshold, linkage)).all()


def test_one_history_serves_lower_thresholds(spark):
    vectors = clumps(3, 50)
    df = frame(spark, {"s": vectors})
    for options in ({}, {"local_limit": 10, "tile_rows": 20}):
        tree = C.merge_tree(df, KEYS, 0.6, **options)
        for t in (0.05, 0.1, 0.3, 0.6):
            assert (labels(C.cut(tree, KEYS, t), 50) == greedy(vectors, t)).all()
        many = C.cut_many(tree, KEYS, [0.1, 0.3])
        assert (labels(many.filter("threshold = 0.3"), 50) == greedy(vectors, 0.3)).all()


def test_a_group_wider_than_a_tile_with_complete_linkage(spark):
    rng = np.random.default_rng(5)
    vectors = np.r_[rng.normal(size=(1, 5)) + 0.02 * rng.normal(size=(40, 5)), clumps(9, 20, 5)]
    found = C.assign(frame(spark, {"s": vectors}), KEYS, 0.3, "complete", local_limit=5, tile_rows=8)
    assert (labels(found, 60) == greedy(vectors, 0.3, "complete")).all()


def test_partitioning_does_not_matter(spark):
    df = frame(spark, {"s": clumps(11, 80)})
    one = labels(C.assign(df.repartition(1), KEYS, 0.4), 80)
    assert (one == labels(C.assign(df.repartition(7), KEYS, 0.4), 80)).all()
    assert (one == labels(C.assign(df.repartition(5), KEYS, 0.4, local_limit=10, tile_rows=16), 80)).all()


def test_edges(spark):
    assert C.assign(frame(spark, {"s": []}), KEYS, 0.4).count() == 0
    assert labels(C.assign(frame(spark, {"s": [[1, 0]]}), KEYS, 0.4), 1).tolist() == [0]
    same = labels(C.assign(frame(spark, {"s": [[1, 2]] * 5}), KEYS, 0.4), 5)
    assert same.tolist() == [0] * 5
    zero = labels(C.assign(frame(spark, {"s": [[0, 0], [0, 0], [1, 0]]}), KEYS, 0.4), 3)
    assert zero.tolist() == [0, 1, 2]
    right_angle = [[1, 0], [0, 1]]  # distance exactly 1
    assert labels(C.assign(frame(spark, {"s": right_angle}), KEYS, 1.0), 2).tolist() == [0, 1]
    assert labels(C.assign(frame(spark, {"s": right_angle}), KEYS, 1.01), 2).tolist() == [0, 0]


def test_many_copies_merge_in_few_rounds(spark):
    vectors = np.repeat(clumps(2, 4), 50, axis=0)
    tree = C.merge_tree(frame(spark, {"s": vectors}), KEYS, 0.01)
    assert max(len(r.path) for r in tree.collect()) < 20


def test_unknown_linkage(spark):
    df = frame(spark, {"s": [[1, 0]]})
    with pytest.raises(ValueError, match="ward"):
        C.assign(df, KEYS, 0.4, "ward")
    with pytest.raises(ValueError, match="unknown"):
        C.assign(df, KEYS, 0.4, "centroid")


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_distance_from_the_mean_agrees_on_all_paths(spark, linkage):
    vectors = clumps(13, 40)
    df = frame(spark, {"s": vectors})
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = greedy(vectors, 0.3, linkage)
    for options in ({}, {"local_limit": 8, "tile_rows": 16}):
        for row in C.assign(df, KEYS, 0.3, linkage, **options).collect():
            mean = u[expected == row.cluster_id].mean(axis=0)
            assert row.distance == pytest.approx(1 - u[row.id] @ mean / np.linalg.norm(mean), abs=1e-9)


def test_similarity_join_folds_copies(spark):
    vectors = np.r_[clumps(4, 12), np.repeat(clumps(5, 1), 6, axis=0)]
    found = {(r.id, r.partner): (r.copies, r.partner_copies) for r in C.similarity_join(frame(spark, {"s": vectors}), KEYS, 0.4).collect()}
    u = vectors[:13] / np.linalg.norm(vectors[:13], axis=1, keepdims=True)
    expected = {(a, b): (1, 6 if b == 12 else 1) for a, b in zip(*np.nonzero(np.triu(1 - u @ u.T < 0.4, 1)))}
    assert found == {**expected, (12, 12): (6, 6)}


def test_spanning_forest_is_minimal(spark):
    vectors = clumps(21, 70)
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12)
    rows = C.unit_rows(frame(spark, {"s": vectors}), KEYS)
    for threshold, tile_rows in ((0.3, 12), (0.05, 1000)):
        found = C.spanning_forest(rows, KEYS, threshold, tile_rows).collect()
        name, weight = list(range(70)), 0.0
        for i, j in sorted(zip(*np.nonzero(np.triu(d < threshold, 1))), key=lambda p: d[p]):
            if name[i] != name[j]:
                weight += d[i, j]
                name = [name[i] if x == name[j] else x for x in name]
        assert len(found) == 70 - len(set(name))
        assert sum(r.distance for r in found) == pytest.approx(weight)


@pytest.mark.parametrize("local_limit", [1, 1000])
def test_single_history_serves_lower_thresholds(spark, local_limit):
    vectors = clumps(22, 50)
    rows = C.unit_rows(frame(spark, {"s": vectors}), KEYS)
    links = C._forest_merges(C.spanning_forest(rows, KEYS, 0.3, 20), KEYS, local_limit)
    start = rows.select(*KEYS, "id", C.F.array().cast(C.PATH).alias("path"))
    tree = C.follow(start, links, KEYS)
    for t in (0.02, 0.05, 0.3):
        assert (labels(C.cut(tree, KEYS, t), 50) == greedy(vectors, t, "single")).all()


def test_far_tiles_do_not_meet(spark):
    """Tight groups in different directions: a tile meets few others, and no near pair is lost."""
    rng = np.random.default_rng(8)
    centers = np.eye(12)
    vectors = np.repeat(centers, 30, axis=0) + 0.02 * rng.normal(size=(360, 12))
    rows = C.unit_rows(frame(spark, {"s": vectors}), KEYS)
    pivots = C.choose_pivots(rows, 20)
    cells = C.with_cells(rows.withColumn("fresh", C.F.lit(True)), pivots)
    near, every = (C.near_tiles(cells, KEYS, below, pivots, 20).select("p", "q").distinct().count() for below in (0.1, None))
    assert near < 0.75 * every
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - u @ u.T + 2 * np.eye(360)
    found = {r.id: r.distance for r in C.nearest_within(rows, KEYS, 0.1, 20, pivots).collect()}
    assert set(found) == set(np.flatnonzero(d.min(axis=1) < 0.1)) and all(abs(found[i] - d[i].min()) < 1e-9 for i in found)


def test_only_fresh_pairs_are_looked_at(spark):
    vectors = clumps(23, 40)
    rows = C.unit_rows(frame(spark, {"s": vectors}), KEYS).withColumn("fresh", C.F.col("id") < 10)
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - u @ u.T + 2 * np.eye(40)
    d[10:, 10:] = 2
    for tile_rows in (7, 1000):
        found = {r.id: r.partner for r in C.nearest_within(rows, KEYS, None, tile_rows).collect()}
        assert found == {i: int(d[i].argmin()) for i in range(40)}


def test_tiles_grow_with_their_block(spark):
    """A row is sent to a bounded number of tiles, however small the tiles asked for."""
    rows = C.unit_rows(frame(spark, {"big": clumps(24, 400), "small": clumps(25, 9)}), KEYS)
    assert C.fitting_rows(rows, KEYS, 4) == 25 and C.fitting_rows(rows, KEYS, 100) == 100


def test_few_fresh_groups_renew_partners(spark):
    """Only fresh groups are sent to all tiles; an old group learns of a fresh one that is nearer than what it holds, or not at all."""
    vectors = clumps(26, 60)
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12) + 2 * np.eye(60)
    fresh = np.arange(60) < 8
    old = d.copy()
    old[:, fresh] = 2
    held = [(i, None if fresh[i] else float(old[i].min())) for i in range(60)]
    rows = C.unit_rows(frame(spark, {"s": vectors}), KEYS).withColumn("fresh", C.F.col("id") < 8)
    nodes = rows.join(spark.createDataFrame(held, "id bigint, distance double"), "id").withColumn("tie", C.F.when(~C.F.col("fresh"), C.F.lit(0).cast("bigint")))
    sizes = rows.groupBy(*KEYS).agg(C.F.count("*").alias("rows"), C.F.count_if("fresh").alias("renewed"))
    near = np.where(fresh, d.min(axis=1), np.where(d[:, fresh].min(axis=1) < old.min(axis=1), d[:, fresh].min(axis=1), 2))
    for tile_rows in (3, 1000):
        left, right = C.met_by_fresh(nodes, KEYS, tile_rows, sizes)
        tiles = max(-(-60 // tile_rows), min(16, -(-240 // tile_rows)))
        assert (left.count(), right.count()) == (8 * tiles, 60 * -(-8 // tile_rows))
        found = {r.id: r.distance for r in C.renew_partners(nodes, KEYS, 0.5, tile_rows, sizes).collect()}
        assert found.keys() == set(np.flatnonzero(near < 0.5)) and all(abs(found[i] - near[i]) < 1e-9 for i in found)


def test_a_chain_of_merges_takes_few_steps(spark):
    """One group takes up all others one by one: no two edges of this forest are lightest at both ends at once."""
    n = 300
    edges = spark.createDataFrame([("s", 0, i, i / 1000, i) for i in range(1, n)], "show string, a bigint, b bigint, distance double, tie bigint")
    rounds, taken = [], C.issue_sizes
    C.issue_sizes = lambda *a: rounds.append(1) or taken(*a)
    try:
        found = C._forest_merges(edges, KEYS, 8).collect()
    finally:
        C.issue_sizes = taken
    assert len(rounds) <= 4
    assert sorted((r.id, r.path[0].cluster, r.path[0].height) for r in found) == [(i, 0, i / 1000) for i in range(1, n)]


def test_rounds_send_no_merges_through_the_driver(spark):
    """What becomes of groups, their paths and the size of a single block meet their rows without a broadcast, however small they are."""
    rows = [("a", 1, 2, 0.1, 5), ("a", 2, 1, 0.1, 5), ("a", 3, 1, 0.2, 6)]
    best = materialize(spark.createDataFrame(rows, "k string, id long, partner long, distance double, tie long"), "best")
    planned = C._plan(best, C.mutual_pairs(best, ["k"]), ["k"])
    assert "Broadcast" not in planned._jdf.queryExecution().toString()
    assert {(r.id, r.target, r.fresh) for r in planned.collect()} == {(1, 1, True), (2, 1, True), (3, None, True)}
    links = best.filter("id = 2").select("k", "id", F.array(F.struct(F.col("partner").alias("cluster"), F.col("distance").alias("height"))).alias("path"))
    start = best.select("k", "id", F.array().cast(C.PATH).alias("path"))
    assert "Broadcast" not in C.follow(start, links, ["k"])._jdf.queryExecution().toString()


def test_sizes_of_one_block_are_literals(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, id long")
    one, two = (spark.createDataFrame([(k, 7) for k in ks], "k string, tiles long") for ks in ("a", "ab"))
    single = N.beside_sizes(rows, ["k"], one)
    assert "Join" not in single._jdf.queryExecution().toString()
    assert sorted((r.id, r.tiles) for r in single.collect()) == [(1, 7), (2, 7)]
    assert sorted((r.id, r.tiles) for r in N.beside_sizes(rows, ["k"], two).collect()) == [(1, 7), (2, 7), (4, 7)]


def test_pairs_of_copies_are_all_listed(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 4)
    vectors = np.r_[clumps(4, 12), np.repeat(clumps(5, 2), 11, axis=0)]
    ids = np.arange(len(vectors))
    ids[14] = 13  # an id that comes twice with one vector
    ids[33] = 12  # and one that comes with two vectors
    rows = [("s", int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame([*rows, ("s", None, rows[0][2])], "show string, seq bigint, embedding array<double>")
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.argwhere(np.triu(1 - u @ u.T < 0.4, 1))
    expected = sorted((min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in near if ids[a] != ids[b])
    members = C.copy_groups(df, KEYS)
    found = C.expand_pairs(C.similarity_join(df, KEYS, 0.4, members=members), members, KEYS).collect()
    assert sorted((r.id, r.partner) for r in found) == expected
    assert not any(np.signbit(r.distance) for r in found)


def test_query_similarity_join_has_every_pair(spark, tmp_path):
    from bindings.queries import QUERIES

    u = clumps(6, 9)
    u[5:] = u[4]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(u)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expected = sorted(map(tuple, np.argwhere(np.triu(1 - u @ u.T < 0.75, 1))))
    assert sorted((r.id, r.partner) for r in QUERIES["similarity_join"](spark, str(tmp_path)).collect()) == expected


def test_components_in_a_task_equal_those_in_rounds(spark):
    from storyline.operators.components import connected_components

    rng = np.random.default_rng(8)
    nodes = [(s, int(i)) for s in ("s", "t") for i in range(300)]
    edges = [(s, int(a), int(b)) for s in ("s", "t") for a, b in np.r_[rng.integers(0, 300, (120, 2)), [[7, 7]], np.c_[200:240, 201:241]]]
    nodes, edges = spark.createDataFrame(nodes, "show string, id bigint"), spark.createDataFrame(edges, "show string, a bigint, b bigint")
    for keys, n, e in ((["show"], nodes, edges), ([], nodes.filter("show = 's'"), edges.filter("show = 's'"))):
        one, many = (sorted(map(tuple, connected_components(n, e, keys, most).collect())) for most in (1000, 0))
        assert one == many and len(one) == n.count()
