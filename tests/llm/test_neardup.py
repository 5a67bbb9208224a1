from __future__ import annotations

import numpy as np

from storyline.llm import neardup as N


def groups(vectors, labels, cosine):
    n = len(vectors)
    good = [v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v, l in zip(vectors, labels)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    linked = [[j for j in range(n) if j != i and good[i] and good[j] and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    seen, part = {}, list(range(n))
    for i in range(n):
        if i in seen:
            continue
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen[k] = i
                stack += linked[k]
    return [len(x) for x in linked], [seen[i] for i in part]


def check(spark, ids, vectors, labels, **options):
    rows = list(zip(ids, vectors, labels))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    links, part = groups([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors], labels, N.COSINE)
    least = {}
    for i, p in zip(ids, part):
        least[p] = i if least.get(p) is None else least[p] if i is None else min(least[p], i)
    expected = sorted(repr((i, n, least[p], i == least[p])) for i, n, p in zip(ids, links, part))
    found = N.near_duplicates(df, **options).collect()
    assert sorted(repr((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in found) == expected
    return links


def test_cells_lose_no_link(spark):
    rng = np.random.default_rng(5)
    points, labels = [], []
    for _ in range(40):  # chains and clumps around the threshold
        at = rng.normal(size=8)
        for _ in range(8):
            points.append((at + rng.normal(scale=0.25, size=8)).tolist())
            labels.append(int(rng.integers(0, 2)))
    points += [points[0]] * 5
    labels += [labels[0]] * 5
    links = check(spark, list(range(len(points))), points, labels, cell_rows=25)
    assert sum(links) > 200


def test_odd_vectors(spark):
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None, 11]
    one = [1.0, 0.0]
    vectors = [one, [2.0, 0.01], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None], one, one, one, one, [1.0, 0.0, 0.0]]
    check(spark, ids, vectors, [0, 0, 0, 0, 0, 0, 0, None, 0, 0, 0, 0])
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert N.near_duplicates(empty).count() == 0


def test_visited_cells_hold_all_partners():
    rng = np.random.default_rng(2)
    x = N.unit(__import__("pyarrow").array(rng.normal(size=(400, 4)).tolist()))
    centres = N.centres_of(x, 12)
    home, visits = N.visited(x, centres, 0.93)
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert visits[a, home[b]].all() and not visits.all()


def test_tiles_and_blocks_of_products_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_BYTES", 8 * 8 * 12)
    monkeypatch.setattr(N, "PRODUCTS", 20)
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=8) + rng.normal(scale=s, size=(30, 8)) for s in (0.3, 0.2, 0.01)]).tolist()
    assert sum(check(spark, list(range(90)), points, [0] * 90, cell_rows=20)) > 200


def test_a_vector_is_sent_to_few_tiles(spark, monkeypatch):
    """Without structure a vector was copied to every cell, and there to every tile."""
    moved = []
    monkeypatch.setattr(N, "materialize", lambda df, name, do=N.materialize: moved.append((name, do(df, name))) or moved[-1][1])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(1).normal(size=(3000, 16)))]
    N.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), cell_rows=50)
    written = dict(moved)
    assert written["cells"].count() == 3000
    assert max(len(r["visits"]) for r in written["cells"].collect()) <= N.MOST_CELLS
