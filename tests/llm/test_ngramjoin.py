from __future__ import annotations

import random

import numpy as np
import pytest

from storyline.llm import ngramjoin as J
from storyline.llm.common import WORD_BYTES
from tests.llm.fixtures import no_docs, odd_docs, odd_rows, sentence


def sets_of(texts):
    found = []
    for t in texts:
        words = (t or "").encode().translate(WORD_BYTES).split()
        width = min(5, len(words))
        found.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    return found


def brute(ids, texts):
    sets, n = sets_of(texts), len(ids)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    part = [-1] * n
    for i in range(n):
        stack = [i] if part[i] < 0 else []
        while stack:
            k = stack.pop()
            if part[k] < 0:
                part[k] = i
                stack += linked[k]
    key = lambda i: (i is not None, i or 0)
    least = {p: min((ids[k] for k in range(n) if part[k] == p), key=key) for p in set(part)}
    return [(ids[i], len(linked[i]), least[part[i]]) for i in range(n)], len(least)


def near_texts():
    """Groups of near copies around the threshold, with a passage that unrelated texts share, and one large group."""
    pick, texts = random.Random(4), []
    shared = sentence(99, 55)
    for g in range(12):
        words = sentence(g, 90).split()
        for c in range(45 if g == 0 else 4):
            own = list(words)
            for _ in range(pick.randrange(0, 5)):
                own[pick.randrange(len(own))] = f"new{pick.randrange(10**6)}"
            texts.append(" ".join(own) + (" " + shared if g % 3 == 1 and c % 2 else ""))
    return texts


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "NODE_TILE", 8)  # so that nodes and groups are cut into tiles
    texts = near_texts() + [r[1] for r in odd_rows()]
    ids = [*range(100, 100 + len(texts) - len(odd_rows())), *[r[0] for r in odd_rows()]]
    expected, classes = brute(ids, texts)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(4)
    rows = J.join(df).collect()
    assert sorted(map(repr, [(r["doc_id"], r["n_links"], r["class_id"]) for r in rows])) == sorted(map(repr, expected))
    assert sum(r["kept"] for r in rows) == classes


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    docs = odd_docs(spark)
    kept = J.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r["kept"] for r in rows} == {"own kept"}
    # Of texts 0, 1, 1, 2 (near) one stays, of 6 and 7, and of 8 and 9 (equal words); the others are alone.
    assert sorted(map(repr, [r["doc_id"] for r in rows])) == sorted(map(repr, [0, 3, 4, 5, 6, 8, None, None, 10, 11, 12]))
    assert J.deduplicate(no_docs(spark)).count() == 0


def test_prefixes_are_shortened_until_recall():
    assert J.depth_for() == 4
    assert J.depth_for(recall=0.5) > 4 and J.depth_for(similar=0.99) == J.DEEPEST
    with pytest.raises(ValueError):
        J.depth_for(trees=2)


def test_counts_of_shared_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (1, 30, 6000, 7000)]
    found = J.shared_counts(sets[:2], sets[2:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]


def test_rows_of_the_forest_are_those_with_a_neighbour(spark):
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2, (40, J.TREES * J.DEEPEST)).astype(J.PATH)
    rows = [(i, 9, m.tobytes()) for i, m in enumerate(marks)]
    chosen = spark.createDataFrame(rows, "id bigint, size bigint, marks binary").repartition(3)
    found = {(r["id"], r["tree"]): r["near"] for r in J._forest(chosen, 4).collect()}
    paths = marks.reshape(40, J.TREES, J.DEEPEST)
    for t in range(J.TREES):
        for i in range(40):
            same = np.logical_and.accumulate(paths[:, t] == paths[i, t], axis=1).sum(axis=1)
            longest = max(same[j] for j in range(40) if j != i)
            # Rows at the border of a partition may be there without need, none is missing.
            assert longest < 4 or found[i, t] >= longest
    assert len(found) < 40 * J.TREES


def test_prefixes_stay_long_only_where_the_links_found_allow_it(spark):
    seen = lambda links, weakest: spark.createDataFrame([(links, weakest)], "links bigint, weakest double")
    assert J._recalled(seen(10**9, 0.97), 6, 0.8)
    assert not J._recalled(seen(10**9, 0.82), 6, 0.8)  # weak links need shorter prefixes
    assert not J._recalled(seen(50, 0.97), 6, 0.8)  # too few links to tell
    assert not J._recalled(seen(None, None), 6, 0.8)


def test_a_pair_is_met_once(spark):
    """Over all levels and trees, each pair with a common prefix of the floor's length is verified exactly once."""
    rng = np.random.default_rng(5)
    marks = rng.integers(0, 3, (60, J.TREES * J.DEEPEST)).astype(J.PATH)
    paths = marks.reshape(60, J.TREES, J.DEEPEST).astype(np.uint16)
    every = np.arange(60)
    met = np.zeros((60, 60), int)
    for depth in range(J.DEEPEST, 3, -1):
        for t in range(J.TREES):
            table = J.pa.table({"id": every, "size": [9] * 60, "node": [t << J.NODE_BITS] * 60, "marks": [m.tobytes() for m in marks]})
            near = J._to_verify(table, every, every, depth, 0.0)
            met += 0 if near is None else near
    shared = np.logical_and.accumulate(paths[:, None] == paths[None, :], axis=3).sum(axis=3).max(axis=2) >= 4
    np.fill_diagonal(shared, False)
    assert (met == shared).all()
