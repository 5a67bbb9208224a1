from __future__ import annotations

import zlib

import numpy as np

from storyline.llm import sharding as S
from storyline.llm.queries import op6_sharding
from tests.llm.fixtures import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def check(rows, texts, shards=8):
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, (i for i, _ in texts)))
    expected = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in texts)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == expected
    slots: dict = {}
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query_balances_bytes_and_keeps_groups(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op6_sharding(spark, SF).collect()
    check(rows, docs)
    text, homes = dict(docs), {}
    for r in rows:
        homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert max(map(len, homes.values())) == 1
    for column in ("size", "tokens"):
        sums = np.bincount([r["shard"] for r in rows], [r[column] for r in rows], 8)
        assert sums.max() < 1.02 * sums.mean() and sums.min() > 0.98 * sums.mean()


def test_odd_rows_and_a_hot_group(spark):
    docs = odd_docs(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = S.shard(docs).select("row.doc_id", "row.score", "size", "text_crc32", "shard", "slot").collect()
    check(rows, texts)
    assert {r["score"] for r in rows} == {"own score"}
    assert S.shard(no_docs(spark)).count() == 0
    hot = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'same text', concat('text ', id)) AS text").repartition(5)
    rows = S.shard(hot, units=64).select("row.doc_id", "size", "text_crc32", "shard", "slot").collect()
    check(rows, [(k, "same text" if k % 2 == 0 else f"text {k}") for k in range(3000)])
    sums = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 8)
    assert sums.max() < 1.1 * sums.mean()


def test_place_takes_the_most_fitting_shard():
    vectors = np.array([[4.0, 0], [0, 4], [3, 1], [1, 3]])
    found = S.place(vectors, 2)
    for k in range(2):
        assert vectors[found == k].sum(axis=0).max() <= 5
    assert len(S.place(np.zeros((0, 3)), 8)) == 0
