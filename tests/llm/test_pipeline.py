from __future__ import annotations

import numpy as np

import corpus_pipeline as C
from storyline.llm import decontamination, language, packing, toxicity
from storyline.llm.common import WordHashes, text_remainder
from storyline.session import materialize
from tests.llm.fixtures import no_docs, odd_docs
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_ngramjoin import brute as brute_join
from tests.llm.test_packing import check as check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = text_remainder("doc_id", 3) != 1
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [name for name, _ in C.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    now = docs
    for name, stage in C.STAGES[:-1]:
        before = dict(rows)
        if name == "language":
            keep = {i for i, r in before.items() if language.has_letter(r["text"])}
        elif name == "toxicity":
            machine, hashes = toxicity.train(now.select("doc_id", "text"), labels, fold), WordHashes()
            keep = {i for i, r in before.items() if machine.score([toxicity.terms(r["text"], hashes)])[0] < toxicity.TOXIC_FROM}
        elif name == "near_duplicates":
            ids = list(before)
            keep = {i for i, _, least in brute_join(ids, [before[i]["text"] for i in ids])[0] if i == least}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            ids = list(before)
            hits = brute_hits([before[i]["text"] for i in ids], items)
            keep = {i for i, (n, hit, _) in zip(ids, hits) if not (hit > 0 and 20 * hit >= n)}
        now = materialize(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        rows = {r["doc_id"]: r for r in now.collect()}
        assert rows.keys() == keep and all(rows[i] == before[i] for i in keep)
        assert len(rows) >= 0.6 * len(before) and (name in ("language", "toxicity") or len(rows) < len(before))
    pieces = C.packed(spark, now, SF).collect()
    check_pieces(pieces, {i: r["text"] for i, r in rows.items()})
    assert {r["doc_id"] for r in C.run(spark, SF).select("doc_id").distinct().collect()} == set(rows)


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        now = docs
        for name, stage in C.STAGES:
            now = materialize(stage(spark, now, SF), name)
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() > 0) == (docs.count() > 0)
    assert np.isfinite(packing.LENGTH) and decontamination.ONE_IN == 20
