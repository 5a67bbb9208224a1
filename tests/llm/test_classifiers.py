from __future__ import annotations

import zlib

import numpy as np

from storyline.llm import language as L
from storyline.llm import toxicity as T
from storyline.llm.queries import op5_toxicity, op10_language
from tests.llm.fixtures import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def fold(key):
    return zlib.crc32(str(key).encode()) % 3


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_language(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (fold(r["doc_id"]) == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and truth[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) > 0.98 * len(out)


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    model = L.train(docs)
    rows = L.identify(docs, model).select("doc.*", "lang_pred", L.F.col("score").alias("given")).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {"own score"}
    for r in rows:
        assert (r["lang_pred"] == "und") == (not L.has_letter(r["text"]))
        assert 0 <= r["given"] <= 1
    assert L.train(no_docs(spark)) is None
    assert {r["lang_pred"] for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(no_docs(spark), model).count() == 0


def test_language_learns_every_language(spark):
    """None of 90 languages is left out, also not those with fewer rows."""
    pick = np.random.default_rng(4)
    words = {f"l{k:02}": ["".join(chr(97 + c) for c in pick.integers(0, 26, 5)) for _ in range(12)] for k in range(90)}
    rows = []
    for k, (lang, own) in enumerate(words.items()):
        rows += [(1000 * k + i, " ".join(pick.choice(own, 20)), lang) for i in range(20 if k < 64 else 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = L.train(docs, (docs.doc_id % 5) != 0)
    assert model.languages == sorted(words) and len(model.landmarks) == 4 * 90
    found = L.identify(docs.filter("doc_id % 5 = 0"), model).select("doc.lang", "lang_pred").collect()
    assert len({r["lang"] for r in found}) == 90 and all(r["lang"] == r["lang_pred"] for r in found)


def test_presence_does_not_depend_on_blocks(monkeypatch):
    text = "The quick brown fox — über Straßen, 12 times"
    whole = L.presence(text)
    monkeypatch.setattr(L, "POINTS_AT_ONCE", 5)
    assert (L.presence(text) == whole).all()
    assert not L.presence("").any() and L.presence("x").sum() >= 1


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r["held_out"] == (fold(r["doc_id"]) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    out = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for p, t in out if t == 1], [p for p, t in out if t == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03


def test_machine_learns_pairs():
    """Neither term tells the class alone: toxic if both or neither of two terms are there."""
    rng = np.random.default_rng(0)
    lists, labels = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        lists.append(np.array(sorted(({1} if a else set()) | ({2} if b else set()) | {int(x) for x in rng.integers(10, 30, 3)})))
        labels.append(int(a and b))
    machine = T.fit(lists, labels)
    score = machine.score([np.array([1]), np.array([2]), np.array([1, 2]), np.array([], np.int64)])
    assert score[2] > T.TOXIC_FROM > max(score[0], score[1], score[3])
    assert np.abs(machine.factors).max() > 0.1


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1), (2, 1), (3, 1), (5, 0), (6, 0), (12, 0), (None, 1), (8, None), (8, 0), (8, 1), (99, 1)], "doc_id bigint, toxic int")
    for given in (labels, labels.filter("toxic = 1"), labels.filter("doc_id = -1")):
        machine = T.train(docs, given)
        rows = T.score(docs, machine).select("doc.*", T.F.col("score").alias("given")).collect()
        assert len(rows) == docs.count() and all(0 < r["given"] < 1 for r in rows)
        assert {r["score"] for r in rows} == {"own score"}
        assert T.score(no_docs(spark), machine).count() == 0


def test_toxicity_learns_from_long_texts(spark):
    """Toxic texts of over 20,000 terms each are in the fit."""
    rng = np.random.default_rng(2)
    long = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (9000, 8))) for _ in range(24)]
    rows = [(k, t + " vile", 1) for k, t in enumerate(long)] + [(100 + k, f"kind words {k}", 0) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    hashes = T.WordHashes()
    assert len(T.terms(long[0], hashes)) > 20_000
    assert (T.unpacked(T.packed(T.terms(long[0], hashes))) == T.terms(long[0], hashes)).all()
    machine = T.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    vile, kind = machine.score([T.terms("vile", hashes), T.terms("kind words", hashes)])
    assert np.isin(T.terms("vile", hashes), machine.bins).all() and vile > kind
