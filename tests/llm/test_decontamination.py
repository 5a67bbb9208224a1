from __future__ import annotations

import re

from storyline.llm import decontamination as D
from storyline.llm.queries import op1_decontamination
from tests.llm.fixtures import no_docs, odd_docs, odd_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add(str(item) if item is not None else "")
    widths = {len(w) for w in windows}
    found = []
    for text in docs:
        words = WORD.findall(lower(text))
        hit, seen = set(), set()
        for width in widths:
            for i in range(len(words) - width + 1):
                for item in windows.get(tuple(words[i : i + width]), ()):
                    hit.update(range(i, i + width))
                    seen.add(item)
        found.append((len(words), len(hit), sorted(seen)))
    return found


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {d["doc_id"]: e for d, e in zip(docs, brute([d["text"] for d in docs], items))}
    rows = op1_decontamination(spark, SF).collect()
    assert len(rows) == len(docs)
    import hashlib

    for r in rows:
        words, hits, seen = expected[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (words, hits, len(seen))
        assert r["items_sha256"] == hashlib.sha256(",".join(seen).encode()).hexdigest()
        assert r["contaminated"] == (hits > 0 and 20 * hits >= words)
    assert any(r["contaminated"] for r in rows)


def test_odd_rows_and_parts(spark):
    items = [(1, sentence(3, 30)), (2, "two THREE"), (2, "two THREE"), (3, None), (4, "..."), (None, sentence(1, 14)), (5, sentence(1, 13))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(map(repr, brute([r[1] for r in odd_rows()], items)))
    for part_bytes in (D.PART_BYTES, 200):
        found = D.find_hits(odd_docs(spark), benchmark, part_bytes=part_bytes).select("words", D.hit_words().alias("hit"), "items", "text", "places", "doc.*")
        rows = found.drop("words", "items").collect() and D.find_hits(odd_docs(spark), benchmark, part_bytes=part_bytes).select(
            "words", D.hit_words().alias("hit"), "items", "text", "places"
        ).collect()
        assert sorted(repr((r["words"], r["hit"], r["items"])) for r in rows) == expected
        for r in rows:  # places lead back to the original text
            taken = b" ".join(r["text"].encode()[p["start"] : p["end"]] for p in r["places"]) if r["text"] else b""
            if part_bytes == D.PART_BYTES:
                assert len(WORD.findall(lower(taken.decode()))) == r["hit"]
    kept = D.decontaminate(odd_docs(spark), benchmark)
    assert kept.columns == odd_docs(spark).columns
    assert {r["words"] for r in kept.collect()} == {"own words"}
    assert D.decontaminate(no_docs(spark), benchmark).count() == 0
    nothing = benchmark.filter("item_id = -1")
    assert D.decontaminate(odd_docs(spark), nothing).count() == len(odd_rows())
