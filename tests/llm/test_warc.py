from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from storyline.llm import warc as W
from storyline.llm.queries import op4_warc_fixity

SF = "/root/testdata/sf0.001"


def test_query_finds_exactly_the_damage(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op4_warc_fixity(spark, SF).collect()
    assert len(rows) == len(pages)
    end = 0
    for r in sorted(rows, key=lambda r: (r["file"], r["offset"])):
        page = pages[r["page_id"]]
        body = page["html"].encode()
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {page['url']}\r\nWARC-Record-ID: <urn:page:{page['page_id']}>\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
        record = head.encode() + body + b"\r\n\r\n"
        assert (r["length"], r["sha256"]) == (len(record), hashlib.sha256(record).hexdigest())
        assert r["offset"] == (end if r["offset"] else 0)
        end = r["offset"] + r["length"]
        lost, spoiled = r["page_id"] % 211 == 9, r["page_id"] % 101 == 7
        assert r["status"] == ("missing" if lost else "corrupt" if spoiled else "sound")


def test_odd_pages_and_tall_trees(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, None, None), (2, "", ""), (3, "u", "y" * 300_000)] + [(k, f"u{k}", f"page {k}") for k in range(10, 400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    records = W.materialize(W.archive(pages, file_bytes=2000, records=True), "records")
    assert records.count() == len(rows)
    assert records.filter(F.sha2("record", 256) != F.col("sha256")).count() == 0
    tree = W.merkle(records)
    top = tree.agg(F.max("level")).first()[0]
    assert top > W.OFFSET_LEVELS + 1 and tree.filter(F.col("level") == top).count() == 1
    assert W.audit(tree, tree).count() == 0
    odd = records.withColumn("bad", F.xxhash64("file", "offset") % 37)
    replica = odd.filter("bad != 1").withColumn("sha256", F.when(F.col("bad") == 2, F.lit("spoiled")).otherwise(F.col("sha256")))
    extra = spark.createDataFrame([(0, 1 << 30, "new")], "file bigint, offset bigint, sha256 string")
    found = W.audit(tree, W.merkle(replica.select("file", "offset", "sha256").unionByName(extra)))
    expected = {(r["file"], r["offset"], "missing" if r["bad"] == 1 else "corrupt") for r in odd.filter("bad in (1, 2)").collect()}
    assert {tuple(r) for r in found.collect()} == expected | {(0, 1 << 30, "extra")}
    nothing = W.merkle(records.filter("file = -1"))
    assert W.audit(nothing, nothing).count() == 0
    assert W.audit(tree, nothing).count() == len(rows)
    assert W.archive(pages.filter("page_id = -1")).count() == 0
