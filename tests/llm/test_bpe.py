from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storyline.llm import bpe, queries
from tests.llm.fixtures import no_docs, odd_docs

PATH = public_tokenizers.path(bpe.VOCABULARY)
PARTS = [
    "a", "b", "E", "Z", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "É", "é", "́", "Σ", "ß", "İ", "ﬁ", "1", "2", "٣", "½",
    "'s", "'ll", "'", "!", "?!", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "ж", "中", "日本", "\U0001f600", "​", "K", "\x00",
    "\x7f", "한", "ᄒ", "ᅡ", "क", "्", "the", "ing", "qzxj",
]


@pytest.fixture(scope="module")
def both():
    return bpe.Coder(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    coder, library = both
    ids = coder.encode([text])[0]
    wanted = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == wanted, text[:80]
    assert coder.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_random_texts_equal_the_library(both):
    pick = random.Random(3)
    for _ in range(4000):
        same(both, "".join(pick.choice(PARTS) for _ in range(pick.randrange(16))))


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "!" * 2000, "the" * 1000, "é" * 1500, "<|endoftext|>" * 300, "1" * 500, ""])
def test_long_words(both, text):
    same(both, text)


def test_heap_and_scan_merge_alike(both):
    pick = random.Random(4)
    coder = both[0]
    for _ in range(300):
        ids = [coder.single[ord(pick.choice("theandig"))] for _ in range(pick.randrange(2, 48))]
        assert coder.merge(ids) == coder.merge_long(ids)


def test_no_token_spans_a_cut(both):
    coder = both[0]
    words = [b"wqzxjkvq", b"caf\xc3\xa9", b"rhythm"]
    found = coder.fragments_of(words)
    assert [b"".join(parts) for parts in found] == [w + bpe.WORD_END for w in words]
    assert any(len(parts) > 1 for parts in found)
    for parts in found:
        for left, right in zip(parts, parts[1:]):
            assert not coder.inside[left[-1], right[0]]


def test_full_caches_change_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHE_FRAGMENTS", 3)
    coder = bpe.Coder(PATH)
    texts = ["one two three four five", "six seven eight one two", "nine ten one"] * 3
    assert coder.encode(texts) == both[0].encode(texts)
    assert len(coder.chunks) <= 3 and len(coder.fragments) <= 3


def test_rows(spark, both):
    docs = odd_docs(spark)
    found = bpe.decode(bpe.encode(docs))
    rows = found.selectExpr("doc.*", "ids", "decoded").collect()
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert len(rows) == len(texts) and "doc" in found.select("doc.*").columns
    library = both[1]
    wanted = sorted(((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in rows), key=repr) == wanted
    assert bpe.decode(bpe.encode(no_docs(spark))).count() == 0


def test_query_equals_the_library(spark, both):
    data = "/root/testdata/sf0.001"
    library = both[1]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op12_bpe(spark, data).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
