from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from storyline.llm import packing as P
from storyline.llm.queries import op9_packing
from tests.llm.fixtures import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def check(rows, texts, length=2048):
    """Every id in exactly one piece, sequences without gaps. ``texts`` by id, one row each."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for key, found in pieces.items():
        ids = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in sequences.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at and size > 0
            at += size
        assert at <= length
    return len(sequences)


def test_query_packs_all_ids(spark):
    texts = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_packing(spark, SF).collect()
    sequences = check(rows, texts)
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * (sequences - 1)


def test_odd_rows(spark, monkeypatch):
    from storyline.llm.queries import piece_digests

    docs = odd_docs(spark).filter("doc_id is not null or text is not null").dropDuplicates(["doc_id", "text"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    monkeypatch.setattr(P, "BLOCK", 3000)  # many solved parts
    for length in (2048, 128):
        check(piece_digests(P.pack(docs.select("doc_id", "text", "doc", "row"), length)).collect(), texts, length)
    repeated = piece_digests(P.pack(odd_docs(spark))).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in repeated} == texts.keys()
    assert P.pack(no_docs(spark)).count() == 0


def test_cuts_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 11))])
        cost = rng.choice([0.0, 2.0, 7.0], len(at))
        cost[0] = 0
        found = P.choose_cuts(at, cost, 16)
        price = lambda cuts: sum(16 - (b - a) for a, b in itertools.pairwise(cuts)) + sum(cost[np.searchsorted(at, c)] for c in cuts[1:])
        every = (
            [0, *at[1:-1][list(keep)], at[-1]]
            for keep in (np.flatnonzero([m >> k & 1 for k in range(len(at) - 2)]) for m in range(1 << (len(at) - 2)))
        )
        best = min(price(c) for c in every if max(np.diff(c)) <= 16)
        assert max(np.diff(found)) <= 16 and price(found) == best


def test_pieces_give_the_ids_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = P.Encoder()
    for text in ["", " ", "a", " a", "a ", "a  b", "a \n b", "it's 's 'S", "x y z　 w", "1 23\t4", "né à\r\nß   q", "a <|endoftext|> b", "...  !? \x1c x", "\n\nfoo bar.\n\nBaz. "]:
        for _ in range(2):  # the second time from the cache
            found = np.frombuffer(encoder.encode(text)[0], "<u4").tolist()
            assert found == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_sentence_ends_are_places_between_tokens():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = P.Encoder()
    for parts in (
        ["One ends.\n", "Two here"],
        ['He said "no."', " Then left"],
        ["你好。", "世界！", "好"],
        ["a <|x|> One ends.", " Two\n", "Three"],
        ["One.", "  Two...", " three\n\n", "Four 1.5 or x.y"],
        ["Été fini…", " Ñandú?»", " Fin."],
        ["no end"],
        [""],
    ):
        ids, ends = encoder.encode("".join(parts))
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == library.encode("".join(parts), add_special_tokens=False).ids
        cuts = [0, *ends.tolist(), len(ids)]
        assert [library.decode(ids[a:b], skip_special_tokens=False) for a, b in itertools.pairwise(cuts)] == parts
