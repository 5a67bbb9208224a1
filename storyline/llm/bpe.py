"""Byte-pair encoding and decoding with forced boundaries.

Two bytes that stand side by side inside no token of the vocabulary never end up in one token, so between them there is a cut, whatever
surrounds them. A table of 256 x 256 pairs marks the cuts of a whole buffer of words at once. Each fragment between cuts is
encoded by itself, remembered, and the fragments' ids are put together. Ids are those of the ``tokenizers`` library for
the same file; its normaliser and splitter take the chunks that are not plain ASCII.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Entries of a task's cache of chunks (what stands between spaces) and of fragments. Frequent ones come early, so a full cache stays
#: as it is. Longer ones than ``CACHED_BYTES`` are not kept.
CACHE_CHUNKS, CACHE_FRAGMENTS, CACHED_BYTES = 1 << 18, 1 << 18, 64
#: A fragment of more symbols is merged with a heap.
SCANNED = 48
#: Texts that are encoded or decoded at a time.
TEXTS_AT_ONCE = 64

#: How the vocabulary's splitter takes ASCII text, in lower case (a fixed value of the vocabulary).
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
#: Stands behind the last fragment of a word; no UTF-8 text has this byte.
WORD_END = b"\xff"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Coder:
    """Encoder and decoder of one vocabulary file of the kind BPE with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for name, number in [*vocabulary.items(), *self.special.items()]:
            self.names[number] = name
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(symbols)}
        self.single = [vocabulary[c] for c in symbols]
        self.last = [vocabulary[c + suffix] for c in symbols]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.inside = np.zeros((256, 256), bool)
        for name in vocabulary:
            found = [self.bytes_of[c] for c in name.removesuffix(suffix)]
            self.inside[found[:-1], found[1:]] = True
        self.library = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}

    def words(self, text: str) -> list[bytes]:
        """The normalised words of a chunk without special tokens, as bytes."""
        if text.isascii():
            lowered = text.lower()
            return [lowered.encode()] if text.isalpha() else [w.encode() for w in ASCII_WORDS.findall(lowered)]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in found]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of the least rank, the leftmost of equal ones, until no pair is in the table."""
        if len(ids) > SCANNED:
            return self.merge_long(ids)
        known, none = self.merges.get, (len(self.merges), 0)
        ids = list(ids)
        pairs = [known(pair, none) for pair in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = known((ids[at - 1], ids[at]), none)
            if at < len(pairs):
                pairs[at] = known((ids[at], ids[at + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """As :meth:`merge`, by a heap of pairs over a linked list."""
        ids = list(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.merges[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.merges]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            found = self.merges.get((ids[i], ids[j]))
            if found is not None:
                heapq.heappush(heap, (*found, i, ids[i], ids[j]))

        while heap:
            _, made, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue  # one of the two was merged since
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def fragment(self, data: bytes) -> bytes:
        """Ids of a fragment; a ``WORD_END`` at its end says that the word ends there."""
        found = self.fragments.get(data)
        if found is None:
            if data.endswith(WORD_END):
                ids = [*map(self.single.__getitem__, data[:-2]), self.last[data[-2]]]
            else:
                ids = list(map(self.single.__getitem__, data))
            ids = self.merge(ids)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) <= CACHED_BYTES and len(self.fragments) < CACHE_FRAGMENTS:
                self.fragments[data] = found
        return found

    def fragments_of(self, words: list[bytes]) -> list[list[bytes]]:
        """The fragments of each word. All words lie in one buffer, whose cuts are found at once."""
        data = WORD_END.join([*words, b""])
        values = np.frombuffer(data, np.uint8)
        cut = ~self.inside[values[:-1], values[1:]] & (values[1:] != WORD_END[0])
        cuts = np.flatnonzero(cut) + 1
        edges = np.concatenate([[0], cuts, [len(data)]]).tolist()
        parts = [data[a:b] for a, b in zip(edges, edges[1:])]
        found: list[list[bytes]] = [[]]
        for part in parts:
            found[-1].append(part)
            if part.endswith(WORD_END):
                found.append([])
        return found[:-1]

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks. A special token's string in a text is that token, before anything else."""
        words: list[bytes] = []
        plan: list[list[int | slice]] = []
        for chunk in chunks:
            steps: list[int | slice] = []
            for part in self.split_special.split(chunk) if "<|" in chunk else [chunk]:
                if part in self.special:
                    steps.append(self.special[part])
                else:
                    found = self.words(part)
                    steps.append(slice(len(words), len(words) + len(found)))
                    words += found
            plan.append(steps)
        coded = [b"".join(map(self.fragment, parts)) for parts in self.fragments_of(words)] if words else []
        ids = [b"".join([struct.pack("<I", s) if isinstance(s, int) else b"".join(coded[s]) for s in steps]) for steps in plan]
        return dict(zip(chunks, ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit words. No word and no special token spans a space."""
        for space in "\t\n\x0b\x0c\r":
            texts = [t.replace(space, " ") for t in texts]
        split = [t.split(" ") for t in texts]
        new = self.learn([c for c in set().union(*split) if c not in self.chunks])
        self.chunks.update(new)
        found = [b"".join(map(self.chunks.__getitem__, parts)) for parts in split]
        full = len(self.chunks) > CACHE_CHUNKS
        for chunk in new:
            if full or len(chunk) > CACHED_BYTES:
                del self.chunks[chunk]
        return found

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with spaces between them: the file names no other way back."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``doc`` (the row without its text) and ``ids``, little-endian unsigned 32-bit token ids of the whole text.

    A null or empty text has no ids; equal and repeated rows are encoded each. Rows stay in their task and order.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(public_tokenizers.path(vocabulary))
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(low, TEXTS_AT_ONCE)
                ids = coder.encode([t or "" for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(ids, pa.binary())], ["doc", "ids"])

    return rows.mapInArrow(run, rows.select("doc", F.lit(b"").alias("ids")).schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``decoded`` to ``doc, ids``. Null ids decode to nothing, as none do; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(public_tokenizers.path(vocabulary))
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(low, TEXTS_AT_ONCE)
                texts = [coder.decode(i or b"") for i in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc"], part["ids"], pa.array(texts, pa.string())], ["doc", "ids", "decoded"])

    rows = encoded.select("doc", "ids")
    return rows.mapInArrow(run, rows.select("doc", "ids", F.lit("").alias("decoded")).schema)
