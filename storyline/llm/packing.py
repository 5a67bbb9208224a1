"""Order-preserving packing of tokenised documents into sequences of a fixed length.

Each task takes its documents in order, as one stream of tokens, and chooses where sequences end: after a document, after a
sentence, or at a token every ``GRID`` tokens. A dynamic programme minimises padding plus a penalty for each document that is
cut; the best earlier cut within one sequence length comes from a monotone queue, so the work is linear in the cuts.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LENGTH = 2048
END_ID = 1
#: Tokens between cuts that are allowed inside a sentence.
GRID = 64
#: What cutting a document costs, in tokens of padding: after a sentence, and inside one.
CUT_SENTENCE, CUT_INSIDE = 12.0, 48.0
#: Tokens a task collects before it solves a part of its stream.
BLOCK = 1 << 20
#: Entries of the cache of encoded pieces.
CACHE_PIECES = 1 << 18


#: A mark that ends a sentence, or a line break, with the closing quotes and brackets after it.
MARKS = re.compile("[.!?\u2026\u3002\uff01\uff1f\n][\"'\u201d\u2019\u00bb)\\]\u300d\u300f]*")
#: Of these, the marks that need no white space after them.
ALONE = "\u3002\uff01\uff1f"


def sentence_ends(text: str) -> list[int]:
    """Character offsets inside a text at which a sentence or a block of lines has ended.

    A mark counts, after its closing quotes, if a space follows (the space begins the next sentence); a line break counts if text
    follows, and then stands for a mark before it; marks of scripts without spaces always count.
    """
    found = []
    for m in MARKS.finditer(text):
        mark, after = text[m.start()], text[m.end() : m.end() + 1]
        if mark == "\n":
            after = text[m.start() + 1 : m.start() + 2]
            if after and not after.isspace():
                found.append(m.start() + 1)
        elif after and (mark in ALONE or (after.isspace() and after != "\n")):
            found.append(m.end())
    return found


class Irregular(Exception):
    """A text where some space has white space beside it, so that pieces aren't independent."""


class Encoder(dict):
    """Token ids of texts as little-endian 32-bit words.

    The tokenizer splits a text before each space that stands between two other characters, and encodes the pieces apart;
    so a piece's ids are kept and used again. The ids are those of the ``tokenizers`` library for the same vocabulary.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        super().__init__()
        pairs = map(bytes.split, open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.path = public_tokenizers.path(f"{vocabulary}.json")
        self.whole: Tokenizer | None = None

    def ids(self, piece: str) -> bytes:
        return np.array(self.coder.encode_ordinary(piece), "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece.strip() != piece:
            raise Irregular
        found = self.ids(" " + piece)
        if len(self) < CACHE_PIECES:
            self[piece] = found
        return found

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids of the text, and where sentences end, counted in tokens."""
        if "<|" in text:  # may hold the string of a special token, which the library takes as one id
            if self.whole is None:
                self.whole = Tokenizer.from_file(self.path)
            coded = self.whole.encode(text, add_special_tokens=False)
            stops = np.array([stop for _, stop in coded.offsets], np.int64)
            ends = np.array(sentence_ends(text), np.int64)
            place = np.searchsorted(stops, ends, "right")
            return np.array(coded.ids, "<u4").tobytes(), place[(place > 0) & (stops[place - 1] == ends)]
        if not text:
            return b"", np.zeros(0, np.int64)
        pieces = text.split(" ")
        try:
            if not pieces[0] or pieces[0].strip() != pieces[0]:
                raise Irregular
            parts = [self.ids(pieces[0]), *map(self.__getitem__, pieces[1:])]
        except Irregular:
            pieces = re.split(r"(?<=\S) (?=\S)", text)
            parts = [self.ids(pieces[0]), *(self.ids(" " + p) for p in pieces[1:])]
        ids = b"".join(parts)
        ends = np.array(sentence_ends(text), np.int64)
        if len(ends) and not text.isascii():
            data = np.frombuffer(text.encode(), np.uint8)
            ends = np.flatnonzero((data & 0xC0) != 0x80)[ends]  # first bytes of characters
        reached = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])  # tokens stand for the bytes of the text, none left out
        place = np.searchsorted(reached, ends)
        return ids, place[reached[place] == ends] + 1


def cut_points(lengths: np.ndarray, sentences: list[np.ndarray], grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, and what each costs. ``lengths``: tokens of each document in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    cost = np.full(total + 1, np.inf)
    cost[::grid] = CUT_INSIDE
    for end, length, found in zip(ends, lengths, sentences):
        cost[end - length + found] = CUT_SENTENCE
    cost[0] = 0
    cost[ends] = 0
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def choose_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """The chosen places, from the first to the last, at most ``length`` apart, with the least padding plus costs.

    The last sequence's padding counts like others'.
    """
    places, costs = at.tolist(), cost.tolist()
    best = [0.0] * len(places)
    back = [0] * len(places)
    queue: deque[tuple[float, int]] = deque()  # (best + place) rises from the front, so the front is the window's least
    first = 0
    for j in range(1, len(places)):
        i = j - 1
        value = best[i] + places[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
        low = places[j] - length
        while places[queue[0][1]] < low:
            queue.popleft()
        value, first = queue[0]
        best[j] = value - low + costs[j]
        back[j] = first
    chosen, j = [len(places) - 1], len(places) - 1
    while j > 0:
        j = back[j]
        chosen.append(j)
    return [places[k] for k in reversed(chosen)]


class Packer:
    """Packs one task's documents; yields pieces ``(document, start, length, doc_tokens, sequence, offset, ids)``."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length = first_sequence, length
        # Documents not fully packed: number, ids, sentence ends, tokens packed before.
        self.waiting: list[tuple[int, bytes, np.ndarray, int]] = []
        self.tokens = 0

    def add(self, number: int, ids: bytes, sentences: np.ndarray) -> None:
        self.waiting.append((number, ids, sentences, 0))
        self.tokens += len(ids) // 4

    def solve(self, last: bool) -> Iterator[tuple]:
        """Pack what waits. Unless it is the last call, the final sequence stays open and its tokens wait on."""
        if not self.waiting:
            return
        lengths = np.array([len(ids) // 4 - done for _, ids, _, done in self.waiting])
        ahead = [found[found > done] - done for _, _, found, done in self.waiting]
        cuts = choose_cuts(*cut_points(lengths, ahead), self.length)
        closed = cuts if last or len(cuts) < 3 else cuts[:-1]
        document, used, rest = 0, 0, []
        for start, end in zip(closed[:-1], closed[1:]):
            offset = 0
            while offset < end - start:
                number, ids, _, done = self.waiting[document]
                take = min(end - start - offset, int(lengths[document]) - used)
                begin = done + used
                yield number, begin, take, len(ids) // 4, self.sequence, offset, ids[4 * begin : 4 * (begin + take)]
                offset += take
                used += take
                if used == lengths[document]:
                    document, used = document + 1, 0
            self.sequence += 1
        for k in range(document, len(self.waiting)):
            number, ids, found, done = self.waiting[k]
            rest.append((number, ids, found, done + (used if k == document else 0)))
        self.waiting = rest
        self.tokens = sum(len(ids) // 4 - done for _, ids, _, done in rest)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: ``doc`` (the row without its text), place in the document, sequence, place in it, ids.

    Each document is its ids and ``end_id``; a null or empty text is that id alone. Every id is in exactly one piece. Documents
    stay in their task and order: nothing is shuffled, and a task holds about ``BLOCK`` tokens. Equal or repeated rows are
    packed like others. ``ids`` are little-endian unsigned 32-bit words. A sequence shorter than ``length`` is to be padded.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col("text").alias("text"))
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = rows.select("doc", *[F.lit(0).cast("bigint").alias(n) for n in names], F.lit(b"").alias("ids")).schema
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, length)
        kept: pa.Table | None = None  # rows whose documents wait, so that piece numbers can be rows of it
        first = 0  # number of its first row

        def made(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal kept, first
            for low in range(0, len(pieces), 2048):
                part = list(zip(*pieces[low : low + 2048]))
                docs_ = kept["doc"].combine_chunks().take(pa.array(np.array(part[0]) - first))
                docs_ = docs_.combine_chunks() if isinstance(docs_, pa.ChunkedArray) else docs_
                columns = [pa.array(part[k], pa.int64()) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays([docs_, *columns, pa.array(part[6], pa.binary())], ["doc", *names, "ids"])
            begin = packer.waiting[0][0] if packer.waiting else first + kept.num_rows
            kept, first = kept.slice(begin - first), begin

        number = 0
        for batch in batches:
            part = pa.table({"doc": batch["doc"]})
            kept = part if kept is None else pa.concat_tables([kept, part])
            for text in batch["text"]:
                ids, sentences = encoder.encode(text.as_py() or "")
                packer.add(number, ids + end, sentences)
                number += 1
                if packer.tokens >= BLOCK:
                    yield from made(list(packer.solve(False)))
        if kept is not None and packer.waiting:
            yield from made(list(packer.solve(True)))

    return rows.mapInArrow(run, schema)
