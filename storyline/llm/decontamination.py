"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows scans each text once.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. A window is ``WINDOW`` consecutive
words of an item; an item of fewer words is one window. The text is normalised byte for byte, so each hit word has its
place in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import WORD_BYTES, row_with_text, slices, text_in
from storyline.session import materialize

WINDOW = 13
#: A text is contaminated if hit words are at least one in so many.
ONE_IN = 20

#: Bytes of normalised item text that one automaton takes. Its tries hold up to ``WINDOW`` times as much, some 40 bytes a node,
#: so a task stays within a few hundred MB. A larger benchmark is cut into parts, and the texts are scanned once per part.
PART_BYTES = 1 << 19


def item_windows(text: str | None, window: int = WINDOW) -> list[str]:
    """The windows of an item as the automaton's keys. Keys are bytes seen as Latin-1, with a space at both ends."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).decode("latin-1").split(" ")
    words = [w for w in words if w]
    if not words:
        return []
    return [f" {' '.join(words[i : i + window])} " for i in range(max(1, len(words) - window + 1))]


def build(items: list[tuple[str, str]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """One automaton over the windows of ``(item, text)``; a key's value is its length in words and its items."""
    keys: dict[str, set[str]] = {}
    for item, text in items:
        for key in item_windows(text, window):
            keys.setdefault(key, set()).add(item)
    if not keys:
        return None
    automaton = ahocorasick.Automaton()
    for key, found in keys.items():
        automaton.add_word(key, (key.count(" ") - 1, tuple(sorted(found))))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton: ahocorasick.Automaton | None):
    """Number of words, hit runs of words (first, last), their byte spans in the text, and the items found."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    words = data.split()
    if automaton is None or not words:
        return len(words), [], [], []
    plain = " " + b" ".join(words).decode("latin-1") + " "
    hits = list(automaton.iter(plain))
    if not hits:
        return len(words), [], [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # of each word, in the plain text
    last = np.searchsorted(ends, [end for end, _ in hits])
    first = last - np.array([length for _, (length, _) in hits]) + 1
    hit = np.zeros(len(words) + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, last + 1, -1)
    inside = np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    spans = list(zip(turns[::2].tolist(), (turns[1::2] - 1).tolist()))
    letters = np.concatenate([[False], np.frombuffer(data, np.uint8) != 0x20, [False]])
    starts, stops = (np.flatnonzero(letters[1:] & ~letters[:-1]), np.flatnonzero(~letters[1:] & letters[:-1]))
    places = [(int(starts[a]), int(stops[b])) for a, b in spans]
    items = sorted({item for _, (_, found) in hits for item in found})
    return len(words), spans, places, items


def _union(old: list[dict] | None, new: list[tuple[int, int]], a: str, b: str) -> list[dict]:
    """The runs of two lists together, in order."""
    pairs = sorted({(r[a], r[b]) for r in old or []} | set(new))
    return [{a: x, b: y} for x, y in pairs]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """What the texts of ``docs`` share with the benchmark (``item_id, text``), one row per row of ``docs``.

    Returns ``doc`` (the row, all its columns), ``text``, ``words`` (number of words), ``spans`` (runs of hit words),
    ``places`` (the runs' bytes in the UTF-8 text) and ``items`` (ids as strings, sorted). Rows stay where they are;
    nothing is shuffled. Null texts have no words; null item ids are written as an empty string; repeated rows are
    scanned like others; an empty benchmark hits nothing; further columns of any name are kept inside ``doc``.

    The driver takes the benchmark in parts of about ``part_bytes`` (or one item) and sends each to the executors. With
    more than one part, the rows are written after each scan, so that one automaton is in memory at a time.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text", size.alias("size"))
    total = items.agg(F.sum("size").alias("n")).first()["n"] or 0
    parts = -(-2 * total // part_bytes) if total > part_bytes else 1
    found = row_with_text(docs).select(
        "doc",
        F.lit(0).cast("bigint").alias("words"),
        F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("places"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    place = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for part in range(parts):
        rows = [(r["item"], r["text"]) for r in items.filter(place == part).select("item", "text").collect()]
        found = _scan_part(found, rows, window)
        if part < parts - 1:
            found = materialize(found, "hits")
    return found.select("doc", F.col("doc.text").alias("text"), "words", "spans", "places", "items")


def _scan_part(found: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(shared.value, window)
        for batch in slices(batches):
            made: dict[str, list] = {"words": [], "spans": [], "places": [], "items": []}
            old = (batch[c].to_pylist() for c in ("spans", "places", "items"))
            for text, had, had_places, had_items in zip(text_in(batch).to_pylist(), *old):
                n, runs, places, ids = scan(text, automaton)
                made["words"].append(n)
                made["spans"].append(_union(had, runs, "first", "last"))
                made["places"].append(_union(had_places, places, "start", "end"))
                made["items"].append(sorted({*(had_items or []), *ids}))
            fields = list(batch.schema)
            columns = [pa.array(made[f.name], f.type) if f.name in made else batch[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return found.mapInArrow(run, found.schema)


def hit_words() -> Column:
    """Words inside any run; runs of several parts may overlap, so they are swept in order."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"))
    step = lambda s, r: F.struct(
        F.greatest(s["at"], r["last"]).alias("at"),
        (s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(s["at"] + 1, r["first"]) + 1)).alias("n"),
    )
    return F.aggregate("spans", start, step, lambda s: s["n"]).cast("bigint")


def contaminated(one_in: int = ONE_IN) -> Column:
    return (hit_words() > 0) & (hit_words() * one_in >= F.col("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    return find_hits(docs, benchmark).filter(~contaminated(one_in)).select("doc.*")
