"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977}" for i in range(30_000)) + "."


def sentence(seed: int, words: int = 60) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice("the of and to in river stone light cloud garden window paper silver table".split()) + str(pick.randrange(40)) for _ in range(words))


def odd_rows() -> list[tuple]:
    base = sentence(1)
    near = base.split()
    near[30] = "changed"
    return [
        (0, base, "en"),
        (1, base, "en"),
        (1, base, "en"),
        (2, " ".join(near), "en"),
        (3, None, "en"),
        (4, "", None),
        (5, "!!! ... ***", "en"),
        (6, LONG, "en"),
        (7, LONG + " end", "de"),
        (8, "one two three", None),
        (9, "One, two: THREE!", "en"),
        (None, sentence(2), "en"),
        (None, None, None),
        (10, "  spaces  and\ttabs\n\nlines   wide ", "fr"),
        (11, "Ünïcödé ñandú <|endoftext|> x \U0001f600", "es"),
        (12, sentence(3, 400), "en"),
    ]


#: Names that operators use inside, as columns of the table.
CLASHING = ("doc", "row", "score", "words", "text_key", "number", "kept", "shard", "size", "items")


def odd_docs(spark):
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, *[f"own {c}" for c in CLASHING]) for r in odd_rows()]
    return spark.createDataFrame(rows, schema).repartition(3)


def no_docs(spark):
    return odd_docs(spark).filter("doc_id = -99")
