from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from storyline.llm import collocations
from tests.llm.fixtures import no_docs, odd_docs


def brute(rows, least=10, covered=50):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        dropped = len(words) == 2 and any(
            n >= least and 100 * n >= covered * a for (other, long), n in counts.items() if other == lang and len(long) == 3 and words in (long[:2], long[1:])
        )
        found[lang, " ".join(words)] = (a, left, right, totals[lang], score, dropped)
    return found


def mined(docs, **options):
    found = collocations.mine(docs, **options).collect()
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score, r.dropped) for r in found}


@pytest.mark.parametrize("shard_tokens", [40, 1 << 20])
def test_equals_brute_force(spark, shard_tokens):
    pick = np.random.default_rng(5)
    words = ["river", "stone", "LIGHT", "the", "of", "ünï", "x y", "a-b"]
    rows = []
    for i in range(150):
        parts = [words[min(7, int(k))] + pick.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for k in pick.exponential(2, 40)]
        rows.append(("".join(parts), [None, "en", "de"][i % 3]))
    rows += [(None, "en"), ("", None), ("... !", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert mined(docs, shard_tokens=shard_tokens) == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert mined(docs, least=2) == brute([(r.text, r.lang) for r in docs.select("text", "lang").collect()], least=2)
    assert mined(no_docs(spark)) == {}


def test_null_language_and_its_name_are_one(spark):
    docs = spark.createDataFrame([("a b " * 6, None), ("a b " * 6, "und"), ("a b " * 6, "")], "text string, lang string")
    found = mined(docs)
    assert found["und", "a b"][0] == 12 and ("", "a b") not in found


def test_intervals_of_both_transforms():
    text = np.array([1, 2, 1, 2, 3, 0, 2, 1, 2, 0], np.int32)
    kinds = 4
    first, second, size, start = collocations.extend_left(collocations.transform(text, 3), kinds)
    pairs = Counter(zip(text.tolist(), np.roll(text, -1).tolist()))
    assert {(a, b): n for a, b, n in zip(first.tolist(), second.tolist(), size.tolist())} == pairs
    number, third, n = collocations.extend_right(collocations.transform(text[::-1], 3), start, size, kinds)
    triples = Counter(zip(text.tolist(), np.roll(text, -1).tolist(), np.roll(text, -2).tolist()))
    assert {(int(first[k]), int(second[k]), int(c)): int(m) for k, c, m in zip(number, third, n)} == triples


def test_strength_is_exact(spark):
    big = 10**14 + 1
    df = spark.createDataFrame([(big, big + 7, big + 1)], "a bigint, l bigint, r bigint")
    found = df.select(collocations.strength(df.a, df.l, df.r).alias("s")).first().s
    assert found == 1_000_000 * big * big // ((big + 7) * (big + 1))
