from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from storyline.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sequences(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    return {c: [t for *_, t in sorted(turns, key=lambda t: t[:2])] for c, turns in found.items()}


def rebuilt(found):
    made = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = found.get(c - c % 5, [])[:h] + own[h:]
    return made


def brute(found):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    rows = []
    for node, convs in members.items():
        tree = list(below(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(convs), len(node), parent, len(convs), len(children[node]), sum(not children[x] for x in tree), saved, digest))
    return sorted(rows, key=repr)


def built(spark, rows, remake=False, **options):
    turns = prefixtrie.number_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    members = turns.select("conv_id")
    if remake:
        turns, members = prefixtrie.rebuilt(turns)
    found = prefixtrie.build(turns, members, **options)
    assert found.columns == COLUMNS or set(found.columns) == set(COLUMNS)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr)


def mixed_rows(seed=1, convs=60):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.choice([1, 2, 2, 3, 5, 12])):
            rows.append((c, t, pick.choice(["user", "assistant"]) if t else "system", pick.choice(["hi", "é", "long text", ""]) if t else pick.choice(["a", "a", "b"])))
    rows += [(100 + k, t, "user", f"same {t}") for k in range(9) for t in range(7)]
    return rows


ODD = [(1003, None, None, None), (1003, 1, "user", None), (1004, 0, "", ""), (1004, 0, "", ""), (None, 0, "user", "lost")]
ODD += [(1008, 5, "user:", "x"), (1009, 5, "user", ":x"), (1020, 0, "u", "w " * 40_000)]


@pytest.mark.parametrize("container_rows", [1, 12, 1 << 16])
def test_equals_brute_force(spark, container_rows):
    rows = mixed_rows() + ODD
    assert built(spark, rows, container_rows=container_rows) == brute(sequences(rows))


def test_rebuilt_conversations(spark):
    rows = mixed_rows(2, 40) + ODD
    found = built(spark, rows, remake=True, container_rows=20)
    wanted = brute(rebuilt(sequences(rows)))
    assert found == wanted
    assert any(not turns for turns in rebuilt(sequences(rows)).values())  # turnless ones are members of the root


def test_one_long_conversation_and_its_copies(spark):
    rows = [(c, t, "user", f"{t}") for c in (5, 6, 7) for t in range(400)]
    assert built(spark, rows, container_rows=50) == brute(sequences(rows))


def test_empty_table(spark):
    assert built(spark, []) == []


def test_turns_of_equal_number_follow_the_same_order_everywhere(spark):
    rows = [(c, 1, "user", x) for c in (1, 2) for x in ("p", "q", "r")]
    nodes = built(spark, rows)
    assert len(nodes) == 4 and all(n[3] == 2 for n in nodes)


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK_IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(-30, 70)]
    assert built(spark, rows) == brute(sequences(rows))
