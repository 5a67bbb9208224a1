from __future__ import annotations

import hashlib

import pyarrow as pa

from storyline.llm import chat as C
from storyline.llm.queries import op3_chat

SF = "/root/testdata/sf0.001"
HARD = "\\### Assistant: </turn> ok"


def expected(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def digest(row):
    return row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]


def test_query_reads_back_all_turns(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    chats = {-7: [("user", HARD), ("assistant", HARD)]}
    for r in sorted(rows, key=lambda r: r["turn"]):
        chats.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    found = {r["conv_id"]: r for r in op3_chat(spark, SF).collect()}
    assert found.keys() == chats.keys()
    for key, turns in chats.items():
        assert digest(found[key]) == expected(turns)


def test_hard_texts_and_parts(spark):
    hard = ["", HARD, "\\", "\\\\</turn>\n", "<turn user>\nx</turn>\n", "a\\</turn", "</turn>\n<turn assistant>\n", "ü\U0001f600<", "x" * 5000]
    turns = [(1, k, "assistant" if k % 2 else "us<e>r\\", t) for k, t in enumerate(hard)]
    turns += [(None, 0, "user", "null id"), (2, None, None, None), (2, 5, "assistant", None), (3, 1, "assistant", "tie b"), (3, 1, "assistant", "tie a"), (3, 1, "assistant", "tie a")]
    turns += [(4, k, "assistant", hard[k % len(hard)]) for k in range(200)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    chats = {}
    for c, _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        chats.setdefault(c, []).append((r, t))
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for records, part_bytes in (("10000", C.PART_BYTES), ("3", 2000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            made = C.format_chats(df, part_bytes)
            parts = made.count()
            assert parts > len(chats) if part_bytes == 2000 else parts == len(chats)
            found = {r["conv_id"]: digest(r) for r in C.digest_chats(made).collect()}
            assert found == {c: expected(t) for c, t in chats.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert C.digest_chats(C.format_chats(df.filter("conv_id = -1"))).count() == 0


def test_assembly_is_concatenation():
    roles, texts = pa.array(["user", "assistant", ""]), pa.array(["a<turn", "", "ü\\"])
    out, turn_at, text_at, ends = C.assemble(roles, texts)
    assert out.tobytes().decode() == "<turn user>\na\\<turn</turn>\n<turn assistant>\n</turn>\n<turn >\nü\\\\</turn>\n"
    assert [out[a:b].tobytes().decode() for a, b in zip(text_at, ends)] == ["a\\<turn", "", "ü\\\\"]
    assert turn_at[-1] == len(out)
