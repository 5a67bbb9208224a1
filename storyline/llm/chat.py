"""Chat formatting by columnar byte assembly.

A turn is ``<turn ROLE>``, a line break, the text, ``</turn>`` and a line break. In texts a backslash before ``\\``, ``<turn`` and
``</turn`` keeps them apart from marks; in roles it stands before every ``\\``, ``<`` and ``>``. Reading takes one backslash away, so
formatting is reversible. A batch of turns is put together in one buffer: segment lengths, cumulative offsets and scatter
indices are computed for all turns at once, and headers and texts are copied by two index assignments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A conversation of more bytes is written as several rows, so that no row grows without bound.
PART_BYTES = 1 << 24
LEARNED_ROLE = "assistant"
CLOSE = b"</turn>\n"

FORMATTED = "conv_id bigint, part int, turns int, formatted string, mask array<struct<start:bigint,end:bigint>>"
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n(.*?)(?<!\\)((?:\\\\)*)</turn>\n", re.S)


def escape_texts(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    texts = pc.replace_substring(texts, "<turn", "\\<turn")
    return pc.replace_substring(texts, "</turn", "\\</turn")


def escape_roles(roles: pa.Array) -> pa.Array:
    for mark in ("\\", "<", ">"):
        roles = pc.replace_substring(roles, mark, "\\" + mark)
    return roles


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a string column without nulls."""
    column = pc.cast(column, pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, values: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> None:
    """Copy segment ``i`` of ``values`` to ``places[i]`` of ``out``, for all segments at once."""
    lengths = np.diff(offsets)
    out[np.arange(len(values)) + np.repeat(places - offsets[:-1], lengths)] = values


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order; where each turn starts and the last ends; where each text starts and ends."""
    heads = pc.binary_join_element_wise("<turn ", escape_roles(roles), ">\n", "")
    heads, head_at = _bytes(heads)
    bodies, body_at = _bytes(escape_texts(texts))
    head_size, body_size = np.diff(head_at), np.diff(body_at)
    turn_at = np.concatenate([[0], np.cumsum(head_size + body_size + len(CLOSE))])
    out = np.empty(int(turn_at[-1]), np.uint8)
    _scatter(out, heads, head_at, turn_at[:-1])
    text_at = turn_at[:-1] + head_size
    _scatter(out, bodies, body_at, text_at)
    ends = text_at + body_size
    out[(ends[:, None] + np.arange(len(CLOSE))).ravel()] = np.tile(np.frombuffer(CLOSE, np.uint8), len(ends))
    return out, turn_at, text_at, ends


def format_chats(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Format ``conv_id, turn, role, text``: rows ``conv_id, part, turns, formatted, mask``.

    ``mask`` has the byte ranges of assistant texts in ``formatted``, those the loss is taken on. Null texts and roles are
    empty; a null ``conv_id`` is a conversation of its own; turns with equal or null numbers follow by role, then text
    (nulls first). A conversation comes to one task in order and is written in parts of about ``part_bytes``, so the memory of a
    task doesn't depend on its length.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        part = {"id": None, "next": 0}  # the conversation whose parts are under way

        def emit(found: pa.Table, whole: bool) -> pa.RecordBatch:
            """Format rows of which only the last conversation may go on (if not ``whole``)."""
            ids = found["conv_id"].combine_chunks()
            key = ids.fill_null(0).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1])) + 1
            roles, texts = found["role"].combine_chunks(), found["text"].combine_chunks()
            out, turn_at, text_at, ends = assemble(roles, texts)
            cuts = np.concatenate([[0], change, [len(key)]])
            at = turn_at[cuts]
            formatted = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
            learned = np.flatnonzero(pc.equal(roles, LEARNED_ROLE).to_numpy(zero_copy_only=False))
            home = np.searchsorted(cuts, learned, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(text_at[learned] - at[home]), pa.array(ends[learned] - at[home])], ["start", "end"])
            mask_at = np.searchsorted(home, np.arange(len(cuts)))
            mask = pa.ListArray.from_arrays(pa.array(mask_at, pa.int32()), spans)
            first = ids[0].as_py()
            numbers = np.zeros(len(cuts) - 1, np.int32)
            if part["next"] and first == part["id"]:
                numbers[0] = part["next"]
            part["id"], part["next"] = ids[len(ids) - 1].as_py(), 0 if whole else int(numbers[-1]) + 1
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cuts[:-1])), pa.array(numbers), pa.array(np.diff(cuts).astype(np.int32)), pc.cast(formatted, pa.string()), mask],
                ["conv_id", "part", "turns", "formatted", "mask"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            found = pa.Table.from_batches([batch])
            found = found if carry is None else pa.concat_tables([carry, found])
            ids = found["conv_id"].combine_chunks()
            same = pc.is_null(ids) if ids[len(ids) - 1].as_py() is None else pc.fill_null(pc.equal(ids, ids[len(ids) - 1]), False)
            begin = len(ids) - int(pc.sum(same).as_py())
            if begin:
                yield emit(found.slice(0, begin), True)
            carry = found.slice(begin)
            if carry.nbytes > part_bytes:
                yield emit(carry, False)
                carry = None
        if carry is not None and carry.num_rows:
            yield emit(carry, True)

    return dealt.mapInArrow(run, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, taken back out of a formatted string."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2] + turn[3])))
        at = turn.end()
    return found


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Read conversations back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Parts of a conversation come to one task in order and are hashed as they pass.
    """
    dealt = formatted.select("conv_id", "part", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None

        def close() -> None:
            if now is not None:
                done.append((now["id"], now["turns"], now["all"].hexdigest(), now["loss"], now["learned"].hexdigest(), now["chars"]))

        for batch in batches:
            for conv, text, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "mask"))):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": 0, "learned": hashlib.sha256(), "chars": 0}
                for role, said in read_turns(text):
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                data = text.encode("utf-8", "surrogatepass")
                for span in mask:
                    said = unescape(data[span["start"] : span["end"]].decode("utf-8", "surrogatepass"))
                    now["loss"] += len(said)
                    now["learned"].update(said.encode("utf-8", "surrogatepass"))
                now["chars"] += len(text)
            yield _rows(done)
            done = []
        close()
        yield _rows(done)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return dealt.mapInArrow(run, schema)
