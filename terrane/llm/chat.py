"""Chat formatting by columnar byte assembly (operator 3).

Turns are formatted a batch at a time: contents are escaped as Arrow columns, segment lengths and cumulative offsets are computed in
numpy, and headers, contents and ends are scattered by index into one preallocated buffer.

The template: ``<s>[INST] role [/INST]text</s>`` for each turn. Control strings inside a role or a text are broken up by a backslash
after their first character, and a backslash is doubled; reading back undoes both, so every text survives unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, END = b"<s>[INST] ", b" [/INST]", b"</s>"
_CONTROL = r"(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])"
_UNDO = re.compile(rb"\\(\\?)")

PART = "conv_id {0}, part long, n_turns long, body binary, text_starts array<long>, text_lengths array<long>, in_loss array<boolean>"


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    return pc.replace_substring_regex(texts, _CONTROL, r"\1\3\\\2\4")


def unescape(text: bytes) -> bytes:
    return _UNDO.sub(rb"\1", text) if b"\\" in text else text


def _view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and its offsets."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment k of ``data`` to ``out[starts[k]:]``, all segments at once."""
    lengths = np.diff(offsets)
    out[np.repeat(starts - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order; where each turn starts (one more than turns), where its text starts, and the text's bytes."""
    n = len(texts)
    role_kinds = pc.dictionary_encode(roles)
    heads = pc.binary_join_element_wise(OPEN.decode(), escape(role_kinds.dictionary), MID.decode(), "")
    head_data, head_offsets = _view(heads.take(role_kinds.indices))
    data, offsets = _view(escape(texts))
    head_len, text_len = np.diff(head_offsets), np.diff(offsets)
    turns = np.concatenate(([0], np.cumsum(head_len + text_len + len(END))))
    buffer = pa.allocate_buffer(int(turns[-1]))
    out = np.frombuffer(buffer, np.uint8)
    _scatter(out, turns[:-1], head_data, head_offsets)
    _scatter(out, turns[:-1] + head_len, data, offsets)
    out[(turns[1:, None] - len(END) + np.arange(len(END))).ravel()] = np.tile(np.frombuffer(END, np.uint8), n)
    return buffer, turns, turns[:-1] + head_len, text_len


def _formatted(loss_roles: frozenset[str], max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            marks, since = [0], 0
            for k, x in enumerate(np.cumsum(sizes)):
                if x - since > max_bytes and k > marks[-1]:
                    marks.append(k)
                    since = x - sizes[k]
            for a, b in zip(marks, [*marks[1:], batch.num_rows], strict=True):
                if b > a:
                    yield _piece(batch.slice(a, b - a), loss_roles)

    return run


def _piece(batch: pa.RecordBatch, loss_roles: frozenset[str]) -> pa.RecordBatch:
    conv, part, role, text = (batch.column(k) for k in range(4))
    role, text = pc.fill_null(role, ""), pc.fill_null(text, "")
    buffer, turns, starts, lengths = assemble(role, text)
    n = len(conv)
    same = pc.fill_null(pc.equal(conv.slice(1), conv.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) if n > 1 else np.empty(0, bool)
    both_null = (pc.is_null(conv.slice(1)).to_numpy(zero_copy_only=False) & pc.is_null(conv.slice(0, n - 1)).to_numpy(zero_copy_only=False)) if n > 1 else same
    first = np.concatenate(([0], np.flatnonzero(~(same | both_null)) + 1))
    ends = np.concatenate((first[1:], [n]))
    rows = np.concatenate((first, [n]))
    bodies = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(turns[rows].astype(np.int64)), buffer]).cast(pa.binary())
    relative = starts - np.repeat(turns[first], ends - first)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values)
    loss = pc.is_in(role, value_set=pa.array(sorted(loss_roles), pa.string()))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), part.take(pa.array(first)), pa.array(ends - first, pa.int64()), bodies, lists(pa.array(relative, pa.int64())), lists(pa.array(lengths, pa.int64())), lists(loss)],
        names=["conv_id", "part", "n_turns", "body", "text_starts", "text_lengths", "in_loss"],
    )


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), max_bytes: int = 4 << 20) -> DataFrame:
    """The formatted conversations, in parts: conv_id, part, n_turns, body, and for each turn of the part the byte span of its escaped text and whether it is under the loss mask.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Turns are ordered by (turn, role, text), nulls first; a null
    role or text counts as empty; null conversation ids form one conversation. Ties and repeated rows stay, in that order. A long
    conversation is spread over several parts, in order of ``part``, so that no task or row must hold all of it: rows are dealt by
    ranges of (conv_id, turn, role, text), and a part holds about ``max_bytes`` at most unless one turn is longer.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    cols = [F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.select("conv_id", F.monotonically_increasing_id().alias("part"), "role", "text")
    return numbered.mapInArrow(_formatted(frozenset(loss_roles), max_bytes), PART.format(kind))


def parse(body: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of each turn, read back from formatted bytes."""
    found = []
    for turn in body.split(END)[:-1]:
        head = turn.index(MID)
        found.append((unescape(turn[len(OPEN) : head]), unescape(turn[head + len(MID) :])))
    return found
