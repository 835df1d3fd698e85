"""Chat formatting: conversations assembled column-wise into one byte buffer, with a loss mask, and read back.

A turn becomes  <|im_start|>role\\ntext<|im_end|>\\n . Control strings inside roles and texts get one backslash more
after their first character, which reading back takes away; so no text can close or open a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import in_slices, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# What may follow the first character of a control string.
CONTROL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>|/?think>|/?tool_call>)"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + CONTROL, re.compile(r"([<\[])\\(\\*)" + CONTROL)
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=ESCAPE, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def _role_to_line(roles: pa.Array) -> pa.Array:
    for a, b in (("\\", "\\\\"), ("\n", "\\n")):
        roles = pc.replace_substring(roles, pattern=a, replacement=b)
    return escape(roles)


def _line_to_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's offsets and data, without a copy."""
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return o, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, new: np.ndarray, learn: str = "assistant") -> tuple[pa.Array, list[list[dict]]]:
    """Formatted conversations and their masked spans in code points; new: at which rows a conversation begins."""
    encoded = roles.dictionary_encode()
    heads = pc.binary_join_element_wise(OPEN, _role_to_line(encoded.dictionary), "\n", "").take(encoded.indices)
    parts = [heads, escape(texts), pa.array([CLOSE]).take(pa.array(np.zeros(len(texts), np.int32)))]
    sources = [_bytes_of(p) for p in parts]
    lengths = np.stack([np.diff(o) for o, _ in sources], axis=1)
    to = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(int(to[-1]), np.uint8)
    for k, (o, data) in enumerate(sources):
        n = lengths[:, k]
        step = np.repeat(to[k:-1:3] - (o[:-1] - o[0]), n) + np.arange(int(n.sum()))
        out[step] = data[o[0] : o[-1]]
    first = np.flatnonzero(new)
    ends = np.append(to[first * 3], to[-1]).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(out))
    chars = np.stack([np.asarray(pc.utf8_length(p), np.int64) for p in parts], axis=1)
    at = np.concatenate(([0], np.cumsum(chars.ravel())))
    masks: list[list[dict]] = [[] for _ in first]
    conv = np.cumsum(new) - 1
    for i in np.flatnonzero(np.asarray(pc.equal(roles, learn))):
        base = at[first[conv[i]] * 3]
        masks[conv[i]].append({"start": int(at[3 * i + 1] - base), "end": int(at[3 * i + 2] - base)})
    return formatted, masks


def format_chat(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, piece, formatted, loss array<struct<start,end>> from rows (conv_id, turn, role, text).

    Turns are ordered by (turn, role, text), nulls first. A null text or role is empty; rows with a null conv_id make
    one conversation; repeated rows are repeated turns; other columns are not read; no rows give no rows. Memory does
    not grow with a conversation: what exceeds an Arrow batch continues in rows with the next piece number, which
    follow in the same partition. Only the deal by conv_id moves texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in in_slices(batches, "text", 16 << 20):
            ids = b.column("conv_id").to_pylist()
            new = np.array([True, *(x != y for x, y in zip(ids, ids[1:], strict=False))])
            pieces = []
            for i in np.flatnonzero(new):
                piece = piece + 1 if ids[i] == last else 0
                last = ids[i]
                pieces.append(piece)
            formatted, masks = assemble(b.column("role"), b.column("text"), new, learn)
            yield pa.RecordBatch.from_arrays([b.column("conv_id").filter(pa.array(new)), pa.array(pieces, pa.int32()), formatted, pa.array(masks, mask)], ["conv_id", "piece", "formatted", "loss"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, piece int, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest per conversation of format_chat's output, taken from the formatted text and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows: list[list] = []
        for b in batches:
            for conv, piece, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "formatted", "loss")), strict=True):
                if piece == 0:
                    rows.append([conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                now = rows[-1]
                for m in TURN.finditer(text):
                    now[1] += 1
                    now[2].update(f"{_line_to_role(m[1])}\n{unescape(m[2])}\n".encode())
                for s in loss:
                    said = unescape(text[s["start"] : s["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            yield pack(rows[:-1], names)
            rows = rows[-1:]
        yield pack(rows, names)

    def pack(rows: list[list], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two turns consist of control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], given.schema)
    return read_back(format_chat(given.unionByName(tricky)))
