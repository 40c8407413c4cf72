"""Chat formatting by columnar byte assembly, and the reader of what it writes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import map_arrow
from veritrace.llm.registry import query

#: A turn is OPEN role BETWEEN text CLOSE.
OPEN, BETWEEN, CLOSE = b"<s>[INST] ", b" [/INST] ", b"</s>"
#: A conversation goes on in a further row once it has this many bytes.
PART_BYTES = 32 << 20
_NULL_ID = -(2**63)

_ESC = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(23 + length({_ESC.format("role")}) + length({_ESC.format("text")}))::bigint as formatted_chars
from t group by conv_id
"""


def escape(texts: pa.Array) -> pa.Array:
    """Texts in which no control string is left: a backslash goes inside each, and before each backslash."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    texts = pc.replace_substring_regex(texts, r"<(/?s>)", r"<\\\1")
    return pc.replace_substring_regex(texts, r"\[(/?INST\])", r"[\\\1")


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.DOTALL)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins, with the end of the last."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted conversations and the byte spans under the loss mask, for turns in order.

    ``firsts`` are the turns that begin a conversation. Each turn has five segments. Their lengths give all offsets by
    one cumulative sum, and every segment kind is scattered into one buffer made beforehand.
    """
    role_data, role_at = _bytes(escape(roles))
    text_data, text_at = _bytes(escape(texts))
    n = len(roles)
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(BETWEEN), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, dtype=np.uint8)
    for column, constant in ((0, OPEN), (2, BETWEEN), (4, CLOSE)):
        out[starts[:, column, None] + np.arange(len(constant))] = np.frombuffer(constant, dtype=np.uint8)
    for column, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        out[np.repeat(starts[:, column] - at[:-1], lengths[:, column]) + np.arange(len(data))] = data
    bounds = np.append(starts[firsts, 0], len(out))
    formatted = pa.Array.from_buffers(pa.string(), len(firsts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])
    masked = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
    base = np.repeat(bounds[:-1], np.diff(np.append(firsts, n)))
    begin = (starts[:, 3] - base)[masked]
    per = np.concatenate(([0], np.cumsum(np.add.reduceat(masked, firsts)))).astype(np.int32) if n else np.zeros(1, np.int32)
    lists = [pa.ListArray.from_arrays(per, pa.array(v)) for v in (begin, begin + lengths[masked, 3])]
    return formatted, lists[0], lists[1]


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations from ``conv_id``, ``turn``, ``role``, ``text``: ``conv_id``, ``part``, ``formatted``, and the
    byte spans of assistant texts as ``loss_starts`` and ``loss_ends``.

    Turns follow ``turn``, ties the role and the text, nulls first. Null roles and texts are empty ones, rows without a
    conversation id are one conversation. A conversation is one row up to ``PART_BYTES`` and goes on in further rows
    between turns, part by part in the same task, so that memory does not grow with it. An empty table gives no rows;
    other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        held, last, part = None, None, 0

        def emit(table):
            nonlocal last, part
            key = table["conv_id"].fill_null(_NULL_ID).to_numpy()
            firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            table = table.combine_chunks()
            formatted, begins, ends = assemble(*[table[c].chunk(0) for c in ("role", "text")], firsts)
            parts = np.zeros(len(firsts), dtype=np.int32)
            if last == key[0]:
                parts[0] = part + 1
            last, part = key[-1], int(parts[-1])
            return pa.RecordBatch.from_arrays(
                [table["conv_id"].take(firsts).combine_chunks(), pa.array(parts), formatted, begins, ends],
                names=["conv_id", "part", "formatted", "loss_starts", "loss_ends"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = pa.Table.from_batches([batch.slice(at, 1024)])
                held = piece if held is None else pa.concat_tables([held, piece])
                if held.nbytes < PART_BYTES // 4:
                    continue
                key = held["conv_id"].fill_null(_NULL_ID).to_numpy()
                cut = int(np.flatnonzero(key == key[-1])[0])
                if cut:
                    yield emit(held.slice(0, cut))
                    held = held.slice(cut)
                if held.nbytes >= PART_BYTES:
                    yield emit(held)
                    held = None
        if held is not None and held.num_rows:
            yield emit(held)

    return map_arrow(rows, run, "conv_id long, part int, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def read_chats(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the rows of ``format_chats``, taken in their order: a row per conversation with the number
    and digest of its turns, and the characters and digest of the text under the loss mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, state = None, None
        done: list[tuple] = []

        def close():
            turns, loss = state["turns"], state["loss"]
            done.append((key, state["n"], turns.hexdigest(), state["loss_chars"], loss.hexdigest(), state["chars"]))

        def rows():
            columns = list(zip(*done, strict=True))
            done.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            conv, part, texts, begins, ends = batch.columns
            for i in range(batch.num_rows):
                if part[i].as_py() == 0:
                    if state is not None:
                        close()
                    key = conv[i].as_py()
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                text = texts[i].as_py()
                data = text.encode()
                state["chars"] += len(text)
                for turn in data.split(CLOSE)[:-1]:
                    role, _, said = turn.removeprefix(OPEN).partition(BETWEEN)
                    state["n"] += 1
                    state["turns"].update(unescape(role) + b"\n" + unescape(said) + b"\n")
                for a, b in zip(begins[i].as_py(), ends[i].as_py(), strict=True):
                    said = unescape(data[a:b])
                    state["loss"].update(said)
                    state["loss_chars"] += len(said.decode())
            if done:
                yield rows()
        if state is not None:
            close()
            yield rows()

    return map_arrow(formatted, run, (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


@query("op4_chat_format", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_chats(format_chats(turns.union(extra)))
