"""Conversations as one training text each, with a mask over what the assistant says.

A batch of turns is assembled column-wise: the lengths of headers, roles and texts give
cumulative offsets, and numpy scatters all bytes into one preallocated Arrow buffer, whose
string offsets are the ends of conversations.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, control strings
are escaped by a backslash after their ``<``; a run of backslashes there gets one more, so
the escape can be undone. In roles, backslashes and line feeds are escaped as well.

Turns are sorted by conversation and turn over the cluster and stream through a task, so a
conversation of any length needs no more memory than a batch: it comes out in chunks that
begin and end with whole turns, and offsets of the mask count from the conversation's start.

Defined results: null roles and texts are empty; a null turn comes first; equal turns are
ordered by role, then text; rows with a null conversation id are one conversation; other
columns are not read.
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
from pyspark.sql import types as T

from tidewatt.llm.frames import released, small_batches
from tidewatt.llm.words import slices, utf8

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("chars", T.LongType())]))


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer of all turns, where each turn ends in it, and where the text of each begins."""
    n = len(texts)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (START, "\n", END)]
    role, role_at = utf8(escape_role(roles))
    text, text_at = utf8(escape(texts))
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = (len(f) for f in fixed)
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(sizes.reshape(-1)).reshape(n, 5)
    begins = ends - sizes
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, part in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[begins[:, k, None] + np.arange(len(part))] = part
    for k, part, at in ((1, role, role_at), (3, text, text_at)):
        out[np.repeat(begins[:, k] - at[:-1], sizes[:, k]) + np.arange(len(part))] = part
    return buffer, ends[:, 4], begins[:, 3]


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, chunk, n_turns, formatted, loss): chunks of each conversation in order, and the
    spans of code points in the chunk that the assistant's texts take."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("chunk", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk = None, 0  # the conversation that the last batch ended with
        for batch in batches:
            for part in slices(batch, 3):
                ids = part.column(0).to_pylist()
                buffer, ends, text_begins = assemble(part.column(2), part.column(3))
                begins = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
                last = begins[1:] + [len(ids)]
                offsets = np.concatenate([[0], ends[np.array(last) - 1]])
                formatted = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), buffer).cast(pa.string())
                codes = np.concatenate([[0], np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)])
                spoken = np.flatnonzero(pc.equal(part.column(2), ASSISTANT).to_numpy(zero_copy_only=False))
                owner = np.searchsorted(begins, spoken, side="right") - 1
                starts = codes[text_begins[spoken]] - codes[offsets[owner]]
                chars = codes[ends[spoken] - len(END)] - codes[text_begins[spoken]]
                lists = np.searchsorted(owner, np.arange(len(begins) + 1)).astype(np.int32)
                loss = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(chars, pa.int64())], names=["start", "chars"]))
                chunks = np.zeros(len(begins), np.int64)
                if held is not None and held[0] == ids[0]:
                    chunks[0] = chunk + 1
                held, chunk = (ids[-1],), int(chunks[-1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(begins)), pa.array(chunks), pa.array(np.diff([*begins, len(ids)]).astype(np.int64)), formatted, loss], names=schema.names)

    return small_batches(rows).mapInArrow(lambda batches: released(run(batches)), schema)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted chunk."""
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        yield unescape_role(role), unescape(text)


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them in the order they come in:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The chunks of a conversation must follow each other in one partition, as they are made.
    """
    kinds = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    schema = T.StructType([formatted.schema["conv_id"], *[T.StructField(n, t) for n, t in kinds.items()]])
    key = formatted.columns.index("conv_id"), formatted.columns.index("chunk"), formatted.columns.index("formatted"), formatted.columns.index("loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind: pa.DataType | None = None

        def rows(states: list[list]) -> pa.RecordBatch:
            columns = [[s[0] for s in states], [s[1] for s in states], [s[2].hexdigest() for s in states], [s[3] for s in states], [s[4].hexdigest() for s in states], [s[5] for s in states]]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            kind, done = batch.column(key[0]).type, []
            for conv, chunk, text, loss in zip(*[batch.column(k).to_pylist() for k in key]):
                if chunk == 0:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["start"] + span["chars"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield rows(done)
        if state is not None:
            yield rows([state])

    return formatted.mapInArrow(run, schema)
