"""Chat formatting at the level of tokens.

A turn becomes START role line-feed text END line-feed. START and END are reserved ids, spliced between segments that are
encoded by themselves, so that no text can make one. In the text form, every "<|" of a content gets a backslash before its
bar ("<|" to "<\\|", "<\\|" to "<\\\\|", and so on), which can be taken away again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.plans.shipping import ships

from .bpe import automaton, vocabulary
from .common import cut, slices

START, END = "<|im_start|>", "<|im_end|>"
#: Production parameters: ids that the vocabulary leaves free.
START_ID, END_ID = 50257, 50258
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(turns: list[tuple[str, str]], encode) -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted text, its ids, and the loss mask: the prefix sums of +1 where a learned text starts and -1 behind its end."""
    text, parts, marks, at = [], [], [], 0
    start, end, line = (np.array([START_ID], "<u4").tobytes(), np.array([END_ID], "<u4").tobytes(), encode("\n"))
    for role, content in turns:
        head, body = escape_role(role), escape(content)
        text.append(f"{START}{head}\n{body}{END}\n")
        before, inside = start + encode(head) + line, encode(body)
        parts += [before, inside, end, line]
        if role == LEARNED_ROLE:
            marks.append(at + len(before) // 4)
            marks.append(at + (len(before) + len(inside)) // 4)
        at += (len(before) + len(inside) + len(end) + len(line)) // 4
    steps = np.zeros(at + 1, np.int32)
    np.add.at(steps, marks[::2], 1)
    np.add.at(steps, marks[1::2], -1)
    return "".join(text), np.frombuffer(b"".join(parts), "<u4"), np.cumsum(steps[:-1]) > 0


def disassemble(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns and learned texts, read from the ids and the mask alone."""
    turns = []
    for a, b in zip(np.flatnonzero(ids == START_ID), np.flatnonzero(ids == END_ID)):
        role, _, content = decode(ids[a + 1 : b].tobytes()).partition("\n")
        turns.append((unescape_role(role), unescape(content)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return turns, [unescape(decode(ids[a:b].tobytes())) for a, b in zip(edges[::2], edges[1::2])]


@ships
def format_conversations(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv_col, start (tokens of the conversation before it), formatted (string), ids (binary, little-endian unsigned 32-bit), loss_mask (binary, a byte for each id).

    A conversation is its rows by start. Turns stand in the order of turn_col (null first), ties in that of role and text;
    repeated rows stay repeated. A null role or text counts as empty; a null conversation id is a conversation of its own; an
    empty table gives an empty one. Other columns are ignored. Rows are dealt out by ranges of that order, so that
    a conversation with a third of all turns spreads over many tasks; where one spans several, the tokens before each range are
    added up from one total for each range and conversation.
    """
    shared = turns.sparkSession.sparkContext.broadcast(vocabulary(path))
    order = ["conv", "turn", "role", "text"]
    said = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches):
        last, at = None, 0
        for batch in slices(batches, "text"):
            a = automaton(shared.value)
            rows = []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text"))):
                if conv != last:
                    last, at = conv, 0
                formatted, ids, mask = assemble([(role, text)], lambda s: a.encode(s, special=False))
                rows.append((at, formatted, ids.tobytes(), mask.astype(np.uint8).tobytes()))
                at += len(ids)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch["conv"], *columns], names=["conv", "at", "formatted", "ids", "loss_mask"])

    schema = f"conv {said.schema['conv'].dataType.simpleString()}, at long, formatted string, ids binary, loss_mask binary"
    made = said.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    made = cut(made.withColumn("part", F.spark_partition_id()))
    totals = made.groupBy("conv", "part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spanning = totals.withColumn("before", before).filter("before > 0").select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "before")  # one row for each range at most
    joined = made.join(F.broadcast(spanning), (F.col("part") == F.col("_part")) & F.col("conv").eqNullSafe(F.col("_conv")), "left")
    return joined.select(F.col("conv").alias(conv_col), (F.col("at") + F.coalesce("before", F.lit(0))).alias("start"), "formatted", "ids", "loss_mask")


@ships
def read_conversations(formatted: DataFrame, path: str, conv_col: str = "conv_id") -> DataFrame:
    """Reads the result of format_conversations back from ids and loss_mask, row by row: conv_col, start, role, text, loss_texts (array of the texts under the mask), formatted."""
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in slices(batches, "ids"):
            a = automaton(shared.value)
            read = [disassemble(np.frombuffer(i, "<u4"), np.frombuffer(m, np.uint8), a.decode) for i, m in zip(batch["ids"].to_pylist(), batch["loss_mask"].to_pylist())]
            role, text = (pa.array([turns[0][k] for turns, _ in read], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch[conv_col], batch["start"], role, text, pa.array([x for _, x in read], pa.list_(pa.string())), batch["formatted"]], names=[conv_col, "start", "role", "text", "loss_texts", "formatted"])

    kind = formatted.schema[conv_col].dataType.simpleString()
    return formatted.select(conv_col, "start", "ids", "loss_mask", "formatted").mapInArrow(run, f"`{conv_col}` {kind}, start long, role string, text string, loss_texts array<string>, formatted string")


@ships
def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Of the rows of read_conversations: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for each conversation. A conversation's rows stream through one task, which holds the state of its digests alone."""

    def run(batches):
        state: list = []

        def row(conv):
            n, said, chars, learned, length = state
            return {conv_col: conv, "n_turns": n, "turns_sha256": said.hexdigest(), "loss_chars": chars, "loss_sha256": learned.hexdigest(), "formatted_chars": length}

        last = None
        for batch in slices(batches, "text"):
            done = []
            for conv, role, text, learned, formatted in zip(*(batch[c].to_pylist() for c in (conv_col, "role", "text", "loss_texts", "formatted"))):
                if state and conv != last:
                    done.append(row(last))
                    state.clear()
                if not state:
                    state += [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                last = conv
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += sum(map(len, learned))
                state[3].update("".join(learned).encode())
                state[4] += len(formatted)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(last)], schema=schema)

    names = f"`{conv_col}` {read.schema[conv_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = to_arrow_schema(read.select(conv_col).schema)
    for name, kind in (("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())):
        schema = schema.append(pa.field(name, kind))
    return read.repartition(conv_col).sortWithinPartitions(conv_col, "start").mapInArrow(run, names)
