"""Chat formatting by token-level assembly.

A turn becomes reserved ids with the ids of its own text between them: begin,
role, content, end. Roles and contents are encoded as segments of their own, so
no merge crosses a boundary and no text can make a reserved id. In the readable
form a reserved id is a control string; where a text holds something that would
read as one, it is escaped with a backslash, which the reader takes away again.
The loss mask follows from the segments' lengths: +1 where an assistant's
content begins, -1 where it ends, and the prefix sum of that is the mask.

The output has a row per turn. Turns are dealt out by ranges of conversation and
turn, so a conversation that holds a third of all rows is formatted by many
tasks; each row says which range it is of and its place there, which orders the
turns. A digest over a whole conversation reads its turns one after the other as
a stream; they are never gathered.

A null text or role is empty, a null conversation id or turn comes first; turns
of one number are in an order of their role and their text's hash. Repeated rows are turns of
their own. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from inkfield.llm.common import NO_ID, blocks, partitions
from inkfield.llm.tokens import byte_names, encoder

BLOCK = 4 << 20
#: Control strings of the readable form: "### Role: ", and the end of a turn.
OPEN, CLOSE, END = "### ", ": ", " </turn>\n"
#: Reserved ids count up from the vocabulary's size: begin of a turn, begin of its content, end of the turn.
BEGIN, CONTENT, STOP = 0, 1, 2
TURN = "conv_id long, turn long, part long, place long, ids array<int>, loss array<byte>, formatted string"
#: What a reader could take for a control string, with the backslashes before it: "###" or "</turn>".
RISKY = re.compile(r"\\*(###|</turn>)")
ESCAPED = re.compile(r"(\\+)(###|</turn>)")


def escape(text: str) -> str:
    """One backslash more before each control string."""
    return RISKY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1][1:] + m[2], text)


def turns_in_order(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Sorted ranges of turns."""
    own = rows.select(
        F.coalesce(F.col(conv_id).cast("long"), F.lit(NO_ID)).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "h"]
    own = own.withColumn("h", F.xxhash64("text"))
    return own.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).drop("h")


def assemble(batches: Iterator[pa.RecordBatch], tokenizer: str, trained_role: str) -> Iterator[pa.RecordBatch]:
    tool = encoder(tokenizer)
    base = tool.whole.get_vocab_size()
    part, place = TaskContext.get().partitionId(), 0
    for block in blocks(batches, BLOCK):
        roles, texts = block.column("role").to_pylist(), [escape(t) for t in block.column("text").to_pylist()]
        role_ids, role_n = tool.encode(pa.array([escape(r) for r in roles], pa.large_string()))
        text_ids, text_n = tool.encode(pa.array(texts, pa.large_string()))
        size = role_n + text_n + 3
        ends = np.cumsum(size)
        begins = ends - size
        ids = np.empty(int(ends[-1]), np.int32)
        content = begins + role_n + 2
        ids[begins], ids[content - 1], ids[ends - 1] = base + BEGIN, base + CONTENT, base + STOP
        ids[np.arange(len(role_ids)) + np.repeat(begins + 1 - (np.cumsum(role_n) - role_n), role_n)] = role_ids
        ids[np.arange(len(text_ids)) + np.repeat(content - (np.cumsum(text_n) - text_n), text_n)] = text_ids
        trained = np.array([r == trained_role for r in roles])
        change = np.zeros(len(ids) + 1, np.int32)
        np.add.at(change, content[trained], 1)
        np.add.at(change, (content + text_n)[trained], -1)
        loss = np.cumsum(change)[:-1].astype(np.int8)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        shown = [OPEN + escape(r).capitalize() + CLOSE + t + END for r, t in zip(roles, texts)]
        yield pa.RecordBatch.from_arrays(
            [block.column("conv_id"), block.column("turn"), pa.array(np.full(len(size), part)), pa.array(np.arange(place, place + len(size))),
             pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(loss)), pa.array(shown)],
            ["conv_id", "turn", "part", "place", "ids", "loss", "formatted"],
        )
        place += len(size)


def format_chats(rows: DataFrame, tokenizer: str, trained_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, part and place (its order), ids, loss, formatted."""
    return turns_in_order(rows, conv_id, turn, role, text).mapInArrow(lambda b: assemble(b, tokenizer, trained_role), TURN)


class Reader:
    """Texts of ids, by the bytes of each id of a byte-level vocabulary."""

    def __init__(self, tokenizer: str):
        whole = encoder(tokenizer).whole
        of = {name: byte for byte, name in byte_names().items()}
        self.base = whole.get_vocab_size()
        self.spelt = [b""] * self.base
        for piece, i in whole.get_vocab().items():
            self.spelt[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelt.__getitem__, ids.tolist())).decode()


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation as its turns go by; nothing of a conversation but its digests is held."""
    reader, conv, state = Reader(tokenizer), None, None

    def row() -> pa.RecordBatch:
        values = [conv, state["n"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["shown"]]
        names = [f.split()[0] for f in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

    for batch in batches:
        shown = batch.column("formatted").to_pylist()
        lists, masks = batch.column("ids"), batch.column("loss")
        for r, key in enumerate(batch.column("conv_id").to_pylist()):
            if state is None or key != conv:
                if state is not None:
                    yield row()
                conv, state = key, {"n": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "shown": 0}
            ids, loss = lists[r].values.to_numpy(), masks[r].values.to_numpy()
            middle = int(np.flatnonzero(ids == reader.base + CONTENT)[0])
            if ids[0] != reader.base + BEGIN or ids[-1] != reader.base + STOP:
                raise ValueError("a turn lacks its reserved ids")
            role, text = unescape(reader.text(ids[1:middle])), unescape(reader.text(ids[middle + 1 : -1]))
            learned = unescape(reader.text(ids[loss == 1]))
            state["n"] += 1
            state["all"].update(f"{role}\n{text}\n".encode())
            state["loss"].update(learned.encode())
            state["chars"] += len(learned)
            state["shown"] += len(shown[r])
    if state is not None:
        yield row()


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation, read back from ids and masks in the order of their places."""
    ordered = formatted.repartition(partitions(formatted), "conv_id").sortWithinPartitions("conv_id", "part", "place")
    out = ordered.mapInArrow(lambda b: read_back(b, tokenizer), DIGEST)
    return out.withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))
