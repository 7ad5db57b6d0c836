"""Chat formatting as prefix trees: turns that conversations share are emitted once.

Conversations are dealt out and ordered by their turns (`format_trees`: a range over the path
of turn hashes, then conv_id), so those that share turns follow each other. A task lays its
conversations out depth-first, in one row (a layout): what a conversation shares with the one
before it is there already, only the rest is emitted. A layout ends at MAX_CONVERSATIONS
conversations, or at MAX_CHARS code points as soon as the next conversation shares no more
than half of it, so a first turn longer than that is not emitted for each conversation, and a
layout holds at most MAX_CHARS, or twice a conversation, and one conversation more. It can be
read, and trained on, by itself; between two layouts at most the turns of the path that the
border cuts are emitted again, however many conversations hold them. A single conversation is
always laid out in one piece.

Each node (a turn in its context) knows where its text begins in the layout (`starts`), at
which position of a conversation it begins (`positions`, the sum of its ancestors' lengths),
and which intervals of the layout it may attend to (`attends`: its ancestors and itself,
joined where they touch). The loss mask of a node covers the text of an assistant turn and
nothing else. Lengths count code points.

Defined results: null roles and texts are empty; turns sort by turn, then role and text,
nulls first; repeated rows are turns of their own; rows with a null conv_id are one
conversation; an empty table gives no trees; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
MAX_CONVERSATIONS, MAX_CHARS = 50_000, 2_000_000

NUMBERS = ("starts", "lengths", "positions", "loss_starts", "loss_lengths")
TREE = (
    f"text string, {', '.join(f'{c} array<long>' for c in NUMBERS)}, parents array<int>,"
    " attends array<array<struct<begin:long,end:long>>>, conv_ids array<long>, leaves array<int>"
)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """No control string can appear in the result, and unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text, and begin and length of what the loss covers."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(body) if role == LEARNED else 0


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("the text does not follow the template")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class Layout:
    """The depth-first layout of conversations that come in the order of their turns."""

    def __init__(self, most: int = MAX_CONVERSATIONS, chars: int = MAX_CHARS) -> None:
        self.most, self.chars = most, chars
        self.texts: list[str] = []
        self.size = 0
        self.numbers: dict[str, list[int]] = {c: [] for c in NUMBERS}
        self.parents: list[int] = []
        self.attends: list[list[tuple[int, int]]] = []
        self.conv_ids: list[int | None] = []
        self.leaves: list[int] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation and their nodes

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][0] == turns[same]:
            same += 1
        del self.path[same:]
        for turn in turns[same:]:
            self._emit(turn)
        self.conv_ids.append(conv_id)
        self.leaves.append(self.path[-1][1] if self.path else -1)

    def _emit(self, turn: tuple[str, str]) -> None:
        text, loss_at, loss_length = format_turn(*turn)
        parent = self.path[-1][1] if self.path else -1
        held, start, end = self.numbers, self.size, self.size + len(text)
        above = self.attends[parent] if parent >= 0 else []
        joined = above and above[-1][1] == start
        self.attends.append([*above[:-1], (above[-1][0], end)] if joined else [*above, (start, end)])
        position = held["positions"][parent] + held["lengths"][parent] if parent >= 0 else 0
        for name, value in zip(NUMBERS, (start, len(text), position, start + loss_at, loss_length), strict=True):
            held[name].append(value)
        self.path.append((turn, len(self.parents)))
        self.parents.append(parent)
        self.texts.append(text)
        self.size = end

    def full(self, turns: list[tuple[str, str]]) -> bool:
        """Whether a conversation with these turns is to begin a layout of its own.

        It is not where most of the layout so far is turns that it shares: they would be emitted again.
        """
        if len(self.conv_ids) >= self.most:
            return True
        shared = 0
        for turn, (held, node) in zip(turns, self.path, strict=False):
            if turn != held:
                break
            shared = self.numbers["positions"][node] + self.numbers["lengths"][node]
        return self.size >= self.chars and 2 * shared <= self.size

    def row(self) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, self.attends)]).astype(np.int32)
        flat = np.array([i for own in self.attends for i in own], np.int64).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
        attends = pa.ListArray.from_arrays(pa.array(ends), pairs)
        columns = [pa.array(["".join(self.texts)], pa.string())]
        columns += [pa.array([self.numbers[c]], pa.list_(pa.int64())) for c in NUMBERS]
        columns += [pa.array([self.parents], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(attends)], pa.int32()), attends)]
        columns += [pa.array([self.conv_ids], pa.list_(pa.int64())), pa.array([self.leaves], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["text", *NUMBERS, "parents", "attends", "conv_ids", "leaves"])


def format_trees(rows: DataFrame) -> DataFrame:
    """Layouts (TREE) of the conversations in `rows` (conv_id, turn, role, text)."""
    turn = F.struct("turn", "role", "text")
    convs = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    convs = convs.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    empty = F.lit("")
    path = F.transform("turns", lambda t: F.xxhash64(F.coalesce(t["role"], empty), F.coalesce(t["text"], empty)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(MAX_CONVERSATIONS, MAX_CHARS)
        for batch in batches:
            turns = batch.column(1)
            flat = turns.flatten()
            pairs = [(r or "", t or "") for r, t in zip(flat.field("role").to_pylist(), flat.field("text").to_pylist(), strict=True)]
            ends = np.cumsum([0, *pa.compute.list_value_length(turns).to_pylist()]).tolist()
            for k, conv_id in enumerate(batch.column(0).to_pylist()):
                own = pairs[ends[k] : ends[k + 1]]
                if layout.full(own):
                    yield layout.row()
                    layout = Layout(MAX_CONVERSATIONS, MAX_CHARS)
                layout.add(conv_id, own)
        if layout.conv_ids:
            yield layout.row()

    # Equal conversations are told apart by conv_id, so that they need not meet in one task.
    near = convs.select("conv_id", "turns", path.alias("path")).repartitionByRange("path", "conv_id")
    return near.sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInArrow(build, TREE)


def read_back(trees: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss texts of each conversation, from the layout."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = [pa.int64(), pa.string(), turn, pa.list_(pa.string())]
    schema = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss array<string>"
    learned = f"{START}{LEARNED}\n"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "turns", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                text = held["text"][k].as_py()
                starts, lengths, parents, loss_starts, loss_lengths = (
                    held[c][k].as_py() for c in ("starts", "lengths", "parents", "loss_starts", "loss_lengths")
                )
                attends = held["attends"][k].values
                rows, size = [], 0
                for conv_id, leaf in zip(held["conv_ids"][k].as_py(), held["leaves"][k].as_py(), strict=True):
                    path, at = [], leaf
                    while at >= 0:
                        path.append(at)
                        at = parents[at]
                    path.reverse()
                    spans = attends[leaf].as_py() if leaf >= 0 else []
                    formatted = "".join([text[i["begin"] : i["end"]] for i in spans])
                    own = [n for n in path if text.startswith(learned, starts[n])]
                    loss = [unescape(text[loss_starts[n] : loss_starts[n] + loss_lengths[n]]) for n in own]
                    turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                    rows.append((conv_id, formatted, turns, loss))
                    size += len(formatted)
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return trees.mapInArrow(run, schema)


def digests(back: DataFrame) -> DataFrame:
    """Per conversation: n_turns, hash of its turns, and size and hash of what the loss covers."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
