"""Chat formatting in budgeted windows.

A turn is ``<|turn|>role`` line feed ``text<|end|>`` line feed. Control strings in roles and texts are
escaped reversibly: a backslash is doubled, and one is put after the first character of each control
string, those of other common templates included. Conversations are cut between turns: prefix sums of the turns' tokens
give the longest span of new turns that fits the budget after the system turn, which every window
repeats, and after as many of the turns before as fit ``history``. Only the text of new assistant turns is
under the loss mask, so repeated targets are masked.

Rows stream through in order of conversation and turn; memory holds one window, however long a
conversation is.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import ship

TURN, END = "<|turn|>", "<|end|>"
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|unk|pad|start_of_turn|end_of_turn)>")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Longer texts are counted in parts of this many code points, so that memory stays bounded.
COUNTED = 1 << 16


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@lru_cache(2)
def _counter(tokenizer: str | None) -> Callable[[str], int]:
    """Tokens of a text: by a tokenizers file, else a quarter of its bytes, rounded up."""
    if tokenizer is None:
        return lambda text: -(-len(text.encode()) // 4)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True

    def count(text: str) -> int:
        return sum(
            len(model.encode(text[i : i + COUNTED], add_special_tokens=False)) for i in range(0, len(text), COUNTED)
        )

    return count


class _Conversation:
    """Turns added one by one; gives a window when the next turn no longer fits."""

    def __init__(self, key, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple | None = None
        # Repeated turns, then new ones, and the prefix sums of their tokens.
        self.turns: list[tuple[str, str, bool, int]] = []
        self.prefix = [0]
        self.repeated = 0
        self.number = 0

    def add(self, head: str, body: str, target: bool, tokens: int, system: bool):
        turn = (head, body, target, tokens)
        if system and not self.number and not self.turns and self.system is None:
            self.system = turn
            return None
        room = self.budget - (self.system[3] if self.system else 0)
        out = None
        if len(self.turns) > self.repeated and self.prefix[-1] + tokens > room:
            out = self.window()
        if len(self.turns) == self.repeated and self.prefix[-1] + tokens > room:
            # A turn that fits with less history, or with none, or not even alone.
            self._keep(max(0, min(self.history, room - tokens)))
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + tokens)
        return out

    def _keep(self, most: int) -> None:
        """The latest turns of together at most so many tokens stay, as history."""
        cut = bisect_left(self.prefix, self.prefix[-1] - most)
        self.turns = self.turns[cut:]
        self.prefix = [p - self.prefix[cut] for p in self.prefix[cut:]]
        self.repeated = len(self.turns)

    def window(self):
        parts, loss, at = [], [], 0
        system = [self.system] if self.system else []
        first_new = (len(system) if self.number else 0) + self.repeated
        for i, (head, body, target, _) in enumerate(system + self.turns):
            if target and i >= first_new and body:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += (head, body, END, "\n")
            at += len(head) + len(body) + len(END) + 1
        tokens = self.prefix[-1] + (self.system[3] if self.system else 0)
        out = (self.key, self.number, "".join(parts), first_new, loss, tokens)
        self.number += 1
        self._keep(self.history)
        return out

    def last(self):
        if len(self.turns) > self.repeated or (self.system and not self.number):
            return self.window()
        return None


_NAMES = ["_id", "window", "text", "repeated", "loss", "n_tokens"]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.list_(span), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _format(tokenizer: str | None, budget: int, history: int, size: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]):
        count = _counter(tokenizer)
        close = count(END + "\n")
        heads: dict[str, int] = {}
        current: _Conversation | None = None
        rows: list[tuple] = []
        held, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.column("_id").type
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_role", "_text"))):
                if current is None or current.key != key:
                    if current and (done := current.last()):
                        rows.append(done)
                        held += len(done[2])
                    current = _Conversation(key, budget, history)
                role = role or ""
                head, body = f"{TURN}{escape_role(role)}\n", escape(text or "")
                if head not in heads:
                    heads = heads if len(heads) < 1000 else {}
                    heads[head] = count(head)
                # What is written counts, not what was said: escapes cost tokens.
                tokens = heads[head] + count(body) + close
                done = current.add(head, body, role == "assistant", tokens, role == "system")
                if done:
                    rows.append(done)
                    held += len(done[2])
                if held > size:
                    yield _batch(rows, kind)
                    rows, held = [], 0
        if current and (done := current.last()):
            rows.append(done)
        if rows:
            yield _batch(rows, kind)

    return run


def format_windows(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokenizer: str | None = "/opt/tokenizers/byte_bpe_50k.json",
    budget: int = 1024,
    history: int = 256,
) -> DataFrame:
    """Windows of every conversation: id, window, text, repeated, loss, n_tokens.

    ``repeated`` turns at the beginning of a window stand in earlier windows too; ``loss`` has spans of code
    points of the text. Turns go by turn number, nulls first, then role and text; equal rows are turns of
    their own. Null roles and texts are empty; rows with a null id are one conversation. Only a first
    turn of role system is repeated. A turn that is longer than the budget is a window of its own with the
    system turn, whole. An empty table gives no windows. ``tokenizer`` is a file on every executor, or
    None to count a quarter of the bytes. Rows are partitioned by conversation and come in order within a partition.
    """
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)[conv_col]
    return (
        turns.select(
            F.col(conv_col).alias("_id"),
            F.col(turn_col).alias("_turn"),
            F.col(role_col).alias("_role"),
            F.col(text_col).alias("_text"),
        )
        .repartition("_id")
        .sortWithinPartitions("_id", "_turn", "_role", "_text")
        .select("_id", "_role", "_text")
        .mapInArrow(
            _format(tokenizer, budget, history),
            f"_id {kind}, window long, text string, repeated long, loss array<struct<start:long,end:long>>, n_tokens long",
        )
        .withColumnRenamed("_id", conv_col)
    )


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        yield unescape_role(text[at + len(TURN) : line]), unescape(text[line + 1 : end])
        at = end + len(END) + 1


def _digest(batches: Iterator[pa.RecordBatch]):
    names = ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    current = None
    rows: list[tuple] = []

    def done():
        key, turns, loss, (n, chars, size, windows) = current
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows

    kind = pa.int64()

    def batch_of(rows):
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        kind = batch.column("_id").type
        for key, text, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("_id", "text", "repeated", "loss"))):
            if current is None or current[0] != key:
                if current:
                    rows.append(done())
                current = (key, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0])
            counts = current[3]
            for i, (role, said) in enumerate(read_turns(text)):
                if i >= repeated:
                    current[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    counts[0] += 1
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                current[2].update(said.encode("utf-8", "surrogatepass"))
                counts[1] += len(said)
            counts[2] += len(text)
            counts[3] += 1
        if len(rows) >= 1000:
            yield batch_of(rows)
            rows = []
    if current:
        rows.append(done())
    if rows:
        yield batch_of(rows)


def read_back(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What windows say, read from their text alone, by conversation.

    Windows must come as format_windows gives them: partitioned by conversation and in order.
    """
    kind = dict(windows.dtypes)[conv_col]
    return (
        windows.select(F.col(conv_col).alias("_id"), "text", "repeated", "loss")
        .mapInArrow(
            _digest,
            f"_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long, n_windows long",
        )
        .withColumnRenamed("_id", conv_col)
    )
