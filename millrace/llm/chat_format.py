"""Chat formatting into budgeted windows with a loss mask.

The turns of a conversation are measured in tokens, and running sums of them choose windows that hold whole turns only:
each window starts with the system turn, if the conversation begins with one, repeats at most `history` tokens of the turns
before, and takes on new turns as long as all of it fits the budget. A turn that is over the budget by itself gets a
window of its own. Every assistant text is under the loss mask in the window where it is new, and in no other.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts each ``<|``, also with backslashes in
between, gets one more backslash, so no control string can come from a text and reading takes one backslash back.

A conversation's turns are streamed in order; a window and its history are held, never the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import small
from millrace.llm.token_counts import count_texts
from millrace.storage import ship

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window and of the history repeated in it.
BUDGET, HISTORY = 1024, 256
_WINDOW_SCHEMA = "conv_id long, window long, text string, tokens long, repeated int, turns int, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the bounds of its text."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


class _Turn:
    def __init__(self, role: str, text: str, tokens: int) -> None:
        self.formatted, self.start, self.end = format_turn(role, text)
        self.target, self.tokens = role == "assistant", tokens


class Windows:
    """The windows of one conversation; `add` its turns in order, then `close`."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.most_history = budget, history
        self.system: _Turn | None = None
        self.history: deque[tuple[int, _Turn]] = deque()  # turns with the running sum of tokens before them
        self.new: list[_Turn] = []
        self.sum = self.new_from = self.number = 0
        self.any = False

    def add(self, role: str, text: str, tokens: int) -> list[tuple]:
        turn, out = _Turn(role, text, tokens), []
        if not self.any and role == "system":
            self.system = turn
        elif self.new and self._fixed() + self.sum + tokens - self._begin() > self.budget:
            out.append(self._emit())
        self.any = True
        if turn is not self.system:
            if not self.new:  # history must leave room for the turn
                room = min(self.most_history, self.budget - self._fixed() - tokens)
                while self.history and self.sum - self.history[0][0] > room:
                    self.history.popleft()
                self.new_from = self.sum
            self.new.append(turn)
            self.sum += tokens
        return out

    def close(self) -> list[tuple]:
        return [self._emit()] if self.new or self.system and not self.number else []

    def _fixed(self) -> int:
        return self.system.tokens if self.system else 0

    def _begin(self) -> int:
        return self.history[0][0] if self.history else self.new_from

    def _emit(self) -> tuple:
        first = self.system is not None and not self.number  # the system turn is new in the first window
        repeated = [*([self.system] if self.system and not first else []), *(t for _, t in self.history)]
        turns = [*([self.system] if first else []), *repeated, *self.new]
        parts, loss, at = [], [], 0
        for k, turn in enumerate(turns):
            if turn.target and k >= len(turns) - len(self.new):
                loss.append({"start": at + turn.start, "end": at + turn.end})
            parts.append(turn.formatted)
            at += len(turn.formatted)
        out = (self.number, "".join(parts), self._fixed() + self.sum - self._begin(), len(repeated), len(turns), loss)
        before = self.new_from
        for turn in self.new:
            self.history.append((before, turn))
            before += turn.tokens
        while self.history and self.sum - self.history[0][0] > self.most_history:
            self.history.popleft()
        self.new, self.number = [], self.number + 1
        return out


def format_conversations(
    turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """The windows of every conversation: conv_id, window, text, tokens, repeated, turns and loss.

    `repeated` counts the turns at the start that an earlier window had already; in the first window the system turn is new. `loss` has the
    bounds of assistant texts in code points. Turns come by turn, then role and text; null role or text counts as empty, a null turn is first,
    turns without conversation make one of their own. Repeated rows are turns of their own. An empty table gives no windows.
    """
    spark = turns.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *text)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = held.value
        schema = pa.schema([
            ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("tokens", pa.int64()), ("repeated", pa.int32()),
            ("turns", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        ])
        current: tuple | None = None  # (conversation,), as that may be null
        windows = Windows(budget, history)
        for batch in small(batches):
            ids, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            sizes = count_texts(source, [format_turn(r, t)[0] for r, t in zip(roles, texts)]).tolist()
            out = []
            for conv, role, body, size in zip(ids, roles, texts, sizes):
                if current != (conv,):
                    if current is not None:
                        out += [(current[0], *w) for w in windows.close()]
                    current, windows = (conv,), Windows(budget, history)
                out += [(conv, *w) for w in windows.add(role, body, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if current is not None and (out := [(current[0], *w) for w in windows.close()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, _WINDOW_SCHEMA)


def parse_window(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window, unescaped."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body[: body.rindex(END)])))
    return out


def read_windows(windows: DataFrame, digest: Callable = hashlib.sha256) -> DataFrame:
    """What the windows of each conversation hold, each turn once, read back from their texts and masks.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars and loss_sha256 (all text under the mask,
    unescaped, nothing between), formatted_chars. Windows are streamed in order. Those without conversation are one of their own;
    other columns play no part; no windows give no rows.
    """
    ship(windows.sparkSession)
    rows = windows.select("conv_id", "window", "text", "repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: list = []

        def fresh() -> list:
            return [0, digest(), 0, digest(), 0]

        def row(conv, state) -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in small(batches):
            out = []
            for conv, text, repeated, loss in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if current != (conv,):
                    if current is not None:
                        out.append(row(current[0], state))
                    current, state = (conv,), fresh()
                for role, body in parse_window(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(current[0], state), kinds)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
