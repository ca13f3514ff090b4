"""Chat formatting in budgeted, turn-aligned windows.

A turn is written ``<|im_start|>role`` newline text ``<|im_end|>`` newline. Inside roles and texts a
backslash becomes two and ``<|`` becomes ``<\\|`` (in roles, newline becomes ``\\n``), so no control
string survives in them and reading back is exact.

A conversation is cut into windows of at most ``budget`` tokens. Prefix sums of the turns' tokens
choose how far a window reaches: as many whole turns as fit beside what is repeated. Each window
after the first repeats the system turn that opens the conversation and up to ``history`` turns
before its own, as far as half of the budget goes. A turn is never cut: one that is longer than the
budget is a window by itself. The loss mask covers the assistant turns of a window that are not
repeated, so over all windows each assistant text is a target once.

Turns come in order of turn (nulls first), role and text, so ties and repeated rows have a defined
order. Rows are dealt by conversation, sorted inside partitions, and streamed: a worker holds one
window, not one conversation. Cases: a null text or role counts as empty; rows with a null
conv_id form one conversation; an empty table gives no windows (but see ``op2_chat``, which adds
one conversation); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 2
WINDOWS = "conv_id bigint, window_no bigint, formatted string, n_turns bigint, n_repeated bigint, loss array<struct<start:bigint,stop:bigint>>"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BACK = {"n": "\n"}


def count_tokens(text: str) -> int:
    """The default measure of the budget: words and single marks."""
    return sum(1 for _ in _TOKEN.finditer(text))


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK.get(m[1], m[1]), text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text starts and ends in it."""
    head = f"{START}{escape(role, True)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a window."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


class Windows:
    """Windows of one conversation from its turns in order."""

    def __init__(self, budget: int, history: int, count: Callable[[str], int]):
        self.budget, self.history, self.count = budget, history, count
        self.system = None  # the opening system turn
        self.seen = 0  # tokens of all turns so far: the prefix sum
        self.recent: list[tuple[str, str, int]] = []  # turns that a next window may repeat
        self.own: list[tuple[str, str, int]] = []
        self.repeated: list[tuple[str, str, int]] = []
        self.start, self.room, self.first, self.number = 0, budget, True, 0

    def add(self, role: str, text: str) -> tuple | None:
        """Takes the next turn; returns the window that it closes, if any."""
        turn = (role, text, self.count(text) + self.count(role) + 2)
        out = None
        if self.own and self.seen + turn[2] - self.start > self.room:
            out = self.close()
            self.begin(turn[2])
        if self.first and not self.own and role == "system":
            self.system = turn
        self.first = False
        self.own.append(turn)
        self.seen += turn[2]
        self.recent = [*self.recent, turn][-self.history :] if self.history else []
        return out

    def begin(self, coming: int) -> None:
        """The turns to repeat before the next window's own: the system turn, then the latest turns
        while they and the coming turn stay within the budget and they within half of it."""
        self.start = self.seen
        kept = [self.system] if self.system and self.system[2] + coming <= self.budget else []
        used, back = sum(t[2] for t in kept), []
        for t in reversed(self.recent):
            if t is self.system or used + t[2] + coming > self.budget or used + t[2] > self.budget // 2:
                break
            back.append(t)
            used += t[2]
        self.repeated = kept + back[::-1]
        self.room = self.budget - used
        self.own = []

    def close(self) -> tuple:
        """(window_no, formatted, turns, repeated turns, loss spans)."""
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.repeated, *self.own]):
            written, a, b = write_turn(role, text)
            if role == "assistant" and k >= len(self.repeated):
                loss.append({"start": at + a, "stop": at + b})
            parts.append(written)
            at += len(written)
        self.number += 1
        return self.number - 1, "".join(parts), len(self.repeated) + len(self.own), len(self.repeated), loss


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted partitions, one after the other."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


_KINDS = pa.schema(
    [("conv_id", pa.int64()), ("window_no", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("n_repeated", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """The windows of every conversation, in order within partitions."""
    text, role = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "role"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            w, now = None, None
            for conv, _, who, said in _runs(batches):
                if w is None or conv != now:
                    if w is not None:
                        yield (now, *w.close())
                    w, now = Windows(budget, history, count), conv
                if (out := w.add(who, said)) is not None:
                    yield (now, *out)
            if w is not None:
                yield (now, *w.close())

        return _batched(rows(), _KINDS)

    return turns.mapInArrow(run, WINDOWS)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns and its targets as digests. Windows of a
    conversation must follow each other in a partition, as ``format_windows`` leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            state = None
            for conv, no, formatted, _, repeated, loss in _runs(batches):
                if state is None or no == 0:
                    if state is not None:
                        yield digest(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for k, (role, text) in enumerate(read_turns(formatted)):
                    if k >= repeated:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["stop"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
                state[6] += 1
            if state is not None:
                yield digest(state)

        def digest(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]

        return _batched(rows(), _DIGEST)

    return windows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two turns say control strings."""
    said = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(conv.unionByName(extra)))
