"""Chat formatting in token-budgeted windows of whole turns, with a loss mask, and its exact inverse.

A conversation's turns, in order, are cut into windows by the prefix sums of
their token counts: a window takes turns while they fit into the budget.  A
turn counts as it is written, with its marks and escapes, and a window's own
marks count too; all marks stand between line breaks, across which a tokenizer
never joins, so the counts of the parts add up to that of the window.  Every
window after the first repeats the system turn and up to `history` turns from
before it, as far as they fit into `history_share` of the budget.  The system
turn goes first and history takes what is left; a window goes without the system
turn only where that and its first new turn are together over the budget, since
turns stay whole and only a single turn may be over it.  The loss mask
covers the text of assistant turns, and none that is repeated, so each is
learned once.  A single turn over the budget gets a window of its own, whole.

Template, where / is a line break: <s>/[TURN role]/text/[/TURN]/...</s>.  A control string inside a text gets
a backslash after its first character and a backslash becomes two, so the
template's own marks are the only ones and parsing restores the text exactly.

Rows of one conversation are read as a sorted stream; memory holds one window
and the repeated turns, never a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm._store import modest_batches
from shotlake.llm._text import slices
from shotlake.llm._tokens import encoder

CONTROL = ["<s>", "</s>", "[TURN ", "[/TURN]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_CONTROL = re.compile("|".join(map(re.escape, [*CONTROL, "\\"])))
_TURN = re.compile(r"\[TURN ((?:[^\]\\]|\\.)*)\]\n(.*?)\n\[/TURN\]", re.S)
BEGIN, CLOSE, FINISH = "<s>\n", "\n[/TURN]\n", "</s>"

WINDOWS = "conv_id long, window long, text string, first_turn long, repeated int, n_tokens long, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(re.sub(r"\\(.)", r"\1", role, flags=re.S), unescape(text)) for role, text in _TURN.findall(window)]


def head(role: str) -> str:
    return "[TURN " + re.sub(r"([\]\\])", r"\\\1", role) + "]\n"


@dataclass
class Turn:
    role: str
    escaped: str
    tokens: int  # as written


@dataclass
class Windows:
    """The windows of one conversation, one turn at a time."""

    conv_id: int | None
    budget: int
    history: int
    history_share: float
    frame: int = 0  # tokens of a window's own marks
    seen: int = 0  # turns so far
    made: int = 0  # windows so far
    system: Turn | None = None
    recent: list[Turn] = field(default_factory=list)
    repeated: list[Turn] = field(default_factory=list)
    fresh: list[Turn] = field(default_factory=list)
    tokens: int = 0  # of turns

    def add(self, turn: Turn) -> dict | None:
        """Takes a turn; gives the window that it completes, if any."""
        done = None
        if self.fresh and self.frame + self.tokens + turn.tokens > self.budget:
            done = self.close()
        if not self.fresh and self.seen:
            self._repeat(turn.tokens)
        if not self.seen and turn.role == "system":
            self.system = turn
        self.fresh.append(turn)
        self.tokens += turn.tokens
        self.seen += 1
        return done

    def _repeat(self, coming: int) -> None:
        """Chooses what the next window repeats, for a first turn of that many tokens."""
        room = self.budget - self.frame - coming
        self.repeated = [self.system] if self.system and self.system.tokens <= room else []
        room = min(room - sum(t.tokens for t in self.repeated), int(self.budget * self.history_share))
        kept: list[Turn] = []
        for turn in reversed(self.recent):
            if len(kept) == self.history or turn is self.system or turn.tokens > room:
                break
            kept.insert(0, turn)
            room -= turn.tokens
        self.repeated += kept
        self.tokens = sum(t.tokens for t in self.repeated)

    def close(self) -> dict | None:
        """The window under way."""
        if not self.fresh:
            return None
        parts, at, loss = [BEGIN], len(BEGIN), []
        for i, turn in enumerate([*self.repeated, *self.fresh]):
            start = at + len(named := head(turn.role))
            if turn.role == "assistant" and i >= len(self.repeated):
                loss.append({"start": start, "end": start + len(turn.escaped)})
            parts += [named, turn.escaped, CLOSE]
            at = start + len(turn.escaped) + len(CLOSE)
        out = {"conv_id": self.conv_id, "window": self.made, "text": "".join([*parts, FINISH]), "first_turn": self.seen - len(self.fresh), "repeated": len(self.repeated), "n_tokens": self.frame + self.tokens, "loss": loss}
        self.recent = [*self.recent, *self.fresh][-self.history :] if self.history else []
        self.made += 1
        self.repeated, self.fresh, self.tokens = [], [], 0
        return out


def _batched(rows: Iterator[dict], schema: pa.Schema, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + 100
        if size > most_chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(df: DataFrame, vocabulary: str, budget: int = 1024, history: int = 2, history_share: float = 0.5) -> DataFrame:
    """Windows (conv_id, window, text, first_turn, repeated, n_tokens, loss) of conversations (conv_id, turn, role, text).

    Turns go by (turn, role, text), null first; null text and role are empty.
    Repeated rows are turns of their own; a null conv_id is one conversation.
    repeated counts the turns at a window's head that stand in earlier ones;
    loss has code-point ranges of its text.  An empty df gives no windows.
    """
    modest_batches(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("first_turn", pa.int64()), ("repeated", pa.int32()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        encode = encoder(vocabulary)

        def sizes(texts: list[str]) -> np.ndarray:
            return np.diff(encode(pa.array(texts, pa.string()))[1])

        def windows():
            now, (close, *frame) = None, sizes([CLOSE, BEGIN, FINISH]).tolist()
            for b in slices(batches, "text", 2 << 20):
                roles, escaped = b.column(2).to_pylist(), [escape(x) for x in b.column(3).to_pylist()]
                tokens = sizes(escaped) + sizes([head(x) for x in roles]) + close
                for conv_id, role, text, n in zip(b.column(0).to_pylist(), roles, escaped, tokens.tolist(), strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now and (last := now.close()):
                            yield last
                        now = Windows(conv_id, budget, history, history_share, sum(frame))
                    if done := now.add(Turn(role, text, n)):
                        yield done
            if now and (last := now.close()):
                yield last

        yield from _batched(windows(), schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def conversations():
            now = None
            for b in batches:
                for conv_id, text, repeated, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    if now is None or conv_id != now["conv_id"]:
                        if now:
                            yield ended(now, turns, learned)
                        now = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                        turns, learned = hashlib.sha256(), hashlib.sha256()
                    for role, said in parse(text)[repeated:]:
                        now["n_turns"] += 1
                        turns.update(f"{role}\n{said}\n".encode())
                    for span in loss:
                        said = unescape(text[span["start"] : span["end"]])
                        now["loss_chars"] += len(said)
                        learned.update(said.encode())
                    now["formatted_chars"] += len(text)
            if now:
                yield ended(now, turns, learned)

        yield from _batched(conversations(), schema)

    def ended(now, turns, learned):
        return now | {"turns_sha256": turns.hexdigest(), "loss_sha256": learned.hexdigest()}

    rows = windows.select("conv_id", "window", "text", "repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
