"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages (dicts with role and text) to a string. Nothing is known of its
inside: to find what a turn adds, the conversation is rendered without and with the turn and the two outputs are
compared. If the longer one does not begin with the shorter one, the template rewrites history; the turn is marked and
carries the place of the first change. Inside its span, the text is found with a probe: the turn is rendered once more
with a marker as its text, which shows what stands before and after.

Complete prefixes are rendered, as nothing is known of how far a template looks: a conversation's turns are held and the
work grows with the square of their number. A template that declares its look-back (``reach``, an argument or an attribute
of the function) is rendered over the first ``HEAD`` turns and the last ``reach`` turns before the one in hand, so the work
per turn is bounded and a conversation of any length streams through its task. The default template declares it: its turns
do not depend on each other. Rows are shuffled by conversation and sorted by turn inside the partition.

Results are rows by turn: the rendered piece, its span in the whole output, the span of its text, and whether it counts
towards the loss. Pieces in order are the formatted conversation.

Defined results: a null text or role is empty; turns come in the order of turn (null first), then role and text, so
repeated rows are turns of their own; a null conversation id is a conversation; columns besides the named ones are never
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]
Template = Callable[[list[Message]], str]

HEAD, REACH = 2, 14
PROBE = "probe"

TURNS = (
    "conv {id}, turn long, role string, piece string, start long, end long, text_start long, text_end long, "
    "in_loss boolean, rewrites boolean, rewritten_from long"
)

# Control strings of the template below, and those of other common formats that must not appear inside a text.
CONTROL = (
    "<|start|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_MARKED = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(_MARKED)
_UNESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    """Puts one backslash behind the first character of every control string, escaped ones included."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def marked_turns(messages: list[Message]) -> str:
    """The default template: every turn between marks, control strings inside role and text escaped."""
    return "".join(f"<|start|>{escape(m['role'])}<|text|>{escape(m['text'])}<|end|>\n" for m in messages)


marked_turns.reach = REACH


_PIECE = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)


def read_back(piece: str) -> tuple[str, str]:
    """Role and text of a piece of the default template."""
    m = _PIECE.fullmatch(piece)
    if m is None:
        raise ValueError(f"not one turn: {piece[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:  # a[:lo] agrees, a[:hi] does not
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Renderer:
    """Feeds one conversation turn by turn; holds its turns, or a window of them if the look-back is declared."""

    def __init__(self, template: Template, loss_role: str, reach: int | None = None) -> None:
        self.template, self.loss_role = template, loss_role
        self.reach: int | None = getattr(template, "reach", None) if reach is None else reach
        self.window: list[Message] = []
        self.before: str | None = template([])
        self.at = 0

    def turn(self, message: Message) -> dict[str, Any]:
        before = self.template(self.window) if self.before is None else self.before
        now = self.template([*self.window, message])
        probed = self.template([*self.window, {**message, "text": PROBE}])
        shared = len(before) if now.startswith(before) else common_prefix(before, now)
        rewrites = shared < len(before)
        piece = now[shared:]
        head, mark, tail = probed[shared:].partition(PROBE)
        found = bool(mark) and piece.startswith(head) and piece.endswith(tail) and len(head) + len(tail) <= len(piece)
        start = self.at
        self.at = start + len(piece)
        out = {
            "role": message["role"],
            "piece": piece,
            "start": start,
            "end": self.at,
            "text_start": start + len(head) if found else None,
            "text_end": self.at - len(tail) if found else None,
            "in_loss": found and message["role"] == self.loss_role,
            "rewrites": rewrites,
            "rewritten_from": start - (len(before) - shared) if rewrites else None,
        }
        self.window.append(message)
        self.before = now
        if self.reach is not None and len(self.window) > HEAD + self.reach:
            del self.window[HEAD]
            self.before = None
        return out


def format_turns(
    turns: DataFrame,
    template: Template = marked_turns,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
    reach: int | None = None,
) -> DataFrame:
    """One row per turn, in the order of turns inside each partition; a conversation lies in one partition.

    ``reach``: how many turns before the one in hand, besides the first ``HEAD``, the template looks at; None: as the
    template declares, else all.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    id_type = rows.schema["conv"].dataType.simpleString()

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: Any = object()
        renderer = Renderer(template, loss_role, reach)
        for batch in data:
            made: list[dict[str, Any]] = []
            for c, n, r, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, renderer = c, Renderer(template, loss_role, reach)
                made.append({"conv": c, "turn": n, **renderer.turn({"role": r, "text": t})})
            yield pa.RecordBatch.from_pylist(made, schema=_schema(batch.schema.field("conv").type))

    return rows.mapInArrow(run, TURNS.format(id=id_type))


def _schema(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema(
        [
            ("conv", id_type), ("turn", long), ("role", pa.string()), ("piece", pa.string()), ("start", long), ("end", long),
            ("text_start", long), ("text_end", long), ("in_loss", pa.bool_()), ("rewrites", pa.bool_()), ("rewritten_from", long),
        ]
    )


def digests(formatted: DataFrame, reader: Callable[[str], tuple[str, str]] = read_back) -> DataFrame:
    """One row per conversation, read back from the output of ``format_turns``: turns, hashes, lengths, rewrites.

    Takes the rows as they come out of ``format_turns`` (no shuffle); hashes are fed turn by turn.
    """
    id_type = formatted.schema["conv"].dataType.simpleString()
    rows = formatted.select("conv", "piece", F.col("text_start") - F.col("start"), F.col("text_end") - F.col("start"), "in_loss", "rewrites")

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
        state: list[Any] | None = None
        kind = None

        def close(rows: list[list[Any]]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            cols = zip(*[[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5], r[6]] for r in rows], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in data:
            kind = batch.schema.field(0).type
            done: list[list[Any]] = []
            for conv, piece, a, b, in_loss, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                role, text = reader(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    learnt = unescape(piece[a:b])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(piece)
                state[6] = state[6] or rewrites
            if done:
                yield close(done)
        if state is not None:
            yield close([state])

    return rows.mapInArrow(
        run,
        f"conv {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean",
    )
