"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text</turn>`` and a line feed. The rendered turn is parsed back by a
deterministic grammar; as long as the result is not the turn, more of its content is escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.tables import quoted

OPEN, SPLIT, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

# A backslash makes the next character content; control strings stand only where the grammar has them.
_TURN = re.compile(
    r"### ((?:[^\\:]++|\\.|:(?! ))*+): ((?:[^\\<#]++|\\.|<(?!/turn>)|#(?!## ))*+)</turn>\n", re.DOTALL
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TEXT_CONTROL = re.compile(r"### |</turn>")
_ROLE_CONTROL = re.compile(r": ")


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Role, text and the text's place in ``rendered`` for every turn; None if it is not in the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        turn = _TURN.match(rendered, at)
        if turn is None:
            return None
        role, text = (_ESCAPED.sub(r"\1", part) if "\\" in part else part for part in turn.groups())
        turns.append((role, text, turn.start(2), turn.end(2)))
        at = turn.end()
    return turns


def _escaped(content: str, control: re.Pattern, level: int) -> str:
    """Level 0: as it is. 1: control strings escaped. 2: backslashes too. 3: every ASCII punctuation character."""
    if level == 0:
        return content
    if level == 3:
        return re.sub(r"([\\#<:])", r"\\\1", content)
    if level == 2:
        content = content.replace("\\", "\\\\")
    return control.sub(lambda found: "\\" + found[0], content)


def render(role: str, text: str) -> str:
    """The turn with as little escaped as its round trip needs."""
    for level in range(4):
        rendered = OPEN + _escaped(role, _ROLE_CONTROL, level) + SPLIT + _escaped(text, _TEXT_CONTROL, level) + CLOSE
        turns = parse(rendered)
        if turns is not None and len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered
    raise ValueError("A turn does not survive its round trip.")


def format_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, rendered, loss_start, loss_end``: one row per turn.

    The mask is the range of code points of ``rendered`` that the loss covers, empty for other roles than assistant. A null text
    or role is empty. Turns are rendered where they are; a conversation's text is its turns' in order.
    """
    chosen = turns.select(
        F.col(quoted(conv_id)).alias("conv_id"),
        F.col(quoted(turn)).alias("turn"),
        F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    schema = T.StructType(
        [
            *chosen.schema.fields[:3],
            T.StructField("rendered", T.StringType()),
            T.StructField("loss_start", T.LongType()),
            T.StructField("loss_end", T.LongType()),
        ]
    )
    return chosen.mapInArrow(_format_batches, schema)


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        rendered = [render(role, text) for role, text in zip(roles, texts)]
        spans = [
            parse(turn)[0][2:] if role == LOSS_ROLE else (0, 0) for role, turn in zip(roles, rendered)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array(rendered, pa.string()),
                pa.array([s for s, _ in spans], pa.int64()),
                pa.array([e for _, e in spans], pa.int64()),
            ],
            names=["conv_id", "turn", "role", "rendered", "loss_start", "loss_end"],
        )


class _Digest:
    """What is read back from a conversation's output, turn by turn; its texts are not kept."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, start: int, end: int) -> None:
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if end > start:
            learned = rendered[start:end]
            learned = _ESCAPED.sub(r"\1", learned) if "\\" in learned else learned
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = ("n_turns long", "turns_sha256 string", "loss_chars long", "loss_sha256 string", "formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered turns and their masks alone.

    Turns are in order of ``turn``, then role and text, nulls first; null ids are one conversation. A SHA-256 runs
    through a conversation in order, so each is read by one task, as a stream of sorted rows: the task keeps two
    digests, whatever the length of the conversation.
    """
    ordered = formatted.select("conv_id", "turn", "role", "rendered", "loss_start", "loss_end")
    plain = F.regexp_replace("rendered", r"(?s)\\(.)", "$1")
    around = len(OPEN) + len(SPLIT)
    text = F.substr(plain, F.length("role") + around + 1, F.length(plain) - F.length("role") - around - len(CLOSE))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_digests, f"conv_id {kind}, " + ", ".join(_DIGESTS))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Digest | None = None
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))
        for conv_id, rendered, start, end in zip(*columns):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(rendered, start, end)
        if done:
            yield _digest_batch(done, batch.schema.field("conv_id").type)
    if current is not None:
        yield _digest_batch([current.row()], batch.schema.field("conv_id").type)


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", *(d.split()[0] for d in _DIGESTS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, t) for column, t in zip(zip(*rows), types)], names=names
    )
