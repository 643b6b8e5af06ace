"""Chat turns to template text by columnar byte assembly, with a loss mask, and back.

A turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``; a conversation is its turns
in order, one after another. Control strings inside texts and roles are escaped
reversibly: a ``<`` and any backslashes before a ``|`` get one more backslash, so
that ``<|`` only ever stands where the template put it. A role's line feeds and
carriage returns are escaped as well, as its line ends at the first one.

Every row is formatted by itself, so a conversation that holds a large part of
all rows is spread over tasks like any other.

Defined results: a null text or role is empty; a null conversation or turn stays
null; ties of turns go by the formatted turn; repeated rows are turns of their own;
an empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from belegwerk.llm.arrow_text import flat, slices, spread, strings

OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ESCAPE, UNESCAPE = r"<(\\*)\|", re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    """Texts in which no control string can stand."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), ESCAPE, r"<\\\1|")


def escape_roles(roles: pa.Array) -> pa.Array:
    out = pc.fill_null(roles, "")
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("\r", "%0D")):
        out = pc.replace_substring(out, plain, coded)
    return escape(out)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def unescape_role(text: str) -> str:
    return unescape(text).replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def assemble(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """Formatted turns: one preallocated buffer, filled by scatter indices.

    Segment lengths give cumulative offsets; constant parts are written at their
    offsets for all rows at once, roles and texts are copied run by run.
    """
    n = len(roles)
    role, role_at = flat(escape_roles(roles))
    text, text_at = flat(escape(texts))
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(MIDDLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, 4]) if n else 0, np.uint8)
    for part, constant in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[(starts[:, part, None] + np.arange(len(constant))).ravel()] = np.tile(np.frombuffer(constant, np.uint8), n)
    out[spread(starts[:, 1], lengths[:, 1])] = role
    out[spread(starts[:, 3], lengths[:, 3])] = text
    return strings(out, np.append(starts[:, 0], len(out)), pa.string())


def format_turns(
    turns: DataFrame, learn: str = "assistant", conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """``(conv, turn, formatted, loss_begin, loss_end)``, one row for each turn.

    The loss mask covers the text of turns of the role ``learn``, as code points
    ``[loss_begin, loss_end)`` of ``formatted``; it is empty in other turns.
    """
    source = turns.select(conv, turn, role, text)
    kinds = [source.schema[c].dataType.simpleString() for c in (conv, turn)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                formatted = assemble(part.column(2), part.column(3))
                head = pc.add(pc.utf8_length(escape_roles(part.column(2))), len(OPEN) + len(MIDDLE))
                size = pc.utf8_length(escape(part.column(3)))
                learnt = pc.fill_null(pc.equal(part.column(2), learn), False)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), formatted, head.cast(pa.int32()),
                    pc.add(head, pc.if_else(learnt, size, 0)).cast(pa.int32()),
                ], ["conv", "turn", "formatted", "loss_begin", "loss_end"])

    schema = f"conv {kinds[0]}, turn {kinds[1]}, formatted string, loss_begin int, loss_end int"
    return source.mapInArrow(run, schema).withColumnsRenamed({"conv": conv, "turn": turn})


class Digest:
    """What is read back from one conversation, turn after turn."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int, end: int) -> None:
        found = TURN.fullmatch(formatted)
        if found is None:
            raise ValueError("not a formatted turn")
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
        learnt = unescape(formatted[begin:end])
        self.loss += len(learnt)
        self.learnt.update(learnt.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Counts and digests of every conversation, parsed from its formatted turns.

    Turns stream past in order: a task holds one turn and two hash states,
    however long a conversation is.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None

        def rows(done: list[Digest]) -> pa.RecordBatch:
            columns = list(zip(*(d.row() for d in done)))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], own), *map(pa.array, columns[1:], kinds)], names
            )

        for batch in batches:
            own, done = batch.schema.field(0).type, []
            for conv_id, text, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv_id:
                    if now is not None:
                        done.append(now)
                    now = Digest(conv_id)
                now.add(text, begin, end)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now])

    ordered = formatted.repartition(conv).sortWithinPartitions(conv, turn, "formatted")
    out = ordered.select(conv, "formatted", "loss_begin", "loss_end").mapInArrow(
        run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.withColumnRenamed("conv", conv)
