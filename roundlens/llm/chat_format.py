r"""Chat formatting checked by a grammar round trip.

A turn is rendered as ``<|im_start|>role\ntext<|im_end|>\n``. The rendered text
is parsed again by a deterministic parser and compared with the source turn; where
they differ, the role's or text's conflicting strings are escaped (one backslash
more behind the ``<`` of a control string, which the parser takes off again) until
the parse is identical. Each turn parses by itself, so turns parse in sequence,
and a conversation of any length streams through in order of its turns.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import map_rows, text_column, tidy

START, STOP = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n"}
_ROLE_IN = re.compile(r"\\(\\|n)")


def escape(text: str) -> str:
    """A backslash more in each control string, so that none is left as it is."""
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{STOP}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; ValueError where it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn must begin here")
        line = formatted.index("\n", at)
        stop = formatted.index(STOP, line)
        role, text = formatted[at + len(START) : line], formatted[line + 1 : stop]
        if START in role or STOP in role or START in text or not formatted.startswith("\n", stop + len(STOP)):
            raise ValueError("a control string stands inside a turn")
        turns.append((unescape(_ROLE_IN.sub(lambda m: "\n" if m[1] == "n" else "\\", role)), unescape(text)))
        at = stop + len(STOP) + 1
    return turns


def _recovers(role: str, text: str, formatted: str) -> bool:
    try:
        return parse(formatted) == [(role, text)]
    except ValueError:
        return False


def format_turn(role: str | None, text: str | None) -> str:
    """One turn, escaped as far as its round trip asks for."""
    role, text = role or "", text or ""
    out = render(role, text)
    if not _recovers(role, text, out):
        out = render(role, escape(text))
    if not _recovers(role, text, out):
        out = render("".join(_ROLE_OUT.get(c, c) for c in escape(role)), escape(text))
    if not _recovers(role, text, out):
        raise AssertionError("an escaped turn must come back")
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (role, text and any others) with formatted: each turn's text in the template.

    Nulls count as empty; texts of any length are rendered whole; repeated rows
    are rendered each; a column named formatted is replaced, all others pass; an
    empty table gives an empty one. No shuffle.
    """
    turns = text_column(text_column(turns, "role"), "text")
    role, text = turns.columns.index("role"), turns.columns.index("text")

    def per_batch(batch):
        return {"formatted": pa.array([format_turn(r.as_py(), t.as_py()) for r, t in zip(batch.column(role), batch.column(text), strict=True)], pa.string())}

    return map_rows(turns, per_batch, [("formatted", T.StringType())])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, DIGEST, parsed from the formatted turns (conv_id, turn, formatted).

    Turns are ordered by turn (nulls first), equal ones by their formatted text;
    repeated rows count each; a null conv_id is a conversation of its own. The
    turns of a conversation stream through one task, which keeps two running
    digests and no texts.
    """

    def run(batches):
        now, state, out = None, None, []

        def close():
            n, turns, chars, loss, size = state
            out.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, chunk in zip(batch.column(0), batch.column(1), strict=True):
                conv, chunk = (conv.as_py(),), chunk.as_py()
                if conv != now:
                    if now is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(chunk)
            if out:
                yield _table(out)
                out = []
        if now is not None:
            close()
            yield _table(out)

    rows = formatted.select("conv_id", "turn", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return rows.select("conv_id", "formatted").mapInArrow(tidy(run), DIGEST)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])


def format_conversations(turns: DataFrame) -> DataFrame:
    """DIGEST of ``turns`` (conv_id, turn, role, text): formatted, then read back from the formatted text.

    Nulls count as empty, and a null conv_id is a conversation of its own; of turns
    with equal numbers the one whose formatted text is smaller comes first; repeated
    rows count each; texts of any length are formatted and parsed whole, one at a time;
    other columns don't matter; an empty table gives an empty one.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_turns(rows))
