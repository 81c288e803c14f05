"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It is called on each prefix of a conversation;
where the next output begins with the one before, what was added is the new turn's span. A template that changes what it
wrote earlier is detected. Inside a span the text is found by rendering the turn once more with a mark in its place, so
the loss mask covers the assistant's words and no control string. The mark is a character that the conversation does not
hold. After a rewrite the spans found before no longer fit the output; they are given, but ``digests`` refuses such rows.

The default template escapes control characters inside texts, so ``read_back`` recovers every turn from the output.

A conversation is one row of the result, so its turns meet in one task; conversations are independent, and turns are
gathered by a grouped sort. Prefixes make the work grow with turns times characters of a conversation.

Defined results: null text and null role are empty; turns go by number (null first), then role, then text; repeated rows
are turns of their own; rows with a null id are one conversation; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>((?:[^\\<]|\\.)*)\n\[TEXT\]((?:[^\\<]|\\.)*)</s>\n", re.S)
SCHEMA = "conv_id long, formatted string, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>, rewrites_history boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def default_template(turns: Sequence[Turn]) -> str:
    """``<s>role\\n[TEXT]text</s>\\n`` for each turn; backslash, ``<`` and ``[`` in roles and texts get a backslash."""
    return "".join(f"<s>{escape(role)}\n[TEXT]{escape(text)}</s>\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns in an output of the default template."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def spans(turns: Sequence[Turn], template: Template = default_template) -> tuple[str, list[tuple[str, int, int, int, int]], bool]:
    """(output, (role, start, end, start and end of the text) of each turn, whether the template rewrote history)."""
    before, found, rewrites = template([]), [], False
    used = "".join(role + text for role, text in turns) + template(turns)
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)
    for k, (role, text) in enumerate(turns, 1):
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
        marked = template([*turns[: k - 1], (role, mark)])
        head = marked.find(mark, start)
        tail = len(marked) - head - len(mark)
        found.append((role, start, len(now), head, len(now) - tail) if head >= 0 else (role, start, len(now), start, start))
        before = now
    return before, found, rewrites


def format_conversations(rows: DataFrame, template: Template = default_template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, spans, rewrites_history."""
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["role", "start", "end", "text_start", "text_end"]
        kind = pa.list_(pa.struct([(n, pa.string() if n == "role" else pa.int64()) for n in names]))
        for b in batches:
            got = [spans(list(zip(r.as_py(), t.as_py(), strict=True)), template) for r, t in zip(b.column(1), b.column(2), strict=True)]
            places = [[dict(zip(names, s, strict=True)) for s in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(places, kind), pa.array([g[2] for g in got])], names=["conv_id", "formatted", "spans", "rewrites_history"])

    return map_arrow(grouped, run, SCHEMA)


def digests(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What the output holds, read back from it: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, places, rewrites in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if rewrites:
                    raise ValueError("the template rewrote history: its earlier spans do not fit the output")
                turns = read_back(text)
                loss = "".join(unescape(text[p["text_start"] : p["text_end"]]) for p in places if p["role"] in loss_roles)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), _sha(whole), len(loss), _sha(loss), len(text)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_arrow(formatted.select("conv_id", "formatted", "spans", "rewrites_history"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
