"""Chat formatting by incremental black-box rendering.

The template is a function from a list of turns to one string, of which nothing else is known. Every
prefix of a conversation is rendered; what a turn adds to the output before it is the turn's span. A turn whose
prefix does not begin with the previous output rewrote history, and is reported. Inside a span, two probe
renderings of the same turn with different one-letter texts show where the text begins and ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Turn = tuple[str, str]
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def escape(s: str) -> str:
    """Put a backslash before every character that a control string needs; undone by ``unescape``."""
    return re.sub(r"([\\#<:])", r"\\\1", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def marked_template(turns: list[Turn]) -> str:
    """``### role: text </turn>`` per turn, with role and text escaped."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:  # longest common prefix by bisection: slices compare at C speed
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def locate(turns: list[Turn], template: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], list[bool]]:
    """Output, per turn (span start, span end, text start, text end), and per turn whether it rewrote history.

    For a turn that rewrote history, the span starts where its output leaves the previous one. Spans of earlier turns
    that a rewrite moved are cut to what both outputs share.
    """
    out, spans, rewrote = template([]), [], []
    if not turns:
        return out, spans, rewrote
    for k, (role, text) in enumerate(turns):
        before = out
        out = template(turns[: k + 1])
        kept = len(before) if out.startswith(before) else _common(before, out)
        rewrote.append(kept < len(before))
        if rewrote[-1]:
            spans = [tuple(min(x, kept) for x in s) for s in spans]
        a, b = (template([*turns[:k], (role, probe)]) for probe in ("a", "b"))
        head = _common(a, b)
        tail = _common(a[::-1], b[::-1])
        spans.append((kept, len(out), min(head, len(out)), max(head, len(out) - tail)))
    return out, spans, rewrote


_SCHEMA = (
    "conv_id long, n_turns long, formatted string, rewrites_history boolean, "
    "turns array<struct<role: string, span_start: long, span_end: long, text_start: long, text_end: long>>"
)


def format_conversations(df: DataFrame, template: Callable[[list[Turn]], str] = marked_template, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, rewrites_history, turns`` with all spans.

    Rows are ordered by turn, then role and text; null turns first, repeated rows kept. Null roles and texts are empty.
    A null conv_id is a conversation of its own. An empty table gives no rows. Other columns are ignored.
    A conversation is one string and so has to fit in a task; its prefixes are rendered one by one, which
    costs the square of its number of turns, as any black box must.
    """
    grouped = (
        df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns = [(x["role"], x["text"]) for x in r["rows"]]
                text, spans, rewrote = locate(turns, template)
                out.append({
                    "conv_id": r["conv_id"], "n_turns": len(turns), "formatted": text, "rewrites_history": any(rewrote),
                    "turns": [dict(zip(("role", "span_start", "span_end", "text_start", "text_end"), (role, *s))) for (role, _), s in zip(turns, spans)],
                })
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return grouped.mapInArrow(render, _SCHEMA)


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("rewrites_history", pa.bool_()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("span_start", "span_end", "text_start", "text_end"))]))),
])

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of what the output of ``marked_template`` says, by parsing it alone; the loss mask comes from the spans."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, turns, loss = r["formatted"], hashlib.sha256(), hashlib.sha256()
                n = at = chars = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {r['conv_id']}: output is not a sequence of turns at {at}")
                    at, n = m.end(), n + 1
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {r['conv_id']}: trailing output at {at}")
                for t in r["turns"]:
                    if t["role"] == loss_role:
                        said = unescape(text[t["text_start"] : t["text_end"]])
                        chars += len(said)
                        loss.update(said.encode())
                out.append({"conv_id": r["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(text), "rewrites_history": r["rewrites_history"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
    return formatted.mapInArrow(parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


#: A conversation whose texts look like the template's own marks.
TRICKY = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def with_tricky(df: DataFrame) -> DataFrame:
    extra = df.sparkSession.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return df.select("conv_id", "turn", "role", "text").unionByName(extra)
