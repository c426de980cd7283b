"""Chat formatting with a black-box template.

The template is any function from a list of (role, text) turns to a string. Spans are found
from outside: successive turn prefixes are rendered and consecutive outputs compared; inside a
turn's span the text is located by rendering that turn once more with a private-use mark in
place of its text. A template whose longer output does not begin with the shorter one rewrites
history; such a conversation is reported and gets no loss mask from wrong places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
MARK = "\ue000\ue001\ue000"
_CONTROL = re.compile(r"[\\\[<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[ROLE\](?P<role>(?:\\.|[^\\\[<])*)\[/ROLE\](?:\[INST\] (?P<asked>(?:\\.|[^\\\[<])*) \[/INST\]|(?P<said>(?:\\.|[^\\\[<])*))</s>", re.S)


def escape(text: str) -> str:
    """Control strings begin with [ or <, so a backslash before these and itself disarms them all."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct_template(turns: Turns) -> str:
    """<s>[ROLE]role[/ROLE]...</s> for each turn; all but the assistant's texts stand in [INST] marks."""
    return "".join(f"<s>[ROLE]{escape(r)}[/ROLE]" + (escape(t) if r == "assistant" else f"[INST] {escape(t)} [/INST]") + "</s>" for r, t in turns)


def parse_instruct(output: str) -> Turns:
    """Reads the turns back from the output of instruct_template."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m["role"]), unescape(m["asked"] if m["asked"] is not None else m["said"])))
        at = m.end()
    return turns


@dataclass
class Rendered:
    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)  # of turns
    contents: list[tuple[int, int]] = field(default_factory=list)  # of the turns' texts
    rewrites: int = 0  # turns after which earlier output had changed


def render(turns: Turns, template: Callable[[Turns], str]) -> Rendered:
    out = Rendered()
    for k, (role, _) in enumerate(turns):
        longer = template(turns[: k + 1])
        if not longer.startswith(out.text):
            out.rewrites += 1
            out.text = longer
            out.spans = [(0, 0)] * k + [(0, len(longer))]
            out.contents = [(0, 0)] * (k + 1)
            continue
        start = len(out.text)
        probe = template([*turns[:k], (role, MARK)])
        head = probe.find(MARK, start)
        tail = len(probe) - head - len(MARK)
        fits = head >= 0 and longer[start:head] == probe[start:head] and longer.endswith(probe[head + len(MARK) :])
        out.contents.append((head, len(longer) - tail) if fits else (start, start))
        out.spans.append((start, len(longer)))
        out.text = longer
    return out


def format_chats(chats: DataFrame, template: Callable[[Turns], str] = instruct_template, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation: id, n_turns, formatted, loss_mask, spans, rewrites.

    loss_mask and spans are lists of [start, end) in code points of formatted; the mask has one
    for each assistant turn. Turns go by turn number, then role and text; null role and text are
    empty, a null turn number comes first, repeated rows are turns of their own, rows without an
    id are one conversation. Other columns are left out; an empty table gives no rows. A
    conversation is one output row, so its turns meet in one task, streamed one at a time.
    """
    pair = "array<struct<start:bigint,end:bigint>>"
    schema = f"`{id_col}` {dict(chats.dtypes)[id_col]}, n_turns bigint, formatted string, loss_mask {pair}, spans {pair}, rewrites bigint"

    def rows_of(conv, turns: Turns) -> dict:
        r = render(turns, template)
        mask = [c for (role, _), c in zip(turns, r.contents) if role == "assistant"]
        return {id_col: conv, "n_turns": len(turns), "formatted": r.text, "loss_mask": [{"start": a, "end": b} for a, b in mask], "spans": [{"start": a, "end": b} for a, b in r.spans], "rewrites": r.rewrites}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        now, turns, any_row = None, [], False
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if any_row and conv != now:
                    out.append(rows_of(now, turns))
                    turns = []
                now, any_row = conv, True
                turns.append((role, text))
            if out:
                yield as_batch(out, b.schema.field(0).type, kind)
            last = b.schema.field(0).type
        if any_row:
            yield as_batch([rows_of(now, turns)], last, kind)

    def as_batch(rows: list[dict], id_type: pa.DataType, span: pa.DataType) -> pa.RecordBatch:
        types = {id_col: id_type, "n_turns": pa.int64(), "formatted": pa.string(), "loss_mask": pa.list_(span), "spans": pa.list_(span), "rewrites": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))

    picked = chats.select(F.col(id_col), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn"))
    return picked.repartition(F.col(id_col)).sortWithinPartitions(id_col, "turn", "role", "text").select(id_col, "role", "text").mapInArrow(run, schema)
