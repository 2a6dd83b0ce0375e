"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to a text. Successive prefixes of a conversation are rendered and consecutive
outputs compared: where the new output begins with the last one, what it adds is the span of the new turn; where it does not,
the template has rewritten history, the turn is reported, and its span begins where the outputs part. The place of a text
inside its span is found by rendering the turn again with two one-letter texts: the outputs differ at one letter, which stands
where texts begin, and what follows it is what the template puts behind texts.

The own template escapes control strings inside roles and texts reversibly, so a formatted conversation can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The strings that mark turns here or in other common templates.
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_BEGIN, _MIDDLE, _END = "<|turn|>", "<|text|>", "<|end|>\n"
_PROBES = ("", "")

# turns whose prefixes are rendered from one start, where the template's context is stated
SLICE = 16

SPAN = "struct<role:string,start:int,end:int,text_start:int,text_end:int>"
RESULT = f"conv_id long, formatted string, spans array<{SPAN}>, loss array<struct<start:int,end:int>>, rewritten array<int>"


def escaped(text: str) -> str:
    """The text with every escape sign doubled and one put behind the first sign of every control string."""
    doubled = text.replace(ESCAPE, ESCAPE * 2)
    while True:
        broken = _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], doubled)
        if broken == doubled:
            return broken
        doubled = broken


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[Turn]) -> str:
    """The own template: every turn has a mark, its role, a mark, its text, an end mark."""
    return "".join(f"{_BEGIN}{escaped(role)}{_MIDDLE}{escaped(text)}{_END}" for role, text in turns)


_TURN = re.compile(re.escape(_BEGIN) + "(.*?)" + re.escape(_MIDDLE) + "(.*?)" + re.escape(_END), re.DOTALL)


def parsed(formatted: str) -> list[Turn]:
    """The turns of a text that `render` made."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


Located = tuple[str, list[tuple[str, int, int, int, int]], list[int]]


def _by_prefixes(turns: list[Turn], template: Template, head: list[Turn]) -> Located:
    """`locate` over the turns behind `head` by all their prefixes; what `head` renders to is left out of text and positions."""
    before, spans, rewritten = template(head) if head else "", [], []
    skipped = len(before)
    for k, (role, _) in enumerate(turns):
        prefix = [*head, *turns[:k]]
        output = template([*prefix, turns[k]])
        begin = len(before)
        if not output.startswith(before):
            rewritten.append(k)
            begin = _common(before, output)
            # what stood behind that point is no longer where it was
            spans = [(r, min(b, begin), min(e, begin), min(s, begin), min(t, begin)) for r, b, e, s, t in spans]
        one, two = (template([*prefix, (role, probe)]) for probe in _PROBES)
        text_begin = _common(one, two)
        behind = len(one) - text_begin - 1
        text_end = len(output) - behind
        fits = text_begin <= text_end and output[:text_begin] == one[:text_begin] and output.endswith(one[text_begin + 1 :])
        spans.append((role, begin, len(output), *((text_begin, text_end) if fits else (begin, begin))))
        before = output
    return before[skipped:], [(r, *(x - skipped for x in places)) for r, *places in spans], rewritten


def locate(turns: list[Turn], template: Template, context: int | None = None) -> Located:
    """The rendered conversation; role, begin, end, begin and end of the text of each turn; turns that rewrote history.

    Positions are those at which the turn was rendered last. If a template changes or drops texts, or later rewrites a turn,
    the text positions may be empty; they never point at other text than what stands between the template's own signs.

    `context` states that the template only appends, and that what it appends depends on that many turns before at most. Prefixes
    then begin that many turns before a slice of the conversation, so the work grows with its length. The slices are held against
    the whole rendering; if they are not it, or one rewrites, all prefixes are rendered from the first turn on, as without `context`.
    """
    if context is None or len(turns) <= SLICE:
        return _by_prefixes(turns, template, [])
    pieces, spans, at = [], [], 0
    for first in range(0, len(turns), SLICE):
        head = turns[max(0, first - context) : first]
        piece, found, rewritten = _by_prefixes(turns[first : first + SLICE], template, head)
        if rewritten:
            return _by_prefixes(turns, template, [])
        spans += [(r, *(x + at for x in places)) for r, *places in found]
        pieces.append(piece)
        at += len(piece)
    whole = "".join(pieces)
    return (whole, spans, []) if whole == template(turns) else _by_prefixes(turns, template, [])


def formatted(
    conversations: DataFrame,
    template: Template = render,
    learn_from: str = "assistant",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    context: int | None = None,
) -> DataFrame:
    """conv_id, formatted, spans of turns and their texts, loss (spans of the texts of `learn_from`), rewritten turns.

    Rows of a conversation are ordered by turn, rows with one turn by role and text; missing turns come last. A missing role
    or text counts as empty; rows without conv_id form one conversation; repeated rows are repeated turns; other columns are
    left out; no rows give no rows. A conversation is one value of the result and is held by one task, which sorts nothing:
    rows arrive sorted, and no two conversations are held at once. `context` as in `locate`; 0 for the default template.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def one(conv_id: int | None, turns: list[Turn]) -> tuple:
        whole, spans, rewritten = locate(turns, template, context)
        named = [dict(zip(("role", "start", "end", "text_start", "text_end"), s)) for s in spans]
        loss = [{"start": s[3], "end": s[4]} for s in spans if s[0] == learn_from]
        return conv_id, whole, named, loss, rewritten

    span = pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end"))])
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("formatted", pa.string()),
            ("spans", pa.list_(span)),
            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ("rewritten", pa.list_(pa.int32())),
        ]
    )

    def pack(lines: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, begun = None, [], False
        for batch in bounded(batches, 3):
            lines = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if begun and conv_id != current:
                    lines.append(one(current, turns))
                    turns = []
                current, begun = conv_id, True
                turns.append((role, text))
            if lines:
                yield pack(lines)
        if begun:
            yield pack([one(current, turns)])

    return ordered.mapInArrow(run, RESULT)


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss_text: what the formatted texts and their loss spans say, unescaped."""
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parsed(whole)] for whole in texts]
            loss = [
                "".join(unescaped(whole[s["start"] : s["end"]]) for s in spans)
                for whole, spans in zip(texts, batch.column(2).to_pylist())
            ]
            columns = [batch.column(0), batch.column(1), pa.array(turns, pa.list_(turn)), pa.array(loss, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "turns", "loss_text"])

    return conversations.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_text string"
    )
