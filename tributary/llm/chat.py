"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole by a template of control strings, encoded once with offsets, and the
sorted spans of its assistant turns are intersected with the sorted token spans by binary search. Control strings
are tokens of their own, so that no token lies across a turn's edge. Inside texts and roles every `<`,
backslashes, `|` sequence gets one more backslash: no control string can then stand in a text, and taking one backslash away
gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns of this role carry the loss.
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@dataclass
class Rendered:
    """A formatted conversation and the (start, end) span of each turn's text in it, in code points."""

    text: str
    roles: list[str]
    spans: list[tuple[int, int]]


def render(turns: list[tuple[str, str]]) -> Rendered:
    """The whole conversation: for each turn START role MIDDLE text END newline, role and text escaped."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at = spans[-1][1] + len(END) + 1
    return Rendered("".join(parts), [r for r, _ in turns], spans)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    found = re.findall(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}\n", text, re.S)
    return [(unescape(r), unescape(t)) for r, t in found]


def loss_mask(tokens: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the spans. tokens: (start, end) rows, sorted; spans: sorted, without overlap.

    For each token binary search gives the last span that starts at or before it; empty spans hold none.
    """
    spans = [s for s in spans if s[0] < s[1]]
    if not spans or not len(tokens):
        return np.zeros(len(tokens), bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, tokens[:, 0], side="right") - 1
    return (at >= 0) & (tokens[:, 1] <= ends[at.clip(0)]) & (tokens[:, 0] < ends[at.clip(0)])


def masked_text(text: str, tokens: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask: each code point once, also where a character takes several tokens."""
    parts, at = [], 0
    for start, end in tokens[mask].tolist():
        start = max(start, at)
        if end > start:
            parts.append(text[start:end])
            at = end
    return "".join(parts)


def masked_turns(text: str, tokens: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped text of each unbroken run under the mask, in order."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescape(masked_text(text, tokens[a:b], mask[a:b])) for a, b in zip(edges[::2], edges[1::2])]


def load(definition: str):
    """The tokenizer with the control strings as tokens."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([AddedToken(s, normalized=False) for s in (START, MIDDLE, END)])
    return tokenizer


def format_conversations(turns: DataFrame, definition: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row for each conversation: id, formatted, ids, mask (booleans beside ids), loss_texts.

    Turns are ordered by `turn`, ties by role and text, null turns first. Null roles and texts count as
    empty; an empty assistant text has no tokens and so no loss text. Repeated rows are repeated turns. Null conversation ids are one conversation.
    Further columns are dropped. A conversation is formatted in one task, which its one output row needs anyhow.
    """
    rows = pick(turns, conversation=conversation, turn=turn, role=role, text=text)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    whole = rows.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(definition)
        for batch in batches:
            for r in range(batch.num_rows):
                told = render([(t["role"], t["text"]) for t in batch.column(1)[r].as_py()])
                encoded = tokenizer.encode(told.text, add_special_tokens=False)
                tokens = np.array(encoded.offsets, np.int64).reshape(-1, 2)
                mask = loss_mask(tokens, [s for s, who in zip(told.spans, told.roles) if who == learned_role])
                values = [[told.text], [encoded.ids], [mask.tolist()], [masked_turns(told.text, tokens, mask)]]
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[r : r + 1], *map(pa.array, values, kinds)], ["conversation", "formatted", "ids", "mask", "loss_texts"])

    kind = whole.schema["conversation"].dataType.simpleString()
    found = whole.mapInArrow(run, f"conversation {kind}, formatted string, ids array<int>, mask array<boolean>, loss_texts array<string>")
    return found.withColumnRenamed("conversation", conversation)


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `turns`, an array of (role, text) parsed from the column `formatted`."""

    @F.udf("array<struct<role:string,text:string>>", useArrow=True)
    def parsed(text):
        return [{"role": r, "text": t} for r, t in parse(text)]

    return formatted.withColumn("turns", parsed("formatted"))
