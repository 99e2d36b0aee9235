r"""Chat formatting with a grammar round trip.

Grammar: a conversation is a run of turns, a turn is `<turn>` role, line feed, text, `</turn>`, line feed. In a role or
text a backslash makes the next character plain. Rendering first writes a turn as it is; the rendered text is parsed by
the deterministic parser, and a turn that does not come back identical is written again with its backslashes, turn
marks and, in roles, line feeds escaped, and parsed again until it does. The loss mask covers the assistant's texts.

A conversation is one row's work, as it is one formatted text; conversations are dealt by id.

Defined results: turns go by turn number, nulls first, then by role and text; repeated rows are turns of their own. Null
role or text is empty. Rows without conv_id form one conversation without id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

OPEN, CLOSE = "<turn>", "</turn>"
LOSS_ROLE = "assistant"


def _escaped(text: str, role: bool) -> str:
    text = text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)
    return text.replace("\n", "\\\n") if role else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _plain_find(text: str, mark: str, at: int) -> int:
    """The first place of the mark from `at` on whose backslashes before it pair up."""
    low = at
    while (i := text.find(mark, at)) >= 0:
        n = i
        while n > low and text[n - 1] == "\\":
            n -= 1
        if (i - n) % 2 == 0:
            return i
        at = i + 1
    return -1


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the text as it is written) of each turn; None where the grammar does not hold."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            return None
        a = at + len(OPEN)
        b = _plain_find(text, "\n", a)
        c = _plain_find(text, CLOSE, b + 1) if b >= 0 else -1
        if c < 0 or not text.startswith("\n", c + len(CLOSE)):
            return None
        inside = _plain_find(text, OPEN, b + 1)
        if 0 <= inside < c:
            return None
        turns.append((unescaped(text[a:b]), unescaped(text[b + 1 : c]), b + 1, c))
        at = c + len(CLOSE) + 1
    return turns


def _parsed(text: str) -> list[tuple[str, str, int, int]]:
    turns = parse(text)
    if turns is None:
        raise ValueError("a formatted text does not hold to the grammar")
    return turns


def _turn(role: str, text: str) -> str:
    for r, t in ((role, text), (role, _escaped(text, False)), (_escaped(role, True), _escaped(text, False))):
        written = f"{OPEN}{r}\n{t}{CLOSE}\n"
        got = parse(written)
        if got is not None and [x[:2] for x in got] == [(role, text)]:
            return written
    raise ValueError("a fully escaped turn must come back identical")


def render(turns: list[tuple[str, str]]) -> str:
    """The conversation's text; parse() gives the turns back exactly."""
    return "".join(_turn(role, text) for role, text in turns)


def _conversations(rows: DataFrame) -> DataFrame:
    held = rows.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    return held.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, formatted: each conversation's rendered text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "formatted": [render([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]})

    return mapped(_conversations(rows), run, "conv_id long, formatted string", "conv_id")


def read_back(texts: DataFrame) -> DataFrame:
    """conv_id, turns and the loss mask's spans, parsed from formatted texts alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [_parsed(t) for t in pdf["formatted"]]
            yield pd.DataFrame({
                "conv_id": pdf["conv_id"], "formatted": pdf["formatted"],
                "turns": [[{"role": r, "text": t} for r, t, _, _ in p] for p in parsed],
                "loss": [[{"start": a, "stop": b} for r, _, a, b in p if r == LOSS_ROLE] for p in parsed],
            })

    return mapped(texts, run, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss array<struct<start:int,stop:int>>", "conv_id")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the formatted text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, text, turns, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["turns"], pdf["loss"]):
                said = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
                learnt = "".join(unescaped(text[s["start"] : s["stop"]]) for s in loss)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return mapped(read_back(formatted(rows)), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", "conv_id")
