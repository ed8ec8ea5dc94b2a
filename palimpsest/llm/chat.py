"""Chat formatting by a grammar round trip.

A turn is rendered as `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`; a conversation is the run of its turns. The parser is
deterministic: it accepts exactly that grammar, takes no other `<|` inside a role or text, and then undoes the
escape. Each turn is rendered plainly, parsed again and compared; a turn that does not come back as it was is
rendered once more with its content escaped (`<` + any backslashes + `|` gets one backslash more), until both
are identical. The escape is a bijection into texts without `<|`, so one more round is always enough.

Turns are rendered row by row. Only reading back needs the turns of a conversation in order: rows are dealt by
conversation, sorted, and streamed, so that memory holds one turn and not one conversation.

Defined results: null text or role is empty; null ids form one conversation; rows of one turn number follow in
the order of role and text; repeated rows are repeated turns; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_ADD, _DROP = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ADD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _DROP.sub(r"<\1|", text)


def render_turn(role: str, text: str, escaped: bool = False) -> str:
    if escaped:
        role, text = escape(role).replace("\n", NEWLINE), escape(text)
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns (role, text, start and end of the text as rendered), or None where the grammar does not hold."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(END + "\n", line)
        if line < 0 or end < 0:
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if "<|" in role.replace(NEWLINE, "") or "<|" in text:
            return None
        turns.append((unescape(role.replace(NEWLINE, "\n")), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int, bool]:
    """(rendered turn, start and end of its text, whether it had to be escaped)."""
    for escaped in (False, True):
        rendered = render_turn(role, text, escaped)
        back = parse(rendered)
        if back and len(back) == 1 and back[0][:2] == (role, text):
            return rendered, back[0][2], back[0][3], escaped
    raise ValueError("a turn did not survive its round trip")


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each row with its rendered segment: conv_id, turn, role, segment, loss_start, loss_end, escaped.

    loss_start and loss_end bound an assistant's text inside the segment (both 0 for other roles).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [round_trip(r, t) for r, t in zip(b["role"], b["text"])]
            loss = [r == "assistant" for r in b["role"]]
            yield pd.DataFrame({
                "conv_id": b["conv_id"], "turn": b["turn"], "role": b["role"], "segment": [d[0] for d in done],
                "loss_start": [d[1] if y else 0 for d, y in zip(done, loss)], "loss_end": [d[2] if y else 0 for d, y in zip(done, loss)],
                "escaped": [d[3] for d in done],
            })

    plain = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kinds = {"conv_id": "Int64", "turn": "Int64"}
    return plain.mapInPandas(lambda bs: run(b.astype(kinds) for b in bs), "conv_id long, turn long, role string, segment string, loss_start long, loss_end long, escaped boolean")


class _Reader:
    """Reads one conversation's segments in order and keeps counts and digests only."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = self.escaped = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, segment: str, lo: int, hi: int, escaped: bool) -> None:
        back = parse(segment)
        if back is None:
            raise ValueError("a formatted segment does not parse")
        for role, text, start, end in back:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if hi and (start, end) != (lo, hi):
                raise ValueError("the loss mask does not fall on the text")
        if hi:
            text = unescape(segment[lo:hi])
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(segment)
        self.escaped += escaped

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.escaped


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted segments alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ.split(", ")]
        now, reader = None, None
        for b in batches:
            done = []
            ids = [None if pd.isna(c) else int(c) for c in b["conv_id"]]
            for conv, *rest in zip(ids, b["segment"], b["loss_start"], b["loss_end"], b["escaped"]):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, _Reader()
                reader.take(*rest)
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if reader is not None:
            yield pd.DataFrame([reader.row(now)], columns=names).astype({"conv_id": "Int64"})

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment").select("conv_id", "segment", "loss_start", "loss_end", "escaped")
    return ordered.mapInPandas(lambda bs: run(b.astype({"conv_id": "Int64"}) for b in bs), READ)


def format_conversations(segments: DataFrame) -> DataFrame:
    """Whole formatted conversations with their loss spans, for sets whose conversations fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "segment", "loss_start", "loss_end")))
    return segments.groupBy("conv_id").agg(parts.alias("p")).select(
        "conv_id", F.array_join("p.segment", "").alias("formatted"), F.size("p").alias("n_turns"),
        F.expr("""filter(transform(p, (x, i) -> struct(
            aggregate(slice(p, 1, i), 0L, (n, y) -> n + length(y.segment)) + x.loss_start as start,
            aggregate(slice(p, 1, i), 0L, (n, y) -> n + length(y.segment)) + x.loss_end as end, x.loss_end > 0 as own)), s -> s.own)""").alias("loss"),
    )
