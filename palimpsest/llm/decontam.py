"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

A text's words are its runs of word characters after lower-casing A-Z. The words of the benchmark are numbered, and
the automaton reads numbers: a window has at most `n` nodes. A text is read once, as the numbers of its words; a word
that the benchmark lacks ends every window, so only runs of known words go to the automaton. Each window found is mapped
back to word numbers and, for the spans, to code points of the original text.

Defined results: null or word-less texts have no words and no hits; items without id, text or words are left out;
repeated items and documents count as they stand; empty tables give empty results or no hits; a column named as the
added one is replaced, other names are free.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import blocks, flat_utf8, fresh, held, in_arrow, slabs, staged, word_bounds

#: Benchmark text that one automaton holds (about 100 bytes of memory a byte); a larger benchmark is read in blocks of
#: about this size, one after the other, each against all rows.
BLOCK_BYTES = 2 << 20
#: Text whose words are numbered at once.
TEXT_BYTES = 2 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}
#: UTF-8 bytes: A-Z lower-cased, ASCII other than letters and digits to a space; all bytes from 0x80 are word characters.
_BYTES = np.array([(b | 0x20) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
_SPACE = _BYTES == 0x20


class Windows:
    """The windows of items (id, text): `n` consecutive words, or all words of an item with fewer."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = text.encode("utf-8", "surrogatepass").translate(_BYTES.tobytes()).split()
            ids = [number.setdefault(w, len(number)) for w in words]
            for i in range(max(1, len(ids) - n + 1)) if ids else ():
                owners.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.words = pa.array(list(number), pa.large_binary())
        self.least = min(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, who in owners.items():
            self.automaton.add_word(w, (len(w), tuple(who)))
        self.automaton.make_automaton()

    def _numbers(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in a row, -1 for those that no item has, and the number of words before each text."""
        low = _BYTES[raw]
        begin, end = word_bounds(low, off, _SPACE)
        ends = np.append(0, np.cumsum(end - begin))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(low[~_SPACE[low]])])
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(), np.searchsorted(begin, off)

    def numbers(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(off) != 2 or len(raw) <= TEXT_BYTES:
            return self._numbers(raw, off)
        ids = np.concatenate([self._numbers(raw[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in blocks(raw, _SPACE[_BYTES], TEXT_BYTES)])
        return ids, np.array([0, len(ids)])

    def scan(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Of texts in a row: numbers of words; by text, runs of hit words [from, to) and items whose windows occur."""
        ids, before = self.numbers(raw, off)
        runs: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.least and len(ids):
            known = ids >= 0
            edge = np.zeros(len(ids) + 1, bool)
            edge[before] = True
            begin = np.flatnonzero(known & (edge[:-1] | np.append(True, ~known[:-1])))
            end = np.flatnonzero(known & (edge[1:] | np.append(~known[1:], True))) + 1
            own = end - begin >= self.least
            begin, end = begin[own], end[own]
            doc = np.searchsorted(before, begin, "right") - 1
            for lo, hi, d, first in zip(begin.tolist(), end.tolist(), doc.tolist(), before[doc].tolist()):
                for at, (size, who) in self.automaton.iter(tuple(ids[lo:hi].tolist())):
                    to = lo - first + at + 1
                    runs.setdefault(d, []).append((to - size, to))
                    items.setdefault(d, set()).update(who)
        return np.diff(before), {d: merged(r) for d, r in runs.items()}, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans [start, end) in the original text of runs of words."""
    words = [m.span() for m in WORD.finditer(text.translate(_LOWER))] if runs else []
    return [(words[lo][0], words[hi - 1][1]) for lo, hi in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, into: str = "hit") -> DataFrame:
    """docs with a column `into` (which replaces one of that name): (n_words, n_hit, items array<string> in order, spans array<(start, end)> of the text).

    A benchmark beyond BLOCK_BYTES, which is measured first, is read block by block; what each finds is written before
    the next one is fetched.
    """
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-size // BLOCK_BYTES))
    out = docs
    for b in range(parts):
        block = [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == b).collect()]  # about BLOCK_BYTES
        out = _scanned(out, docs.sparkSession.sparkContext.broadcast(block), text, n, into, b > 0)
        out = staged(out, "scanned") if b + 1 < parts else out
    return out


_RUN, _SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("lo", "hi")]), T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")])


def _scanned(docs: DataFrame, block, text: str, n: int, into: str, again: bool) -> DataFrame:
    hit = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("runs", T.ArrayType(_RUN)),
    ])
    keep = [f for f in docs.schema.fields if f.name.lower() != into.lower()]
    body, old = fresh([f.name for f in keep], "_t", "_old")
    schema = T.StructType([*keep, T.StructField(into, hit)])
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held(("windows", name), lambda: Windows(block.value, n))
        pairs = lambda rows, a, b: pa.array([[{a: x, b: y} for x, y in r] for r in rows], pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])))
        for batch in slabs(batches, body, TEXT_BYTES):
            n_words, runs, items = found.scan(*flat_utf8(batch.column(body)))
            for d, before in enumerate(batch.column(old).to_pylist() if again else ()):
                if before["runs"]:
                    runs[d] = merged(runs.get(d, []) + [(r["lo"], r["hi"]) for r in before["runs"]])
                    items[d] = items.get(d, set()) | set(before["items"])
            every = range(batch.num_rows)
            own = [runs.get(d, []) for d in every]
            spans = [char_spans(batch.column(body)[d].as_py(), r) if r else [] for d, r in enumerate(own)]
            cells = [pa.array(n_words, pa.int64()), pa.array([sum(b - a for a, b in r) for r in own], pa.int64()), pa.array([sorted(items.get(d, ())) for d in every], pa.list_(pa.string())), pairs(spans, "start", "end"), pairs(own, "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.StructArray.from_arrays(cells, names=hit.names)], names=schema.names)

    more = [F.col(f"`{into}`").alias(old)] if again else []
    return in_arrow(docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias(body), *more), run, schema)


def items_digest(items: str = "hit.items"):
    """Lower-case hex SHA-256 of the item ids, in order as strings, joined by commas."""
    return F.sha2(F.array_join(F.col(items), ",").cast("binary"), 256)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    (hit,) = fresh(docs.columns, "hit")
    return contamination(docs, benchmark, text, n=n, into=hit).where(f"{hit}.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
