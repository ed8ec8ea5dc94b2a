"""Language identification by prediction by partial matching over bytes.

For each language a variable-order context tree (contexts of 3, 2, 1 and 0 bytes) is counted on a bounded sample
and then frozen. A byte is coded in the longest context that has been seen: with counts n of the byte, N of the
context and d different followers, its probability is n / (N + d), and d / (N + d) is the escape to the next
shorter context; the last resort is one of 256 bytes. A context that has not been seen costs no escape. The language
with the shortest code length of a whole text wins.

The code length of a byte is a fixed function of it and the three before it (zeros before a text), so the frozen
trees become tables by byte strings of two (dense), three and four bytes, and scoring is a look-up and a sum.

Bounds: the fit reads about `max_docs` documents of each language, picked by a hash of their id (whole texts). The
tables are broadcast; their size is checked against MODEL_BYTES first.

Defined results: null text or text without a letter is `und` with score 0; without any labelled row all is `und`;
ties go to the language that sorts first; null ids are never learned from; repeated rows are scored alike; input
columns named as the added ones are replaced, other names are free.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import flat_utf8, fresh, held, in_arrow, slabs

MAX_DOCS = 1500
#: Bytes that are scored at once.
BLOCK = 1 << 19
#: Largest model that is broadcast.
MODEL_BYTES = 512 << 20


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def contexts(raw: np.ndarray, off: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """For each byte at lo .. hi - 1 the number of it (lowest byte) and the three before it; 0 before a text."""
    hi = len(raw) if hi is None else hi
    first = max(lo - 3, 0)
    s = raw[first:hi].astype(np.uint32)
    code = s.copy()
    for back in (1, 2, 3):
        code[back:] |= s[:-back] << np.uint32(8 * back)
    begins = off[:-1][np.diff(off) > 0]
    begins = begins[np.searchsorted(begins, first - 3) : np.searchsorted(begins, hi)]
    for j in range(3):
        at = begins + j - first
        at = at[(at >= 0) & (at < len(code))]
        code[at] &= np.uint32(256 ** (j + 1) - 1)
    return code[lo - first :]


class _Index:
    """Places of numbers in a sorted list, by a table of slots; numbers whose slot another one holds are searched."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = max(10, int(np.ceil(np.log2(max(len(values), 1)))) + 3)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.slot[self._hash(values)] = np.arange(len(values), dtype=np.int32)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def places(self, x: np.ndarray) -> np.ndarray:
        """-1 for what is not in the list."""
        if not len(self.values):
            return np.full(len(x), -1, np.int32)
        at = self.slot[self._hash(x)]
        other = np.flatnonzero((at >= 0) & (self.values[at] != x))
        near = np.minimum(np.searchsorted(self.values, x[other]), len(self.values) - 1)
        at[other] = np.where(self.values[near] == x[other], near, -1)
        return at


class Trees:
    """Frozen code lengths in bits, by language (columns).

    two: of the last of any two bytes. grams[k], bits[k]: sorted strings of k = 3, 4 bytes that the sample has, and the
    code length of the last byte; leave[2] and known[3], leave[3]: the escape from a context of two or three bytes.
    """

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.name = uuid.uuid4().hex
        n_langs = len(langs)
        codes = [counts[x][0].astype(np.uint32) for x in langs]
        every = np.unique(np.concatenate(codes)) if langs else np.zeros(0, np.uint32)
        self.grams = {4: every, 3: np.unique(every & np.uint32(0xFFFFFF))}
        self.known = np.unique(every >> np.uint32(8))
        self.two = np.zeros((1 << 16, n_langs), np.float32)
        self.bits = {k: np.zeros((len(g), n_langs), np.float32) for k, g in self.grams.items()}
        self.leave = {2: np.zeros((1 << 16, n_langs), np.float32), 3: np.zeros((len(self.known), n_langs), np.float32)}
        for i, code in enumerate(codes):
            n = counts[langs[i]][1].astype(np.float64)
            lower = np.full(256, 8.0)
            for order in (1, 2):  # contexts of order - 1 bytes
                seen = np.bincount(code & np.uint32(256**order - 1), n, 256**order).reshape(-1, 256)
                lower = self._coded(seen, np.tile(lower.reshape(-1, 256), (256 if order > 1 else 1, 1)))
            self.two[:, i] = lower.reshape(-1)
            shorter, keys = self.two[:, i].astype(np.float64), None
            for k in (3, 4):
                own, inverse = np.unique(code & np.uint32(256**k - 1 if k < 4 else 0xFFFFFFFF), return_inverse=True)
                times = np.bincount(inverse, n)
                context, of = np.unique(own >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(of, times), np.bincount(of)
                escape = -np.log2(kinds / (total + kinds))
                where = context if k == 3 else np.searchsorted(self.known, context)
                self.leave[k - 1][where, i] = escape
                gram = self.grams[k]
                tail = gram & np.uint32(256 ** (k - 1) - 1)
                short = shorter[tail] if keys is None else shorter[np.searchsorted(keys, tail)]
                head = gram >> np.uint32(8)
                value = short + (self.leave[2][head, i] if k == 3 else self.leave[3][np.searchsorted(self.known, head), i])
                value[np.searchsorted(gram, own)] = -np.log2(times / (total + kinds)[of])
                self.bits[k][:, i] = value
                shorter, keys = value, gram

    @staticmethod
    def _coded(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Code lengths of all bytes in contexts (rows) with counts n; lower: those in the next shorter context."""
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        room = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / room), 0)
        return np.where(n > 0, -np.log2(np.maximum(n, 1) / room), escape + lower)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.two, self.known, *self.grams.values(), *self.bits.values(), *self.leave.values()))

    def _indexes(self) -> dict[int, _Index]:
        return held(("trees", self.name), lambda: {4: _Index(self.grams[4]), 3: _Index(self.grams[3]), 0: _Index(self.known)})

    def _of(self, code: np.ndarray) -> np.ndarray:
        index = self._indexes()
        at = index[4].places(code)
        bits = self.bits[4][at] if len(self.bits[4]) else np.zeros((len(code), len(self.langs)), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            code = code[new]
            here = index[0].places(code >> np.uint32(8))
            left = np.where(here[:, None] >= 0, self.leave[3][here], 0) if len(self.known) else 0
            three = index[3].places(code & np.uint32(0xFFFFFF))
            short = self.leave[2][(code >> np.uint32(8)) & np.uint32(0xFFFF)] + self.two[code & np.uint32(0xFFFF)]
            bits[new] = left + (np.where(three[:, None] >= 0, self.bits[3][three], short) if len(self.bits[3]) else short)
        return bits

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        for lo in range(0, len(raw), BLOCK):
            hi = min(lo + BLOCK, len(raw))
            bits = self._of(contexts(raw, off, lo, hi))
            first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi)
            begin = np.maximum(off[first:last], lo) - lo
            full = np.flatnonzero(np.minimum(off[first + 1 : last + 1], hi) - lo > begin)
            out[first + full] += np.add.reduceat(bits, begin[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS) -> Trees:
    """Counts the contexts of each language in tasks and freezes the trees on the driver, which gets one row for
    each language and four-byte string of the sample."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    per = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).count().collect()}
    share = F.create_map(*[F.lit(v) for k, n in per.items() for v in (k, min(1.0, max_docs / n))]) if per else None
    if share is None:
        return Trees([], {})
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share[F.col(lang).cast("string")]).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "text"):
            raw, off = flat_utf8(b.column("text"))
            langs = np.array(b.column("lang").to_pylist(), object)
            names = sorted(set(langs))
            number = np.searchsorted(np.array(names, object), langs)
            for lo in range(0, len(raw), BLOCK):
                hi = min(lo + BLOCK, len(raw))
                codes = contexts(raw, off, lo, hi)
                of = number[np.searchsorted(off, np.arange(lo, hi), "right") - 1]
                for i, x in enumerate(names):
                    code, n = np.unique(codes[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    got = in_arrow(sample, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    parts = {x: got[got["lang"] == x] for x in langs}
    return Trees(langs, {x: (p["code"].to_numpy(np.int64), p["n"].to_numpy(np.int64)) for x, p in parts.items()})


def identify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the winner's share of 2^-code length under equal priors) and bits_per_byte."""
    if trees.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {trees.nbytes} bytes is too large to broadcast; fit it with a smaller max_docs")
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    keep = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in added}]
    body, letter = fresh([f.name for f in keep], "_t", "_letter")
    schema = T.StructType([*keep, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for b in slabs(batches, body):
            raw, off = flat_utf8(b.column(body))
            n = len(off) - 1
            if model.langs:
                length = model.lengths(raw, off)
                best = length.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(length[np.arange(n), best][:, None] - length, -1000)).sum(axis=1)
                rate = length[np.arange(n), best] / np.maximum(np.diff(off), 1)
            else:
                best, score, rate = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            letters = b.column(letter).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.where(letters, best, len(names) - 1), np.where(letters & (best < len(model.langs)), score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)], names=schema.names)

    own = F.col(f"`{text}`").cast("string")
    ready = docs.select(*[F.col(f"`{f.name}`") for f in keep], own.alias(body), F.coalesce(own.rlike(r"\p{L}"), F.lit(False)).alias(letter))
    return in_arrow(ready, run, schema)
