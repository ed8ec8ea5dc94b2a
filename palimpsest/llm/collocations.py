"""Phrase collocation mining: frequent word n-grams per language, found by summaries and counted exactly.

1. Summaries. Each n-gram is a 64-bit key (language included) that belongs to one hash partition. A task adds up the keys
   of its texts and sends 32 bits of each, sorted and packed by partition (two that are equal there are counted as one,
   so both may survive). A partition merges what it gets in a Misra-Gries summary:
   beyond its capacity, more than its mass divided by the threshold, the counter that would be the first one too many is
   taken off all counters. What has been taken off altogether is known, stays below the threshold (a summary that would
   pass it, since one n-gram alone weighs more than the others, gets more room instead), and so every n-gram that is
   frequent is still there, with at most that much missing; counters that cannot reach the threshold even so are left.
2. Words come first, then pairs of surviving words, then n-grams of 3 and more words of which all pairs survived: a
   phrase is never more frequent than its parts. Survivors go to the next step as a bitmap of their keys, of at most
   BITS bits. Keys that only collide with a survivor's bit are more work and no error.
3. A last pass counts what survived exactly, by language and words as text, and drops what is below the threshold.

Scores follow from the exact counts by joins (every part of a frequent phrase is frequent, so none is missing), in
decimals of 38 digits.

Bounds: a bitmap of at most BITS / 8 bytes for each of three steps reaches the driver and is broadcast; summaries hold
about `capacity` counters a task, or mass / threshold / MAX_PARTS where that is more. Two n-grams of one task are taken as
one if their 64-bit keys are equal, which among 10^6 different ones has a chance of 10^-7.

Defined results: null text is empty; a null language is `und`; texts without words give nothing; repeated rows count each;
an empty table gives an empty result; only the text and language columns are read. Equal scores go by count, then by
phrase in the order of UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import flat_utf8, held, in_arrow, slabs, staged

#: Counters of a summary, unless MAX_PARTS partitions of them are too few.
CAPACITY, MAX_PARTS = 1 << 17, 20_000
#: Hash partitions that a task of a summary gets, so that tasks get about the same.
PARTS = 4
#: Largest bitmap of survivors.
BITS = 1 << 27
#: Different n-grams that a task holds before it sends them on.
FLUSH = 1 << 21
#: Parts that the ranking of a language is dealt over first.
RANK_PARTS = 64
#: Bytes of a slab of texts.
SLAB = 1 << 21

_LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))
#: 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_BYTE = np.random.default_rng(1201).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base and of its inverse modulo 2^64."""
    def made(size: int) -> tuple[np.ndarray, ...]:
        out = []
        for r in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return tuple(out)

    power, inverse = held("collocation powers", lambda: made(SLAB + 1)) if n <= SLAB + 1 else made(n)
    return power[:n], inverse[:n]


@dataclass
class Words:
    """All words of a slab: bytes in lower case, bounds, 64-bit keys (language mixed in), and whether the next word follows
    in the same piece of the same text."""

    low: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    key: np.ndarray
    joined: np.ndarray
    lang: np.ndarray


def words(raw: np.ndarray, off: np.ndarray, langs: list[str]) -> Words:
    low = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    kind = _KIND[low]
    solid = kind == 0
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    begin = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    end = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1
    power, inverse = _powers(len(low) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * power[: len(low)])])
    names, number = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    salt = np.array([zlib.crc32(x.encode()) | zlib.crc32(x.encode(), 77) << 32 for x in names], np.uint64)
    doc = np.searchsorted(off, begin, "right") - 1
    lang = number[doc] if len(names) else np.zeros(0, np.int64)
    key = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    key = _mix(key + (salt[lang] if len(names) else key) * _STEP)
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])
    joined = np.zeros(len(begin), bool)
    joined[:-1] = (breaks[begin[1:]] == breaks[end[:-1]]) & (doc[1:] == doc[:-1])
    return Words(low, begin, end, key, joined, names[lang] if len(names) else np.zeros(0, object))


class Bitmap:
    """Keys that may be there, one bit each: part = key mod parts, then a bit within the part's own range."""

    def __init__(self, parts: int, width: int, rows: list):
        self.parts, self.width = parts, width
        self.bits = np.zeros(parts * width // 8, np.uint8)
        for part, bits in rows:
            self.bits[part * width // 8 : (part + 1) * width // 8] = np.frombuffer(bits, np.uint8)

    def has(self, key: np.ndarray) -> np.ndarray:
        part, short = dealt(key, self.parts)
        at = part * np.uint64(self.width) + short % np.uint64(self.width)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash partition of keys, and the 32 bits of them that stand for the key within it."""
    n = np.uint64(parts)
    return key % n, (key // n) & np.uint64(0xFFFFFFFF)


def grams(w: Words, orders: range, known: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, keys) of the n-grams whose words (known[0]), pairs (known[1]) and n-grams (known[2]) are known; a step
    for which no bitmap is given yet asks nothing."""
    at = np.arange(len(w.key))
    fine = known[0].has(w.key) if known else np.ones(len(at), bool)
    if 1 in orders:
        yield 1, at[fine], w.key[fine]
    if orders.stop <= 2 or len(at) < 2:
        return
    at = np.flatnonzero(fine[:-1] & fine[1:] & w.joined[:-1])
    key = _mix(w.key[at] * _STEP + w.key[at + 1] + np.uint64(2))
    if len(known) > 1:
        own = known[1].has(key)
        at, key = at[own], key[own]
    if 2 in orders:
        yield 2, at, key
    pair = np.zeros(len(w.key) + 1, bool)
    pair[at] = True
    for n in range(3, orders.stop):
        more = pair[np.minimum(at + n - 2, len(w.key))]
        at = at[more]
        key = _mix(key[more] * _STEP + w.key[at + n - 1] + np.uint64(n))
        own = known[2].has(key) if len(known) > 2 else slice(None)
        yield n, at[own], key[own]


def added(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(times, first) if len(first) else times)


class Summary:
    """A Misra-Gries summary of keys with counts: `taken` is what any counter may lack, always below the threshold."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.key, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, key: np.ndarray, times: np.ndarray) -> None:
        self._new.append((key, times))
        self._size += len(key)
        if self._size >= self.capacity:
            self.settle()

    def settle(self) -> None:
        parts = [(self.key, self.times), *self._new]
        self._new, self._size = [], 0
        self.key, self.times = added(np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts]))
        while len(self.key) > self.capacity:
            at = len(self.key) - self.capacity - 1
            least = int(np.partition(self.times, at)[at])
            if self.taken + least >= self.threshold:
                self.capacity *= 2
                continue
            self.taken += least
            left = self.times > least
            self.key, self.times = self.key[left], self.times[left] - least

    def survivors(self) -> np.ndarray:
        self.settle()
        return self.key[self.times + self.taken >= self.threshold]


def _langs(b: pa.RecordBatch) -> list[str]:
    return b.column("lang").to_pylist()


def _sent(orders: range, known: object, parts: int):
    """By part: sorted 32-bit keys, a byte for each count below 255 and all higher counts one after the other."""
    names = ["part", "keys", "times", "high"]

    def packed(key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        part, short = dealt(key, parts)
        both, times = added(part << np.uint64(32) | short, times)
        part, short = both >> np.uint64(32), both.astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(part))
        low = np.minimum(times, 255).astype(np.uint8)
        high = np.concatenate([[0], np.cumsum(times >= 255)])
        large = times[times >= 255]
        return pa.RecordBatch.from_arrays([
            pa.array(part[cut].astype(np.int32)),
            pa.array([short[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            pa.array([large[high[a] : high[b]].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = known.value if known is not None else []
        keys, times, size = [], [], 0
        for b in slabs(batches, "t", SLAB):
            w = words(*flat_utf8(b.column("t")), _langs(b))
            for _, _, key in grams(w, orders, maps):
                key, n = added(key, np.ones(len(key), np.int64))
                keys.append(key)
                times.append(n)
                size += len(key)
            if size > FLUSH:
                key, n = added(np.concatenate(keys), np.concatenate(times))
                keys, times, size = [key], [n], len(key)
                if size > FLUSH // 2:
                    yield packed(key, n)
                    keys, times, size = [], [], 0
        if size:
            yield packed(np.concatenate(keys), np.concatenate(times))

    return run


def _merged(width: int, capacity: int, threshold: int):
    """One summary for all that comes to a task; the survivors as a bitmap for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity, threshold)
        for b in batches:
            for part, keys, low, high in zip(b.column("part").to_pylist(), *[b.column(c) for c in ("keys", "times", "high")]):
                times = np.frombuffer(low.as_buffer(), np.uint8).astype(np.int64)
                times[times == 255] = np.frombuffer(high.as_buffer(), np.int64)
                summary.add(np.uint64(part << 32) | np.frombuffer(keys.as_buffer(), np.uint32).astype(np.uint64), times)
        key = summary.survivors()
        part, at = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)) % np.uint64(width)
        for p in np.unique(part):
            flags = np.zeros(width, bool)
            flags[at[part == p]] = True
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    return run


def planned(mass: int, threshold: int, capacity: int) -> tuple[int, int]:
    """Tasks and the counters of each, together more than mass / threshold."""
    room = mass // threshold + 1
    tasks = min(max(-(-room // capacity), 1), MAX_PARTS)
    return tasks, max(capacity, room // tasks + 1)


def survivors(texts: DataFrame, orders: range, known: object, mass: int, threshold: int, capacity: int = CAPACITY) -> Bitmap:
    """The n-grams of these orders that may occur `threshold` times; mass: at least the number of all n-grams."""
    tasks, per = planned(mass, threshold, capacity)
    parts = PARTS * tasks
    bits = min(max(1 << (16 * per * tasks - 1).bit_length(), 1 << 16), BITS)
    width = max(bits // parts // 8 * 8, 8)
    sent = in_arrow(texts, _sent(orders, known, parts), "part int, keys binary, times binary, high binary").repartition(tasks, "part")
    return Bitmap(parts, width, in_arrow(sent, _merged(width, per, threshold), "part int, bits binary").collect())


def _counted(orders: range, known: object, parts: int):
    """Exact counts of a task's known n-grams as text, by language and part, one to a line; the empty one stands for all words."""
    names = ["part", "lang", "phrases", "times"]

    def texts(w: Words, n: int, at: np.ndarray) -> list[str]:
        raw = w.low.tobytes()
        begin, end = w.begin[at], w.end[at + n - 1]
        plain = end - begin == sum((w.end[at + j] - w.begin[at + j] for j in range(n)), n - 1)
        for j in range(n - 1):
            plain &= w.low[w.end[at + j]] == 0x20
        spans = [[(int(w.begin[i + j]), int(w.end[i + j])) for j in range(n)] if not p else [(a, b)] for i, p, a, b in zip(at.tolist(), plain.tolist(), begin.tolist(), end.tolist())]
        return [b" ".join(raw[a:b] for a, b in s).decode() for s in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = known.value
        seen: dict[int, list] = {}
        total: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            by: dict[tuple[int, str], list] = {}
            for k, (lang, text, n) in seen.items():
                by.setdefault((k % parts, lang), []).append((text, n))
            for lang, n in total.items():
                by.setdefault((zlib.crc32(lang.encode()) % parts, lang), []).append(("", n))
            total.clear()
            seen.clear()
            for (part, lang), found in by.items():
                times = np.array([n for _, n in found], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lang], pa.string()), pa.array(["\n".join(t for t, _ in found)], pa.string()), pa.array([times], pa.binary())], names=names)

        for b in slabs(batches, "t", SLAB):
            w = words(*flat_utf8(b.column("t")), _langs(b))
            for x, n in zip(*np.unique(w.lang.astype(str), return_counts=True)):
                total[str(x)] = total.get(str(x), 0) + int(n)
            for n, at, key in grams(w, orders, maps):
                key, first, times = np.unique(key, return_index=True, return_counts=True)
                key, times = key.tolist(), times.tolist()
                new = np.array([i for i, k in enumerate(key) if k not in seen], np.int64)
                where = at[first[new]] if len(new) else new
                for i, text, lang in zip(new.tolist(), texts(w, n, where), w.lang[where].tolist() if len(new) else []):
                    seen[key[i]] = [lang, text, 0]
                for k, c in zip(key, times):
                    seen[k][2] += c
            if len(seen) > FLUSH // 8:
                yield from out()
        yield from out()

    return run


def _summed(threshold: int):
    """Adds up counts of phrases that come to a task; those below the threshold are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}
        for b in batches:
            for lang, phrases, times in zip(b.column("lang").to_pylist(), b.column("phrases").to_pylist(), b.column("times")):
                for text, n in zip(phrases.split("\n"), np.frombuffer(times.as_buffer(), np.int64).tolist()):
                    found[lang, text] = found.get((lang, text), 0) + n
        rows = [(lang, text.count(" ") + 1 if text else 0, text, n) for (lang, text), n in found.items() if n >= threshold or not text]
        for lo in range(0, len(rows), 1 << 16):
            columns = zip(*rows[lo : lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "words", "phrase", "n"])

    return run


def frequent(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, threshold: int = 100, capacity: int = CAPACITY) -> DataFrame:
    """(lang, words, phrase, n): all n-grams of 1 to `longest` words that occur `threshold` times in a language, and, as
    words = 0 with an empty phrase, the number of all words."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    texts = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), body.alias("t"))
    context = df.sparkSession.sparkContext
    half = texts.agg(F.sum((F.octet_length("t") + 1).cast("long") / 2)).collect()[0][0]
    mass, maps = int(half or 0) + 1, []
    for orders in (range(1, 2), range(2, 3), range(3, longest + 1))[: min(longest, 3)]:
        shared = context.broadcast(list(maps)) if maps else None
        maps.append(survivors(texts, orders, shared, mass * len(orders), threshold, capacity))
    tasks, _ = planned(mass * longest, threshold, capacity)
    counts = in_arrow(texts, _counted(range(1, longest + 1), context.broadcast(maps), PARTS * tasks), "part int, lang string, phrases string, times binary")
    return staged(in_arrow(counts.repartition(tasks, "part"), _summed(threshold), "lang string, words int, phrase string, n long"), "phrases")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def scored(counts: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more that no longer one with at least `share`
    percent of their occurrences holds."""
    parts = counts.where("words > 0").select("lang", "phrase", "n")
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    totals = counts.where("words = 0").select("lang", "n")
    cut = cut.join(totals, "lang").withColumns({"x": _wide(F.lit(1000)) * _wide(F.col("a")), "y": _wide(F.col("l")) * _wide(F.col("r"))})
    cut = cut.withColumn("score", F.expr("CAST((CAST(x AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) div CAST(y AS DECIMAL(38,0)) AS LONG)"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    within = phrases.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    within = within.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("p"))
    within = within.groupBy("lang", F.array_join(F.slice("w", F.col("p"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("b.a"), F.lit(True)))
    return kept.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(scores: DataFrame, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases with their rank; a language is ranked in parts first, so no task sorts it whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scores.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, threshold: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    return ranked(scored(frequent(df, text, lang, longest, threshold), share), top)
