"""Removal of repeated byte strings by a multi-document suffix order that is built column by column.

A byte goes if it lies in a string of `width` bytes that also starts earlier (smaller document id, or the same
document and an earlier start). The work is dealt out so that equal strings always meet:

1. The least hash of the short substrings of a window is its key, so neighbouring windows share keys; a run of
   windows with one key is a *stretch* (key, digest of its bytes, document, start, windows). Equal windows have
   equal keys. Within a batch of documents only the first of equal stretches travels on.
2. Rows are dealt by key and sorted. Of stretches with equal digests all but the first are repeated as a whole. If
   a key has different stretches, or one that overlaps itself, the first of each becomes a *candidate*.
3. Candidates get their bytes back. For each group of keys the collection's Burrows-Wheeler transform and common
   prefixes are built by inserting one symbol of every string in each round, from the last to the first; suffixes
   with a common prefix of `width` are equal windows, of which the earliest stays. The windows of a key with very many different
   stretches are dealt anew by their own 128-bit digests, as stretches of one window, so no group grows with the
   corpus.
4. The repeated ranges of each document are merged and cut out of its bytes.

The files of the column-wise method are Spark's shuffle files here; a round's columns are arrays of one batch of
strings, each at most width + MAX_WINDOWS - 1 bytes long, so the number of rounds is bounded.

Defined results: null text is empty; documents shorter than `width` lose nothing; a null id sorts before all
others; rows with the same id (or none) and text are one document, with different texts they are different documents in the
order of their SHA-256; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import flat_utf8, held, in_arrow, slabs, staged

SEED = 24
MAX_WINDOWS = 128
#: Keys with more different stretches are dealt by window.
WIDE_KEY = 192
#: Bytes of strings whose order is built together, about: with those of one more key, symbols are numbered in 16 bits.
GROUP_BYTES = 20_000
#: Tables up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
NO_ID = -(2**63)

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20240901).integers(1, 2**63, 256, dtype=np.uint64)
#: Powers that a worker keeps: those of a slab.
POWERS = (1 << 21) + 1


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the multiplier and of its inverse."""
    def made() -> tuple[np.ndarray, ...]:
        out = []
        for r in (_R, _R_INV):
            p = np.full(max(n, POWERS), r, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return tuple(out)

    power, inverse = held("powers", made) if n <= POWERS else made()
    return power[:n], inverse[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    m, s = h, 1
    while s * 2 <= k:
        m, s = np.minimum(m[:-s], m[s:]), s * 2
    return np.minimum(m[: len(m) - (k - s)], m[k - s :]) if k > s else m


def stretches(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document number, start, windows, key, digest, overlaps itself) of all stretches of a batch of documents."""
    n = len(raw)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    power, inverse = _pow(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:n])])
    seed = min(SEED, width)
    h = _mix((sums[seed:] - sums[:-seed]) * inverse[: n - seed + 1])
    least = _sliding_min(h, width - seed + 1)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    valid = np.arange(len(least)) + width <= off[1:][doc]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    edge = np.flatnonzero(new | ~valid)
    end = np.append(edge, len(least))[np.searchsorted(edge, start, "right")]
    parts = -(-(end - start) // MAX_WINDOWS)
    if (parts > 1).any():
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MAX_WINDOWS
        start, end = np.repeat(start, parts) + step, np.repeat(end, parts)
        end = np.minimum(end, start + MAX_WINDOWS)
    digest = _mix(_mix((sums[end + width - 1] - sums[start]) * inverse[start] + np.uint64(0x1234567)) ^ (end - start).astype(np.uint64))
    # A stretch with two equal windows repeats at a short distance: each aligned substring in it recurs.
    loops = np.zeros(len(start), bool)
    anchor = np.arange(0, len(h), 64)
    padded = np.concatenate([h, np.arange(MAX_WINDOWS, dtype=np.uint64)])
    ahead = np.lib.stride_tricks.sliding_window_view(padded, MAX_WINDOWS)[anchor]
    again = (ahead[:, 1:] == ahead[:, :1]).any(axis=1)
    if again.any():
        hot = anchor[again]
        loops = np.searchsorted(hot, start, "left") < np.searchsorted(hot, end - 1 + width - seed, "right")
    at = doc[start]
    return at, start - off[at], end - start, least[start], digest, loops


FOUND = "kind int, key long, digest long, doc long, start long, windows int, loops boolean"
MARK, STRETCH = 1, 0


def _stretch_rows(width: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "t"):
            b = b.take(pc.sort_indices(b.column("id")))
            raw, off = flat_utf8(b.column("t"))
            ids = b.column("id").to_numpy(zero_copy_only=False)
            at, start, windows, key, digest, loops = stretches(raw, off, width)
            if not len(at):
                continue
            doc = ids[at]
            # Rows are in the order of document and start; one stable sort brings equal stretches together.
            order = np.argsort(key ^ (digest << np.uint64(1)), kind="stable")
            later = np.zeros(len(order), bool)
            o, p = order[1:], order[:-1]
            later[1:] = (key[o] == key[p]) & (digest[o] == digest[p]) & ((doc[o] != doc[p]) | (start[o] != start[p]))
            kind = np.zeros(len(order), np.int32)
            kind[order[later]] = MARK
            spread = np.where(kind == MARK, _mix(doc.astype(np.uint64) + start.astype(np.uint64)), key)  # marks only pass by
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(spread.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(windows, pa.int32()), pa.array(loops)], names=names)

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to marks (all but the first of equal stretches) and candidates (STRETCH rows)."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    held: dict[str, np.ndarray] | None = None  # the last first row, whose successor is not known yet
    joined, last = False, None  # whether the held row's key began earlier; the last row's (key, digest, doc, start)
    for b in batches:
        x = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        yield _rows({n: v[x["kind"] == MARK] for n, v in x.items()}, names, MARK)
        x = {n: v[x["kind"] == STRETCH] for n, v in x.items()}
        n = len(x["key"])
        if not n:
            continue
        def shifted(name: str, i: int) -> np.ndarray:
            return np.concatenate([[last[i] if last else 0], x[name][:-1]])
        same = (x["key"] == shifted("key", 0)) & (x["digest"] == shifted("digest", 1))
        equal = same & (x["doc"] == shifted("doc", 2)) & (x["start"] == shifted("start", 3))
        if last is None:
            same[0] = equal[0] = False
        last = tuple(x[c][-1] for c in ("key", "digest", "doc", "start"))
        later = same & ~equal
        if later.any():
            # A row equal to the very first in place as well belongs to the first document: only rows behind it are marks.
            yield _rows({k: v[later] for k, v in x.items()}, names, MARK)
        first = {k: v[~same] for k, v in x.items()}
        if held is not None:
            first = {k: np.concatenate([held[k], v]) for k, v in first.items()}
        if not len(first["key"]):
            continue
        more = first["key"][1:] == first["key"][:-1]
        before = np.concatenate([[joined if held is not None else False], more])
        wanted = (before[:-1] | more | first["loops"][:-1].astype(bool))
        yield _rows({k: v[:-1][wanted] for k, v in first.items()}, names, STRETCH)
        held, joined = {k: v[-1:] for k, v in first.items()}, bool(before[-1])
    if held is not None and (joined or held["loops"][0]):
        yield _rows(held, names, STRETCH)


def _rows(x: dict[str, np.ndarray], names: list[str], kind: int) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    x = {**x, "kind": np.full(len(x["key"]), kind, np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(x[n].astype(bool) if n == "loops" else x[n], t) for n, t in zip(names, kinds)], names=names)


def suffix_order(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of strings of symbols in order: owner, length, and the common prefix with the one before.

    data holds the symbols (unsigned, not 0) of all strings, `size` their numbers of symbols (up to 254). Column-wise
    construction: round t inserts the suffixes of length t. The symbol in front of a suffix, held in the transform,
    says where the longer suffix goes: behind all smaller symbols and as many equal ones as stand before it. Its
    common prefix is one more than the least between it and the last equal symbol.
    """
    m = len(size)
    if m and size.max() > 254:
        raise ValueError("strings of up to 254 symbols are ordered")
    data = np.append(data, data.dtype.type(0))
    end = np.cumsum(size)
    ahead = lambda i, t: np.where(size[i] > t, data[np.maximum(end[i] - t - 1, 0)], 0).astype(data.dtype)
    live = np.arange(m)
    front, lcp = ahead(live, 0), np.zeros(m, np.uint8)  # the transform; 0: nothing in front
    place = live  # of the newest suffix of each string in `live`

    def ranked() -> tuple[np.ndarray, np.ndarray, int]:
        order = np.argsort(front, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return order, rank, len(order) - int(np.count_nonzero(front))

    for t in range(1, int(size.max(initial=0)) + 1):
        still = size[live] >= t
        if not still.all():
            live, place = live[still], place[still]
        by_place = np.argsort(place)  # neighbouring ranges follow each other
        live, place = live[by_place], place[by_place]
        order, rank, none = ranked()
        at, sym = rank[place], front[place]
        go = m + at - none  # places in the longer list
        prev = order[np.maximum(at - 1, 0)]
        has_prev = (at > none) & (front[prev] == sym)
        nxt = order[np.minimum(at + 1, len(order) - 1)]
        has_next = (at + 1 < len(order)) & (front[nxt] == sym)
        guard = np.append(lcp, np.uint8(0))

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """min(lcp[a .. b - 1]) for a < b."""
            return np.minimum.reduceat(guard, np.stack([a, b], 1).reshape(-1))[::2] if len(a) else np.zeros(0, np.uint8)

        own = np.zeros(len(live), np.uint8)
        own[has_prev] = least(prev[has_prev] + 1, place[has_prev] + 1) + np.uint8(1)
        after = least(place[has_next] + 1, nxt[has_next] + 1) + np.uint8(1)
        old = np.ones(len(front) + len(live), bool)
        old[go] = False
        for a, v in ((front, ahead(live, t)), (lcp, own)):
            grown = np.empty(len(old), a.dtype)
            grown[old], grown[go] = a, v
            front, lcp = lcp, grown
        lcp[go[has_next] + 1] = after
        place = go
    # The finished transform leads from each suffix to the next longer one.
    owner, length = np.empty(len(front), np.int32), np.empty(len(front), np.int16)
    _, rank, none = ranked()
    live = place = np.arange(m)
    for t in range(int(size.max(initial=0)) + 1):
        owner[place], length[place] = live, t
        live, place = live[size[live] > t], place[size[live] > t]
        place = m + rank[place] - none
    return owner, length, lcp


def repeated(strings: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of every window that also starts earlier; strings have their own places."""
    unit = next(u for u in (4, 2, 1) if width % u == 0)
    n = np.array([len(x) for x in strings], np.int64)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(n) - n
    # Symbols are `unit` bytes, which shortens the rounds: each string counts `unit` times, without its last 0, 1, ...
    # bytes, so that every window begins a suffix of whole symbols. They are numbered from 1 in their order.
    places = max(len(raw) - unit + 1, 0)
    packed = np.zeros(places, np.uint32)
    for i in range(unit):
        packed = (packed << np.uint32(8)) | raw[i : i + places]
    kinds, symbol = np.unique(packed, return_inverse=True)
    symbol = (symbol + 1).astype(np.uint16 if len(kinds) < 65535 else np.uint32)
    size = np.concatenate([np.maximum(n - j, 0) // unit for j in range(unit)])
    first = np.concatenate([begin + np.maximum(n - j, 0) % unit for j in range(unit)])
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data = symbol[np.repeat(first, size) + unit * step]
    twin, length, lcp = suffix_order(data, size)
    owner = twin % max(len(n), 1)
    byte = n[owner] - twin // max(len(n), 1) - unit * length.astype(np.int64)  # where in its string the suffix starts
    equal = lcp >= width // unit
    member = equal | np.append(equal[1:], False)
    at = np.flatnonzero(member)
    group = np.cumsum(~equal)[at]
    d = doc[owner[at]]
    s = start[owner[at]] + byte[at]
    order = np.lexsort((s, d, group))
    g, d, s = group[order], d[order], s[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else np.zeros(0, np.int64)
    later = (d != d[first]) | (s != s[first])
    return d[later], s[later]


def _marks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "windows"]

        def close(rows: list[tuple]) -> pa.RecordBatch:
            doc = np.array([r[1] for r in rows], np.int64)
            start = np.array([r[2] for r in rows], np.int64)
            d, s = repeated([r[3] for r in rows], doc, start, width)
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(d)) - 1
            return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(s[first]), pa.array((s[last] - s[first] + 1) if len(d) else s[first], pa.int32())], names=names)

        rows: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "start", "bytes"))):
                if size >= GROUP_BYTES and row[0] != rows[-1][0]:
                    yield close(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield close(rows)

    return run


STRINGS = "kind int, key long, digest long, doc long, start long, windows int, loops boolean, bytes binary"
STRING, WINDOW = 2, 0


def _window_digests(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows that start at `at`, by two byte tables."""
    power, inverse = _pow(len(raw) + 1)
    out = []
    for table in (_BYTE, _BYTE[::-1]):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * power[: len(raw)])])
        out.append(_mix(_mix((sums[at + width] - sums[at]) * inverse[at])))
    return out[0], out[1]


def _with_bytes(width: int):
    """Candidates of a document to strings, or to single windows of wide keys (the first of each in a batch; the
    others of the batch become marks)."""
    names = [c.split()[0] for c in STRINGS.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def made(kind, key, digest, doc, start, raw=None) -> pa.RecordBatch:
        n = len(doc)
        cols = (kind, key, digest, doc, start, np.ones(n, np.int32), np.zeros(n, bool), [None] * n if raw is None else raw)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "t"):
            raw, off = flat_utf8(b.column("t"))
            wants = b.column("wants")
            per = np.diff(wants.offsets.to_numpy())
            flat = wants.flatten()
            x = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "windows", "wide")}
            row = np.repeat(np.arange(len(per)), per)
            doc, at = b.column("id").to_numpy(zero_copy_only=False)[row], off[row] + x["start"]
            wide = x["wide"].astype(bool)
            own = np.flatnonzero(~wide & (at + x["windows"] + width - 1 <= off[row + 1]))
            if len(own):
                text = raw.tobytes()
                ends = at[own] + x["windows"][own] + width - 1
                yield made(np.full(len(own), STRING), x["key"][own], np.zeros(len(own), np.int64), doc[own], x["start"][own], [text[i:j] for i, j in zip(at[own].tolist(), ends.tolist())])
            own = np.flatnonzero(wide & (at + x["windows"] + width - 1 <= off[row + 1]))
            if not len(own):
                continue
            k = x["windows"][own].astype(np.int64)
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            key, digest = _window_digests(raw, np.repeat(at[own], k) + step, width)
            doc, start = np.repeat(doc[own], k), np.repeat(x["start"][own], k) + step
            order = np.lexsort((start, doc, digest, key))
            key, digest, doc, start = key[order], digest[order], doc[order], start[order]
            later = np.zeros(len(order), bool)
            later[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
            spread = np.where(later, _mix(doc.astype(np.uint64) + start.astype(np.uint64)), key)  # marks only pass by
            yield made(np.where(later, MARK, WINDOW), spread.view(np.int64), digest.view(np.int64), doc, start)

    return run


def _bounded(df: DataFrame, size) -> DataFrame:
    """df for a broadcast if its size, which is measured, allows it."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            out.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "spans"])


def numbered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, id, t): key, number and text of every row. Numbers follow the order of the keys, a null one first, and rows with
    one key have one number if their texts are equal and different ones (in the order of the texts' digests) if not.

    The key is the number where no key has several texts, which is asked first; else (key, digest) is sorted into ranges
    and counted through, and the texts are written once with their numbers.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    own = F.coalesce(F.col("k").cast("long"), F.lit(NO_ID))
    digest = F.sha2(F.coalesce("t", F.lit("")).cast("binary"), 256)
    several = rows.groupBy(own.alias("id")).agg((F.min(digest) != F.max(digest)).alias("several")).where("several")
    if several.isEmpty():
        return rows.select("k", own.alias("id"), "t")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [own, "d"]
    kinds = rows.select("k", digest.alias("d")).distinct().repartitionByRange(n, *order).withColumn("r", F.spark_partition_id())
    kinds = staged(kinds.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy(*order))), "numbers")
    before, offsets = 0, []
    for r, size in sorted(kinds.groupBy("r").count().collect()):  # a row for each range
        offsets.append((r, before))
        before += size
    kinds = kinds.join(F.broadcast(docs.sparkSession.createDataFrame(offsets, "r int, before long")), "r").select(F.col("k").alias("k2"), "d", (F.col("n") + F.col("before")).alias("id"))
    rows = rows.withColumn("d", digest)
    return staged(rows.join(kinds, (rows["d"] == kinds["d"]) & rows["k"].eqNullSafe(kinds["k2"])).select("k", "id", "t"), "numbered")


def repeated_spans(rows: DataFrame, width: int = 100, wide_key: int = WIDE_KEY) -> DataFrame:
    """(id, spans array<(start, end)>) of the `numbered` texts with repeated bytes: merged, in order, in UTF-8 bytes."""
    rows = rows.select("id", "t")
    found = in_arrow(rows.where(F.octet_length("t") >= width), _stretch_rows(width), FOUND)
    found = staged(in_arrow(found.repartition("key").sortWithinPartitions("key", "digest", "doc", "start"), _firsts, FOUND), "stretches")
    whole = found.where(F.col("kind") == MARK).select("doc", "start", "windows")
    candidates = found.where(F.col("kind") == STRETCH).select("key", "doc", "start", "windows")
    wide = candidates.groupBy("key").count().where(F.col("count") > wide_key).select("key", F.lit(True).alias("wide"))
    wide = _bounded(staged(wide, "wide"), F.lit(16))
    wants = candidates.join(wide, "key", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    wants = staged(wants.groupBy(F.col("doc").alias("id")).agg(F.collect_set(F.struct("key", "start", "windows", "wide")).alias("wants")), "wants")
    strings = staged(in_arrow(rows.join(wants, "id"), _with_bytes(width), STRINGS), "strings")
    narrow = strings.where(F.col("kind") == STRING).select("key", "doc", "start", "bytes").distinct().repartition("key").sortWithinPartitions("key", "doc", "start")
    single = in_arrow(narrow, _marks(width), "doc long, start long, windows int")
    windows = in_arrow(strings.where(F.col("kind") != STRING).drop("bytes").repartition("key").sortWithinPartitions("key", "digest", "doc", "start"), _firsts, FOUND)
    marks = whole.unionByName(single).unionByName(windows.where(F.col("kind") == MARK).select("doc", "start", "windows"))
    spans = marks.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("windows") + (width - 1)).alias("end"))).alias("spans"))
    return in_arrow(spans, _merge, "id long, spans array<struct<start:long,end:long>>")


def cut(rows: DataFrame, spans: DataFrame, key: str = "doc_id", keep_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every one of the `numbered` texts without its spans."""
    spans = _bounded(spans, F.size("spans") * 16 + 16)
    kind = rows.schema["k"].dataType
    rows = rows.join(spans, "id", "left")
    fields = [T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] * keep_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "t"):
            raw, off = flat_utf8(b.column("t"))
            raw = memoryview(raw.tobytes())
            cols: list[list] = [[] for _ in range(5)]
            for a, e, own in zip(off[:-1].tolist(), off[1:].tolist(), b.column("spans").to_pylist()):
                parts, done, removed, n = [], a, 0, 0
                for s in own or ():
                    lo, hi = a + s["start"], min(a + s["end"], e)
                    if lo < hi:
                        parts.append(raw[done:lo])
                        removed, n, done = removed + hi - lo, n + 1, hi
                kept = b"".join([*parts, raw[done:e]])
                for c, v in zip(cols, (e - a, removed, n, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("k"), *[pa.array(c, t) for c, t in zip(cols, kinds)][: 4 + keep_bytes]], names=[f.name for f in fields])

    return in_arrow(rows.select("k", "t", "spans"), run, T.StructType(fields))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 100, keep_bytes: bool = False, wide_key: int = WIDE_KEY) -> DataFrame:
    rows = numbered(docs, text, key)
    return cut(rows, staged(repeated_spans(rows, width, wide_key), "spans"), key, keep_bytes)
