"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan is made over counts: at most `capacity` distinct lengths reach the driver, whatever the number of
documents. Each row of the plan says "pieces of length L with ranks lo .. hi - 1 go, k to a sequence, into the
sequences from seq_lo on, behind `offset` tokens". Pieces take their slots by a join on length and rank, where
the rank within a length is counted in salted parts, so that a length which a third of all pieces share is
still dealt over many tasks.

Defined results: null text is the empty text (one piece that holds the end id); repeated rows and ties are
packed as pieces of their own; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.common import blocks, flat_utf8, fresh, held, in_arrow, slabs, staged

#: Pieces of one length that share a salt, about; a part of this size is sorted by one task.
PART_ROWS = 200_000
MIN_PARTS = 256
#: Plans of more rows are joined by a shuffle instead of a broadcast.
BROADCAST_PLAN_ROWS = 500_000
#: Units that a worker knows the ids of; beyond that it starts anew, results do not depend on it.
CACHE_UNITS = 600_000
#: Text that is cut into units at once.
BLOCK_BYTES = 2 << 20
#: About this many ranges of ranks are joined with the plan's rows by an equality.
RANK_RANGES = 200_000

PLAN_SCHEMA = "length long, lo long, hi long, seq_lo long, k long, offset long"


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, lo, hi, seq_lo, k, offset), hi exclusive.

    Sequences that are filled alike are one entry (first sequence, number of them) under their free space.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def give(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, lo = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            k = space // length
            full = min(count, left // k)
            if full:
                plan.append((length, lo, lo + full * k, first, k, capacity - space))
                give(space - k * length, first, full)
                lo, left = lo + full * k, left - full * k
            used = full
            if full < count and left:
                plan.append((length, lo, lo + left, first + full, left, capacity - space))
                give(space - left * length, first + full, 1)
                lo, left, used = lo + left, 0, full + 1
            give(space, first + used, count - used)
    return plan


def pack(pieces: DataFrame, length: str = "length", capacity: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to rows of `length` 1..capacity; `order` makes the ranks repeatable.

    pieces is read three times: hand in a table or the result of staged(). Columns named sequence_id or offset are
    replaced; other names are free.
    """
    spark = pieces.sparkSession
    keys = [F.col(f"`{c}`") for c in order] or [F.col(f"`{length}`")]
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    size, part, rank, start, within = fresh(pieces.columns, "_len", "_part", "_rank", "_start", "_range")
    n = pieces.count()
    parts = max(MIN_PARTS, -(-n // PART_ROWS))
    width = max(256, -(-n // RANK_RANGES))  # ranks in a range
    salted = pieces.withColumns({size: F.col(f"`{length}`").cast("long"), part: F.pmod(F.xxhash64(*keys), F.lit(parts))})
    counts = salted.groupBy(size, part).agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), PLAN_SCHEMA)
    before = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(size, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    ranked = (
        salted.withColumn(rank, F.row_number().over(Window.partitionBy(size, part).orderBy(*keys)) - 1)
        .join(starts, [size, part])
        .withColumn(rank, F.col(rank) + F.col(start))
        .withColumn(within, F.floor(F.col(rank) / width))
    )
    # A row of the plan stands once for each range of ranks that it reaches into, so a piece meets only rows near its rank.
    ends = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
    plan = plan.select(F.col("length").alias(size), F.explode(ends).alias(within), F.struct("lo", "hi", "seq_lo", "k", "offset").alias(start))
    if histogram and plan.count() <= BROADCAST_PLAN_ROWS:
        plan = F.broadcast(plan)
    slot = F.col(rank) - F.col(f"{start}.lo")
    found = ranked.drop(start).join(plan, [size, within]).where(F.col(rank).between(F.col(f"{start}.lo"), F.col(f"{start}.hi") - 1))
    return found.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.col(f"{start}.seq_lo") + F.floor(slot / F.col(f"{start}.k")).cast("long")).alias("sequence_id"),
        (F.col(f"{start}.offset") + slot % F.col(f"{start}.k") * F.col(size)).alias("offset"),
    )


_BYTE_CLASS = np.full(256, 4, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 other printable ASCII, 4 the rest
_BYTE_CLASS[0x21:0x7F] = 3
_BYTE_CLASS[0x30:0x3A] = 2
_BYTE_CLASS[0x41:0x5B] = _BYTE_CLASS[0x61:0x7B] = 1
_BYTE_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 0
_LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))
_AFTER_MARK = np.isin(np.arange(256), np.frombuffer(b"stmrvldSTMRVLD", np.uint8))


class WordIds:
    """Ids of texts by a tokenizer that drops white space, lower-cases, and matches no piece over white space.

    Texts are cut into units: words of printable ASCII and the letters U+00C0 to U+00FF as the tokenizer's own pattern cuts them, all others whole. Each
    different unit of a slab of texts is looked up once, and the tokenizer reads only those that are not known from
    earlier slabs. Units of ASCII and Latin-1 go to its model, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.plain = regex.compile(r"[\x21-\x7E\xA1-\xAC\xAE-\xFF]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: "".join(x for x, _ in letters.pre_tokenize_str(c)) for c in map(chr, range(0x21, 0x100))}
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def unit(self, raw: bytes) -> list[int]:
        word = raw.decode("utf-8", "surrogatepass")
        if word.isalpha() and word.islower() and self.plain.fullmatch(word):
            return [t.id for t in self.model.tokenize(word if raw.isascii() else "".join(map(self.letters.__getitem__, word)))]
        if not self.plain.fullmatch(word) or "<|" in word:
            return self.whole.encode(word, add_special_tokens=False).ids
        parts = self.cut.findall(word.lower())
        if not word.isascii():
            parts = ["".join(map(self.letters.__getitem__, p)) for p in parts]
        return [t.id for p in parts for t in self.model.tokenize(p)]

    def _units(self, raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All units in a row, and the number of units before each text."""
        kind = _BYTE_CLASS[raw]
        lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))  # the letters from U+00C0 to U+00FF
        kind[lead] = kind[lead + 1] = 1
        solid = kind != 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        first = solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        mark = np.flatnonzero((raw[:-1] == 0x27) & _AFTER_MARK[raw[1:]])
        words = np.flatnonzero(first)
        of = lambda at: np.searchsorted(words, at, "right") - 1
        whole = np.zeros(len(words), bool)
        whole[of(np.flatnonzero(kind == 4))] = True
        whole[of(mark)] = True
        whole[of(special)] = True
        low = np.frombuffer(bytearray(raw.tobytes().translate(_LOWER)), np.uint8)
        low[lead + 1] = np.where(low[lead + 1] < 0x9F, low[lead + 1] | 0x20, low[lead + 1])
        for w in np.unique(of(special)):  # special tokens are matched as they are written
            end = words[w + 1] if w + 1 < len(words) else len(raw)
            low[words[w] : end] = raw[words[w] : end]
        cut = np.concatenate([[False], kind[1:] != kind[:-1]]) | (kind == 2)
        inner = np.flatnonzero(solid & cut & ~first)
        inner = inner[~whole[of(inner)]]
        first[inner] = True
        begin = np.flatnonzero(first)
        ends = np.append(np.cumsum(solid, dtype=np.int32)[begin] - 1, np.count_nonzero(solid)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(low[solid])])
        return units, np.searchsorted(begin, off)

    def of(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids before each text."""
        units, before = self._units(raw, off)
        if not len(units):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        coded = units.dictionary_encode()
        mine = coded.dictionary
        at = pc.fill_null(pc.index_in(mine, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        found = [self.unit(u) for u in mine.take(pa.array(new)).to_pylist()]
        at[new] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, mine.take(pa.array(new))])
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f) for f in found], dtype=np.int64)])
        size, start = np.diff(self.start)[at], self.start[:-1][at]
        index = coded.indices.to_numpy()
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(start[index] - ends[:-1], n) + np.arange(ends[-1])]
        if len(self.known) > CACHE_UNITS:
            self.forget()
        return ids, ends[before]

    def of_any(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `of`; a text beyond BLOCK_BYTES, which is a slab by itself, is read in blocks that end at white space."""
        if len(off) != 2 or len(raw) <= BLOCK_BYTES:
            return self.of(raw, off)
        ids = [self.of(raw[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in blocks(raw, _BYTE_CLASS == 0, BLOCK_BYTES)]
        out = np.concatenate(ids)
        return out, np.array([0, len(out)])


def tokenized(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces (key, piece, start, length, ids_crc32[, ids]) of all documents; longer ones are cut every `capacity` ids."""
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("words", path), lambda: WordIds(path))
        for batch in slabs(batches, "t", BLOCK_BYTES):
            ids, before = words.of_any(*flat_utf8(batch.column("t")))
            total = np.diff(before) + 1
            last = np.cumsum(total) - 1
            whole = np.full(int(total.sum()), end_id, "<u4")
            own = np.ones(len(whole), bool)
            own[last] = False
            whole[own] = ids
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            at = (last - total + 1)[row] + start
            raw = memoryview(whole.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            out = [batch.column("k").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole.view("<i4"))))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return in_arrow(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), run, T.StructType(fields))


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs: one row for each piece with its sequence_id and offset."""
    pieces = staged(tokenized(docs, path, text, key, capacity, end_id, keep_ids), "pieces")
    return pack(pieces, "length", capacity, (key, "piece", "start", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ids: (sequence_id, ids, lengths), each at most `capacity` long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
