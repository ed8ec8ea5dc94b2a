"""A linear classifier of texts over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is an n-gram of 2 to 5 characters of a word (a run of letters and digits in lower case, between two marks for
its ends), hashed to 2^20 places; its value is the number of different words of a text that hold it. So a text is a set of
words, a word's share of the score is the same in every text, and each word of a batch is taken apart only once.

1. Statistics: how often each feature occurs with each label, over all labelled rows outside the held-out fold. Tasks
   count, slices of the table are shuffled and added up, the driver gets one table of 2^20 pairs. They give the ratio
   r = log((p + SMOOTH s) / s) - log((q + SMOOTH (1 - s)) / (1 - s)) of a feature's counts p and q with labels 1 and 0,
   where s is the share of label 1 in all counts: a feature without counts says nothing (r = 0).
2. Weights: logistic regression on the features times r, with an L2 penalty, by full-batch Adam in float64. It is
   fitted on a sample of at most about `max_docs` whole texts of each label (and at most MAX_WORDS different words in
   all of a label's texts), picked by a hash of the id, weighted back to the share that the label has among all rows.
3. Scores: the logistic function of a bias and the sum over a text's different words.

Bounds: two tables of 2^20 numbers on the driver, one of 2^20 float32 (4 MB) in the broadcast. Labels are broadcast up to
BROADCAST_ROWS of them, else joined by a shuffle. Texts beyond BLOCK bytes are read in blocks that end between words.

Defined results: null and empty texts, and those without a letter or digit, get the score of the bias; a null id is scored,
never learned from and not held out; a document with both labels is learned once with each, a repeated label once; labels
other than 0 and 1 are not learned from; repeated rows are scored alike; without rows of both labels every score is the
share of label 1, (n1 + 1) / (n0 + n1 + 2); an empty table gives an empty result; columns named as the added ones are
replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import blocks, flat_utf8, fresh, in_arrow, slabs

PLACES_BITS = 20
PLACES, SLICE = 1 << PLACES_BITS, 1 << 12
ORDERS = range(2, 6)
MAX_DOCS, MAX_WORDS = 1000, 1 << 20
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are taken apart at once.
BLOCK = 1 << 20
ROUNDS, RATE, PENALTY, SMOOTH = 60, 0.03, 1e-2, 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_tables: list[np.ndarray] = []


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (where it is one character) and whether it is a letter or digit, for all characters below U+10000."""
    if not _tables:
        lower = [chr(c).lower() for c in range(1 << 16)]
        _tables.append(np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(lower)], np.uint32))
        _tables.append(np.array([x.isalnum() for x in lower]))
    return _tables[0], _tables[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Different words of some texts: pairs (doc, word) without repeats, and the words' characters."""

    doc: np.ndarray
    word: np.ndarray
    char: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def texts(self) -> list[str]:
        return [self.char[a:b].tobytes().decode("utf-32-le") for a, b in zip(self.begin, self.end)]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and places of all their n-grams."""
        size = self.end - self.begin + 2
        total = int(size.sum())
        owner = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        within = np.arange(total) - first[owner]
        char = self.char[np.clip(self.begin[owner] + within - 1, 0, max(len(self.char) - 1, 0))].astype(np.uint64) if total else np.zeros(0, np.uint64)
        char[first] = 2
        char[first + size - 1] = 3
        left = size[owner] - within
        h, words, places = char, [], []
        for n in range(2, ORDERS.stop):
            at = np.arange(max(total - n + 1, 0))
            h = _mix(h[: len(at)] * _MULTIPLIER + char[at + n - 1] + np.uint64(n))
            if n in ORDERS:
                own = left[: len(at)] >= n
                words.append(owner[: len(at)][own].astype(np.int32))
                places.append((h[own] >> np.uint64(64 - PLACES_BITS)).astype(np.int32))
        return np.concatenate(words), np.concatenate(places)


def _chunk(raw: np.ndarray, off: np.ndarray) -> tuple[Chunk, np.ndarray]:
    lower, letter = _characters()
    char = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    small = char < (1 << 16)
    code = np.where(small, char, 0)
    char, solid = np.where(small, lower[code], char), np.where(small, letter[code], True)
    edge = np.zeros(len(char) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    end = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1
    with np.errstate(over="ignore"):
        base = np.full(len(char) + 1, 0x9E3779B97F4A7C15, np.uint64)
        back = np.full(len(char) + 1, pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64)
        base[0] = back[0] = 1
        base, back = np.cumprod(base), np.cumprod(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(char.astype(np.uint64)) * base[:-1])])
        key = _mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(starts, begin, "right") - 1
    key, first, number = np.unique(key, return_index=True, return_inverse=True)
    pair = np.unique(doc * len(key) + number)
    at = np.maximum(len(key), 1)
    return Chunk(pair // at, pair % at, char, begin[first], end[first]), key


def chunks(raw: np.ndarray, off: np.ndarray) -> Iterator[Chunk]:
    """All pairs of texts in a row and their different words; a long text comes in several chunks that share no word."""
    if len(raw) <= BLOCK or len(off) > 2:
        yield _chunk(raw, off)[0]
        return
    seen = np.zeros(0, np.uint64)
    for lo, hi in blocks(raw, _SPACE, BLOCK):
        c, key = _chunk(raw[lo:hi], np.array([0, hi - lo]))
        new = np.flatnonzero(~np.isin(key, seen))
        seen = np.concatenate([seen, key[new]])
        yield Chunk(np.zeros(len(new), np.int64), np.arange(len(new)), c.char, c.begin[new], c.end[new])


def learnable(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(id, label) of the labelled rows outside the held-out fold."""
    own = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    return own.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).distinct()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of places: feature counts with labels 0 and 1; with the first slice, texts and words of each label."""
    count, size, words = np.zeros((2, PLACES), np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64)
    for b in slabs(batches, "t", BLOCK):
        label = b.column("label").to_numpy(zero_copy_only=False)
        size += np.bincount(label, minlength=2)
        for c in chunks(*flat_utf8(b.column("t"))):
            word, place = c.features()
            for x in (0, 1):
                times = np.bincount(c.word[label[c.doc] == x], minlength=len(c.begin))
                words[x] += times.sum()
                count[x] += np.bincount(place, times[word], PLACES).astype(np.int64)
    if size.any():
        for lo in range(0, PLACES, SLICE):
            part = np.ascontiguousarray(count[:, lo : lo + SLICE])
            total = np.concatenate([size, words]).tobytes() if not lo else None
            yield pa.RecordBatch.from_arrays([pa.array([lo // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([total], pa.binary())], names=["slice", "counts", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    total = np.zeros(4, np.int64)
    for b in batches:
        for k, counts, of in zip(b.column("slice").to_pylist(), b.column("counts"), b.column("total")):
            own = np.frombuffer(counts.as_buffer(), np.int64)
            if k in sums:
                sums[k] += own
            else:
                sums[k] = own.copy()
            if of.is_valid:
                total += np.frombuffer(of.as_buffer(), np.int64)
    for k, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([total.tobytes() if k == 0 else None], pa.binary())], names=["slice", "counts", "total"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its different words."""
    for b in slabs(batches, "t", BLOCK):
        found: list[list[str]] = [[] for _ in range(b.num_rows)]
        for c in chunks(*flat_utf8(b.column("t"))):
            names = c.texts()
            for d, w in zip(c.doc.tolist(), c.word.tolist()):
                found[d].append(names[w])
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([" ".join(sorted(x)) for x in found], pa.string())], names=["id", "label", "words"])


@dataclass
class Model:
    bias: float
    #: Weight times ratio of each place.
    weights: np.ndarray | None = None

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        if self.weights is not None:
            for c in chunks(raw, off):
                word, place = c.features()
                own = np.bincount(word, self.weights[place], len(c.begin))
                z += np.bincount(c.doc, own[c.word], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def ratios(counts: np.ndarray) -> np.ndarray:
    share = (counts[1].sum() + 1) / (counts.sum() + 2)
    return np.log(counts[1] / share + SMOOTH) - np.log(counts[0] / (1 - share) + SMOOTH)


def fitted(words: list[str], label: np.ndarray, ratio: np.ndarray, share: np.ndarray) -> Model:
    """Logistic regression over texts given as their different words; share: of all labelled rows, by label."""
    known: dict[str, int] = {}
    lists = [[known.setdefault(w, len(known)) for w in text.split(" ") if w] for text in words]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    of = np.array([w for x in lists for w in x], np.int64)
    raw = "".join(known).encode("utf-32-le")
    size = np.array([len(w) for w in known], np.int64)
    end = np.cumsum(size)
    word, place = Chunk(doc, of, np.frombuffer(raw, np.uint32), end - size, end).features()
    used, place = np.unique(place, return_inverse=True)
    r, n, v = ratio[used], len(lists), len(known)
    each = (share / np.maximum(np.bincount(label, minlength=2), 1))[label]
    w, bias = np.zeros(len(used)), float(np.log(share[1] / share[0]))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, ROUNDS + 1):
        own = np.bincount(word, (w * r)[place], v)
        z = bias + np.bincount(doc, own[of], n)
        error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - label) * each
        slope = r * np.bincount(place, np.bincount(of, error[doc], v)[word], len(used)) + PENALTY * w
        slope = np.append(slope, error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    weights = np.zeros(PLACES, np.float32)
    weights[used] = w * r
    return Model(bias, weights)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    known = learnable(labels, key, label)
    rows = known.count()
    joined = texts.where(~held_out("id")).join(F.broadcast(known) if rows <= BROADCAST_ROWS else known, "id")
    slices = "slice int, counts binary, total binary"
    got = in_arrow(in_arrow(joined.select("t", "label"), _counts, slices).repartition("slice"), _added, slices).collect()
    counts, total = np.zeros((2, PLACES), np.int64), np.zeros(4, np.int64)
    for r in got:
        counts[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64).reshape(2, SLICE)
        if r["total"] is not None:
            total += np.frombuffer(r["total"], np.int64)
    size, n_words = total[:2], total[2:]
    if not size.all():
        return Model(float(np.log((size[1] + 1) / (size[0] + 1))))
    part = [min(1.0, max_docs / size[x], MAX_WORDS / max(n_words[x], 1)) for x in (0, 1)]
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < F.when(F.col("label") == 1, part[1]).otherwise(part[0]))  # about max_docs ids of each label
    sample = in_arrow(texts.join(F.broadcast(picked), "id").select("id", "label", "t"), _words, f"id {texts.schema['id'].dataType.simpleString()}, label int, words string").collect()
    sample.sort(key=lambda r: (r["label"], str(r["id"]), r["words"]))
    label_of = np.array([r["label"] for r in sample], np.int64)
    if len(set(label_of.tolist())) < 2:  # so few rows that a draw missed a label
        return Model(float(np.log((size[1] + 1) / (size[0] + 1))))
    return fitted([r["words"] for r in sample], label_of, ratios(counts), size / size.sum())


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    keep = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in added}]
    (body,) = fresh([f.name for f in keep], "_t")
    schema = T.StructType([*keep, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, body, BLOCK):
            score = shared.value.score(*flat_utf8(b.column(body)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return in_arrow(docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias(body)), run, schema)
