"""An index of memories by vector: an inverted file over coarse centroids, bit signatures inside the lists, and exact
re-ranking of what is left.

`build` puts every memory into the list of its nearest centroid and gives it a signature, one bit for the side of each of
768 random planes it lies on. `search` looks only at a query's nearest lists, leaves memories whose signatures differ from
the query's in more than `radius` bits (both a fraction of the work of a cosine) and ranks the rest by exact cosine.

How many lists and bits that takes depends on the vectors, so it is measured and not assumed: `calibrated` finds the true
neighbours of a bounded sample of memories by one exact pass over all of them and takes the smallest number of lists and the
smallest radius that keep the wanted share of these. The exact way, `recall.search`, stays the default of the library.

Bounds: centroids come from at most `sample` vectors on the driver (and at most MAX_LISTS of them); calibration asks with
ASKED memories, which are broadcast. Queries meet lists by a join on list (and group, if asked for); a long list is
split by adaptive execution like any skewed key.

Defined results: memories whose vector is null, of another length than most of the sample, without direction or not finite
are in the index (in list -1) and never found; such queries find nothing; a memory is never its own query's result; ties go
to the smaller id; an empty table gives an empty index and no results; rows that repeat are rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import pair_scores as P
from palimpsest.operators.recall import BLOCK_BYTES, BLOCK_QUERIES, cosine, norm
from palimpsest.sources.tables import written

BITS, MAX_LISTS, SAMPLE, ASKED, ROUNDS = 768, 4096, 20_000, 256, 10
_WORDS = BITS // 64


@dataclass
class Index:
    rows: DataFrame
    centroids: np.ndarray
    planes: np.ndarray
    probes: int
    radius: int


def _hashed(c: str, seed: int) -> Column:
    return F.xxhash64(F.col(c).cast("string"), F.lit(seed))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids_of(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Directions of `lists` clusters of unit vectors: k-means by cosine from evenly spaced first centroids."""
    found = vectors[np.linspace(0, len(vectors) - 1, min(lists, len(vectors))).astype(np.int64)].copy() if len(vectors) else vectors
    for _ in range(ROUNDS if len(found) else 0):
        nearest = (vectors @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, vectors)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), found)
    return found


def _placed(df: DataFrame, centroids: np.ndarray, planes: np.ndarray, nearest: int) -> DataFrame:
    """df with _lists (the nearest lists, nearest first; empty for a vector without direction) and _bits."""
    width = centroids.shape[1] if centroids.size else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            fine = np.array([v is not None and len(v) == width > 0 and None not in v for v in vectors], bool)
            x = np.zeros((len(vectors), width))
            if fine.any():
                x[fine] = np.array([v for v, f in zip(vectors, fine) if f], np.float64)
            length = np.linalg.norm(x, axis=1)
            fine &= np.isfinite(length) & (length > 0)
            x = np.where(fine[:, None], x, 0) / np.where(fine, length, 1)[:, None]
            lists: list = [[]] * len(vectors)
            bits = np.zeros((len(vectors), _WORDS), np.int64)
            if fine.any():
                order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :nearest]
                lists = [o.tolist() if f else [] for o, f in zip(order, fine)]
                bits = np.packbits(x @ planes.T > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(list(bits), pa.list_(pa.int64()))], names=[*b.schema.names, "_lists", "_bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, _lists array<int>, _bits array<long>")


def build(memories: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Index:
    """The index of memories(memory_id, group_id, embedding); other columns do not matter. Its search looks at all lists and
    signatures until it is calibrated."""
    rows = memories.select("memory_id", "group_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    draw = F.pmod(_hashed("memory_id", seed), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(F.col("embedding").isNotNull() & (draw < min(1.0, 2 * sample / max(n, 1)))).orderBy(_hashed("memory_id", seed), "memory_id").limit(sample)
    vectors = [r[0] for r in some.select("embedding").collect()]
    width = max(sorted({len(v) for v in vectors}), key=lambda w: sum(len(v) == w for v in vectors), default=0)
    whole = [v for v in vectors if len(v) == width and None not in v]
    x = np.array(whole, np.float64).reshape(len(whole), width)
    x = x[np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)]
    found = centroids_of(_unit(x), lists or min(MAX_LISTS, max(1, round(n**0.5))))
    planes = np.random.default_rng(seed).normal(size=(BITS, width))
    placed = _placed(rows, found, planes, 1).select("memory_id", "group_id", "embedding", norm(F.col("embedding")).alias("_norm"), F.coalesce(F.try_element_at("_lists", F.lit(1)), F.lit(-1)).alias("_list"), "_bits")
    return Index(written(placed, "memory_index"), found, planes, max(len(found), 1), BITS)


def _differing(a: str, b: str) -> Column:
    """Bits in which two signatures differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, _WORDS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def candidates(index: Index, queries: DataFrame, grouped: bool = True) -> DataFrame:
    """(query_id, memory_id, cosine) of all memories that are scored; queries(query_id, group_id, embedding)."""
    asked = queries.select("query_id", "group_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = _placed(asked, index.centroids, index.planes, index.probes)
    asked = asked.select("query_id", F.col("group_id").alias("_group"), F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_nq"), F.col("_bits").alias("_own"), F.explode("_lists").alias("_list"))
    rows = index.rows.where("_list >= 0")
    if grouped:
        met = rows.join(asked.withColumnRenamed("_group", "group_id"), ["group_id", "_list"])
    else:
        met = rows.join(asked, "_list")
    met = met.where((F.col("memory_id") != F.col("query_id")) & (_differing("_bits", "_own") <= index.radius))
    return met.select("query_id", "memory_id", cosine(F.col("_q"), F.col("embedding"), F.col("_nq"), F.col("_norm")).alias("cosine"))


def _best(scored: DataFrame, k: int, digits: int) -> DataFrame:
    rows = scored.withColumn("cosine", F.round("cosine", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, grouped: bool = True, digits: int = 9) -> DataFrame:
    """(query_id, memory_id, cosine, rank) of the k best memories that the index finds, of a query's group or of all."""
    return _best(candidates(index, queries, grouped), k, digits)


def exact(queries: DataFrame, memories: DataFrame, k: int = 10, grouped: bool = True, digits: int = 9) -> DataFrame:
    """The k best memories with a direction, of each query, by brute force: for measuring. Pairs are scored as matrices
    inside tasks and only the k best of each task become rows."""
    parts = P.blocks(queries, memories, norm, ("cosine",), None, grouped, digits, BLOCK_QUERIES, BLOCK_BYTES)
    return _best(P.union([b.best(k, defined=True) for b in parts]).select("query_id", "memory_id", "cosine"), k, digits)


def calibrated(index: Index, wanted: float = 0.97, k: int = 10, grouped: bool = True, asked: int = ASKED, seed: int = 11) -> Index:
    """The index with the fewest lists and the smallest radius that keep `wanted` of the true neighbours of a sample."""
    if not len(index.centroids):
        return index
    some = index.rows.where("_list >= 0").orderBy(_hashed("memory_id", seed), "memory_id").limit(asked)
    queries = _placed(written(some.select(F.col("memory_id").alias("query_id"), "group_id", "embedding"), "asked"), index.centroids, index.planes, len(index.centroids))
    true = exact(queries, index.rows.where("_list >= 0"), k, grouped).select("query_id", "memory_id")
    met = index.rows.select("memory_id", "_list", "_bits").join(F.broadcast(true), "memory_id")
    met = met.join(F.broadcast(queries.select("query_id", "_lists", F.col("_bits").alias("_own"))), "query_id")
    rows = met.select(F.array_position("_lists", F.col("_list")).alias("place"), _differing("_bits", "_own").alias("bits")).collect()  # k rows for each one asked
    if not rows:
        return index
    keep = max(-int(-len(rows) * (1 + wanted) // 2) - 1, 0)  # half of what may be lost is lost to either filter
    return replace(index, probes=int(sorted(r["place"] for r in rows)[keep]), radius=int(sorted(r["bits"] for r in rows)[keep]))


def recall(index: Index, queries: DataFrame, memories: DataFrame, k: int = 10, grouped: bool = True) -> DataFrame:
    """Per query with any true neighbour: n_true, n_found of them, n_scored memories against n_memories of the exact way."""
    scored = written(candidates(index, queries, grouped), "scored")
    found = _best(scored, k, 9).select("query_id", "memory_id", F.lit(1).alias("found"))
    true = exact(queries, memories, k, grouped).select("query_id", "memory_id")
    hits = true.join(found, ["query_id", "memory_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("found").alias("n_found"))
    work = scored.groupBy("query_id").agg(F.count("*").alias("n_scored"))
    total = memories.groupBy(*["group_id"] * grouped).agg((F.count("*") - 1).alias("n_memories"))
    groups = queries.select("query_id", "group_id")
    rows = hits.join(groups, "query_id").join(work, "query_id", "left")
    rows = rows.join(total, "group_id") if grouped else rows.join(F.broadcast(total))
    return rows.select("query_id", "n_true", "n_found", F.coalesce("n_scored", F.lit(0)).cast("long").alias("n_scored"), "n_memories")
