"""Centroid clustering (k-means with a fixed number of rounds) in exact integer arithmetic on bit planes.

A vector of 64 numbers becomes 64 integers floor(scale * x). Bit i of all 64 is one plane, a 64-bit word; in two's
complement plane i weighs 2^i and the highest one, the sign, -2^i. So

    x . c = sum over planes i of x and j of c of weight_i * weight_j * popcount(x_i & c_j)

and |x - c|^2 = x . x - 2 x . c + c . c, without rounding. A row keeps as few planes as its own numbers need (10 in place
of 64 numbers for values within 8), which is what is stored, once, and what every round reads.

The first centroids are the k vectors whose ids have the smallest hashes. A round assigns each vector to its nearest
centroid (ties: smaller number) and sums each cluster from the set bits of its planes; a task gives k rows of 64 sums,
Spark adds them up, and the driver sees only k rows, at any size of the table. A new centroid is the exact floor of the mean;
an empty cluster keeps its centroid. No vector is shuffled, so a vector that a third of all rows hold costs nothing extra.

Bounds: k times 64 numbers on the driver and in a broadcast. Integers beyond 2^27 are refused, as squared distances
between them need not fit a long.

Defined results: vectors that are null, of another length than 64, or have a null or non-finite component are left out;
a null id is kept, its hash sorts last; rows with one id are rows each, the order of their hashes is that of their bits;
fewer than k vectors give as many centroids; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import in_arrow, staged

WIDTH = 64
#: Largest magnitude of a component after scaling.
LARGEST = 1 << 27
#: Vectors that are compared at once.
BLOCK = 1 << 13


def kept(vector: str) -> Column:
    """Whether a vector has exactly 64 components, none null or non-finite."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == WIDTH) & finite, F.lit(False))


def weights(n: int) -> list[int]:
    """What each of n planes counts for."""
    return [1 << i for i in range(n - 1)] + [-(1 << (n - 1))]


def needed(values: np.ndarray) -> np.ndarray:
    """Planes that each row of integers needs, sign included."""
    top = np.maximum(values, ~values).max(axis=1)
    return 1 + np.where(top > 0, np.floor(np.log2(np.maximum(top, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def packed(values: np.ndarray, n: int) -> np.ndarray:
    """n planes of rows of 64 integers: (n, rows) words."""
    out = np.empty((n, len(values)), np.uint64)
    for i in range(n):
        bits = ((values >> i) & 1).astype(np.uint8)
        out[i] = np.packbits(bits, axis=1).view(np.uint64).reshape(-1)
    return out


def bits_of(plane: np.ndarray) -> np.ndarray:
    """(rows, 64) bits of one plane."""
    return np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(-1, 8), axis=1)


def unpacked(planes: np.ndarray) -> np.ndarray:
    return sum(bits_of(p).astype(np.int64) * w for p, w in zip(planes, weights(len(planes))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products by weighted popcounts; a and b are (planes, ...) words whose other axes fit each other."""
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]), np.int64)
    for p, v in zip(a, weights(len(a))):
        for q, w in zip(b, weights(len(b))):
            out += np.bitwise_count(p & q).astype(np.int64) * (v * w)
    return out


@dataclass
class Centroids:
    """Final centroids as rows of integers, and distance sums per cluster."""

    values: np.ndarray
    inertia: list[int]

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.values[i].tolist()).encode()).hexdigest()


def _nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector and the squared distance to it."""
    of = packed(centroids, int(needed(centroids).max()))
    square = products(planes, planes)
    all_ = square[:, None] - 2 * products(planes[:, :, None], of[:, None, :]) + products(of, of)[None, :]
    best = all_.argmin(axis=1)
    return best, all_[np.arange(len(best)), best]


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of rows with equally many planes."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for lo in range(0, len(rows), BLOCK):
            at = rows[lo : lo + BLOCK]
            words = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint64)
            yield at, np.ascontiguousarray(words.reshape(len(at), n // 8).T)


def bit_planes(df: DataFrame, vector: str, key: str, scale: float) -> DataFrame:
    """key and planes (binary, one 64-bit word a plane, lowest first) of the vectors that are kept."""
    names = [key, "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False).astype(np.float64)
            scaled = np.floor(flat.reshape(-1, WIDTH) * scale)
            if len(scaled) and np.abs(scaled).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling; squared distances may not fit a long")
            values = scaled.astype(np.int64)
            out = np.empty(len(values), object)
            size = needed(values) if len(values) else np.zeros(0, np.int64)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                words = np.ascontiguousarray(packed(values[rows], int(n)).T)
                out[rows] = [w.tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=names)

    ready = df.where(kept(vector)).select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return in_arrow(ready, run, f"`{key}` {df.schema[key].dataType.simpleString()}, planes binary")


def _sums(centroids: np.ndarray):
    """Per task and cluster: members and the 64 component sums."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, sums = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for b in batches:
            for _, planes in _blocks(b.column("planes")):
                best, _ = _nearest(planes, centroids)
                members += np.bincount(best, minlength=k)
                own = (best[None, :] == np.arange(k)[:, None]).astype(np.float32)  # counts below 2^24 are exact
                for p, w in zip(planes, weights(len(planes))):
                    sums += (own @ bits_of(p).astype(np.float32)).astype(np.int64) * w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(members), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "members", "sums"])

    return run


def clustered(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16, rounds: int = 3, scale: float = 64, seed: str = "1") -> tuple[DataFrame, Centroids]:
    """(key, cluster, distance) of every vector kept, and the final centroids with their inertia."""
    planes = staged(bit_planes(df.select(f"`{key}`", f"`{vector}`"), vector, key, scale), "planes")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    first = planes.orderBy(hashed.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    centroids = np.array([unpacked(np.frombuffer(r[0], np.uint64)[:, None])[0] for r in first], np.int64).reshape(-1, WIDTH)
    shape = f"`{key}` {planes.schema[key].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return planes.sparkSession.createDataFrame([], shape), Centroids(centroids, [])
    for _ in range(rounds):
        sums = in_arrow(planes.select("planes"), _sums(centroids), "cluster int, members long, sums array<long>")
        total = sums.groupBy("cluster").agg(F.sum("members").alias("members"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(WIDTH)]).where("members > 0")
        for r in total.collect():  # k rows
            centroids[r["cluster"]] = [r[f"s{i}"] // r["members"] for i in range(WIDTH)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for at, words in _blocks(b.column("planes")):
                cluster[at], distance[at] = _nearest(words, centroids)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(cluster), pa.array(distance)], names=[key, "cluster", "distance"])

    found = staged(in_arrow(planes, assign, shape), "clusters")
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    return found, Centroids(centroids, [int(inertia.get(i, 0)) for i in range(len(centroids))])


def report(found: DataFrame, centroids: Centroids) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256."""
    k = len(centroids.values)
    if not k:
        return found.selectExpr("*", "CAST(NULL AS LONG) AS cluster_inertia", "CAST(NULL AS LONG) AS inertia", "CAST(NULL AS STRING) AS centroid_sha256")
    own = F.array(*[F.lit(x).cast("long") for x in centroids.inertia])
    digest = F.array(*[F.lit(centroids.digest(i)) for i in range(k)])
    at = F.col("cluster") + 1
    return found.select("*", F.element_at(own, at).alias("cluster_inertia"), F.lit(sum(centroids.inertia)).cast("long").alias("inertia"), F.element_at(digest, at).alias("centroid_sha256"))
