"""Shared helpers of the training-data operators: tables, staging, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The object that `make` gives, kept in this worker until another key is asked for.

    Python workers outlive tasks and stages: what one operator keeps must not add to what the next one needs.
    """
    if key not in _held:
        _held.clear()
        released()
        _held[key] = make()
    return _held[key]


def released() -> None:
    """Gives memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Bytes of a batch that goes to Python, unless the session sets a bound of its own: what a task holds twice or more.
BATCH_BYTES, _BATCH_KEY, _BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded size; a task's worker gives free memory back at its end."""
    if df.sparkSession.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH_KEY, BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(whole, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session on one machine that names none gets a temporary folder; a cluster that names none is an error, since
    its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    Cuts the lineage: what follows survives a lost executor without running the stage again, and several
    consumers read one copy.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slabs(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows with about `limit` bytes of text, so that work arrays stay small.

    A text longer than the limit is a slab by itself.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(int(np.searchsorted(ends, before + limit, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def fresh(columns: list[str], *names: str) -> list[str]:
    """Working names that clash with none of the given columns (case-insensitively, as Spark resolves them)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def blocks(raw: np.ndarray, space: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts one text's bytes into ranges of about `limit` that end in front of white space (space: 256 flags), so that
    no word is cut; a longer word is a range by itself."""
    lo = 0
    while lo < len(raw):
        hi = lo + limit
        while hi < len(raw):
            found = np.flatnonzero(space[raw[hi : hi + 65536]])
            if len(found):
                hi += int(found[0])
                break
            hi += 65536
        hi = min(hi, len(raw))
        yield lo, hi
        lo = hi


def word_bounds(raw: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts in a row; no word reaches over the end of a text."""
    solid = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begin = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    end = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1
    return begin, end
