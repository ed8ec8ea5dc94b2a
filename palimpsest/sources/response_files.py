"""Files of model responses, one JSON text a line, as a batch and as a stream by one Python data source.

`lines` and `line_stream` give a row for each line that is not blank: file (its path below the folder), offset (of its first
byte), text (null if it is no UTF-8) and raw (the bytes of those). `records` parses them on the JVM side and keeps what is no
object of the schema with its file and offset, to be set aside.

A file is read in ranges of bytes; a line belongs to the range in which it begins, so any split gives the same rows. A task
holds one line and one batch of rows. Files below hidden folders and hidden files (_ or . first) are no input. A missing folder
is an error, an empty one has no rows.

A stream's offset is the last file by name and the end of its last whole line: it stays small however many files there
are, and the same offsets give the same rows again. For this files have to come in the order of their names and only the
last one may grow, which is how logs rotate. The offset also holds the number and bytes of the files before its own: a file
that came late or was changed behind it stops the stream with an error, since its rows would be lost. A last line without
an end is taken when its end is there, or when a later file is; a batch takes it as it is.

Folders are opened by pyarrow.fs, so a path is a URI of a store that it knows, or local on one machine.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from palimpsest.sources.responses import parsed

NAME = "response_lines"
SCHEMA = "file string, offset bigint, text string, raw binary"
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("text", pa.string()), ("raw", pa.binary())])
#: Bytes of a range, of one read, and of the texts and number of rows in one batch.
SPLIT, BLOCK, BATCH_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 4 << 20, 10_000

BY_FILE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b, StringStartsWith: str.startswith}
#: The offsets that a filter lets through, from and to (exclusive).
BY_OFFSET = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, None), GreaterThanOrEqual: lambda v: (v, None), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1)}


class Range(InputPartition):
    """Lines of a file that begin at or behind `start` and before `end`."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class Folder:
    """Files below a URI."""

    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.path = path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")
        self.split = int(options.get("split_bytes", SPLIT))

    def _open(self) -> tuple[fs.FileSystem, str]:
        found, root = fs.FileSystem.from_uri(self.path)
        return found, root.rstrip("/")

    def files(self) -> list[tuple[str, int]]:
        """Names and sizes in the order of names."""
        store, root = self._open()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        named = [(f.path[len(root) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
        return sorted((n, s) for n, s in named if not any(part[0] in "_." for part in n.split("/")))

    def ranges(self, file: str, start: int, end: int) -> list[Range]:
        return [Range(file, at, min(at + self.split, end)) for at in range(start, end, self.split)]

    def whole_lines(self, file: str, size: int) -> int:
        """Where the last line that has an end ends."""
        store, root = self._open()
        with store.open_input_file(f"{root}/{file}") as f:
            while size > 0:
                start = max(0, size - BLOCK)
                f.seek(start)
                cut = f.read(size - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                size = start
        return 0

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        store, root = self._open()
        with store.open_input_file(f"{root}/{part.file}") as f:
            at = max(0, part.start - 1)  # the byte before tells whether a line begins at the start
            f.seek(at)
            inside, begin, held = part.start == 0, part.start, []
            while block := f.read(BLOCK):
                done = 0
                while (cut := block.find(b"\n", done)) >= 0:
                    if inside:
                        yield begin, b"".join([*held, block[done:cut]])
                    inside, begin, held, done = True, at + cut + 1, [], cut + 1
                    if begin >= part.end:
                        return
                if inside:
                    held.append(block[done:])
                at += len(block)
            if inside and begin < part.end:
                yield begin, b"".join(held)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for offset, line in self.lines(part):
            line = line.strip(b" \t\r")
            if not line:
                continue
            try:
                rows.append((part.file, offset, line.decode(), None))
            except UnicodeDecodeError:
                rows.append((part.file, offset, None, line))
            held += len(line)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class BatchReader(DataSourceReader):
    def __init__(self, folder: Folder) -> None:
        self.folder, self.by_file, self.start, self.end = folder, [], 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on file choose files, those on offset cut the ranges; both exactly. Others are Spark's."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("file",) and type(f) in BY_FILE:
                self.by_file.append((BY_FILE[type(f)], f.value))
            elif column == ("offset",) and type(f) in BY_OFFSET:
                start, end = BY_OFFSET[type(f)](f.value)
                self.start = max(self.start, start)
                self.end = min((e for e in (self.end, end) if e is not None), default=None)
            else:
                yield f

    def partitions(self) -> list[Range]:
        chosen = [(n, s) for n, s in self.folder.files() if all(test(n, v) for test, v in self.by_file)]
        found = [r for n, s in chosen for r in self.folder.ranges(n, self.start, s if self.end is None else min(s, self.end))]
        return found or [Range("", 0, 0)]  # Spark wants one at least

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition) if partition.end else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0, "files": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        files = self.folder.files()
        if not files:
            return self.initialOffset()
        *before, (last, size) = files
        return {"file": last, "byte": self.folder.whole_lines(last, size), "files": len(before), "bytes": sum(s for _, s in before)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = self.folder.files()
        for offset in (start, end):
            before = [s for n, s in files if n < offset["file"]]
            if (len(before), sum(before)) != (offset["files"], offset["bytes"]):
                raise ValueError(f"files before {offset['file']} came late or were changed: {len(before)} of {sum(before)} bytes, not {offset['files']} of {offset['bytes']}")
        out = []
        for name, size in files:
            if start["file"] <= name <= end["file"]:
                out += self.folder.ranges(name, start["byte"] if name == start["file"] else 0, end["byte"] if name == end["file"] else size)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class ResponseLines(DataSource):
    """Options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(Folder(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Folder(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known and lets filters be pushed into Python sources, which is a setting of the session."""
    spark.dataSource.register(ResponseLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def lines(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    return register(spark).read.format(NAME).option("split_bytes", split_bytes).load(path)


def line_stream(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    return register(spark).readStream.format(NAME).option("split_bytes", split_bytes).load(path)


def records(rows: DataFrame, schema: str) -> DataFrame:
    """file, offset, value (struct of the schema; null if the line is none), and of those without value text and raw."""
    rows = parsed(rows, schema, "text")
    bad = F.col("value").isNull()
    return rows.select("file", "offset", "value", *[F.when(bad, F.col(c)).alias(c) for c in ("text", "raw")])
