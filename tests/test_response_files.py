"""The source of response files: the same rows for any split, filter, restart; what is no record is set aside."""

import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException

from palimpsest.sources import response_files as RF
from palimpsest.streaming import jobs as J

LINES = [b'{"id": 1}', b"", b'{"id": ', "{\"id\": 2, \"name\": \"地点\"}".encode(), b"\xff\xfe", b'{"id": "x"}', b"[]", b'{"id": 3}' + b" " * 300, b'{"id": 4}']


def folder(**files: bytes) -> str:
    root = tempfile.mkdtemp(prefix="spark-")
    for name, data in files.items():
        add(root, name, data)
    return root


def add(root: str, name: str, data: bytes, mode: str = "wb") -> None:
    path = f"{root}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def expected(name: str, data: bytes) -> list[tuple]:
    out, at = [], 0
    for line in data.split(b"\n"):
        if line.strip():
            out.append((name, at, line.strip()))
        at += len(line) + 1
    return out


def found(df) -> list[tuple]:
    return sorted((r["file"], r["offset"], bytes(r["raw"]) if r["text"] is None else r["text"].encode()) for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("end", [b"", b"\n"])
def test_any_split_gives_all_lines_once(spark, split, end):
    data = b"\n".join(LINES) + end
    root = folder(a=data, b=b"", c=b"\n\n", d=b"one line", _SUCCESS=b"no", **{".a.crc": b"no", "_temporary/e": b"no"})
    want = expected("a", data) + expected("d", b"one line")
    assert found(RF.lines(spark, f"file://{root}", split)) == sorted(want)


def test_empty_folder_has_no_rows_and_a_missing_one_is_an_error(spark):
    root = folder()
    assert RF.lines(spark, root).count() == 0
    with pytest.raises(Exception, match="missing"):
        RF.lines(spark, f"{root}/missing").count()


def test_a_line_longer_than_blocks_and_ranges(spark):
    data = b'{"id": 1}\n' + b"x" * (3 * RF.BLOCK + 5) + b"\n" + b'{"id": 2}\n'
    rows = RF.lines(spark, folder(a=data), RF.BLOCK)
    assert [(r["offset"], len(r["text"])) for r in sorted(rows.collect())] == [(0, 9), (10, 3 * RF.BLOCK + 5), (len(data) - 10, 9)]


def test_filters_are_pushed_and_exact(spark):
    data = b"\n".join(LINES)
    root = folder(a=data, b=data, c=data)
    both = expected("a", data) + expected("b", data) + expected("c", data)
    some = expected("a", data)[2][1]
    for condition, test in (
        ("file = 'b'", lambda f, o: f == "b"), ("file in ('a', 'c')", lambda f, o: f != "b"), ("file like 'c%'", lambda f, o: f == "c"), ("file > 'a'", lambda f, o: f > "a"),
        (f"offset = {some}", lambda f, o: o == some), (f"offset > {some}", lambda f, o: o > some), (f"offset >= {some}", lambda f, o: o >= some), (f"offset < {some}", lambda f, o: o < some),
        (f"offset <= {some} and offset > 0 and file = 'a'", lambda f, o: 0 < o <= some and f == "a"), (f"offset < {some} and offset < 1000", lambda f, o: o < some), ("offset > 5 and offset < 3", lambda f, o: False),
    ):
        assert found(RF.lines(spark, root, 8).where(condition)) == sorted(r for r in both if test(*r[:2])), condition
    assert RF.lines(spark, root, 8).where("file = 'b' and offset < 8").rdd.getNumPartitions() == 1 < RF.lines(spark, root, 8).rdd.getNumPartitions()
    reader = RF.BatchReader(RF.Folder({"path": f"file://{root}"}))
    assert list(reader.pushFilters([RF.EqualTo(("file",), "b"), RF.LessThan(("offset",), 4), RF.EqualTo(("text",), "x")])) == [RF.EqualTo(("text",), "x")]
    assert [(p.file, p.start, p.end) for p in reader.partitions()] == [("b", 0, 4)]


def test_what_is_no_record_is_set_aside_with_file_and_offset(spark):
    data = b"\n".join(LINES)
    rows = RF.records(RF.lines(spark, folder(a=data)), "id long, name string").collect()
    at = {line: offset for _, offset, line in expected("a", data)}
    bad = {(r["offset"], bytes(r["raw"]) if r["text"] is None else r["text"].encode()) for r in rows if r["value"] is None}
    assert bad == {(at[line], line) for line in (b'{"id":', b"\xff\xfe", b'{"id": "x"}', b"[]")}
    assert sorted((r["value"]["id"], r["value"]["name"], r["text"], r["raw"]) for r in rows if r["value"]) == [(1, None, None, None), (2, "地点", None, None), (3, None, None, None), (4, None, None, None)]


def streamed(spark, root: str, out: str):
    return J.to_table(RF.line_stream(spark, f"file://{root}", 16), f"{out}/rows", f"{out}/check")


def test_a_stream_takes_each_line_once_over_restarts(spark):
    root, out = folder(), folder()
    assert streamed(spark, root, out).count() == 0
    add(root, "a", b'{"id": 1}\n{"id": 2}\n{"id"')
    assert streamed(spark, root, out).count() == 2  # the last line has no end yet
    add(root, "a", b": 3}\n", "ab")
    assert streamed(spark, root, out).count() == 3
    assert streamed(spark, root, out).count() == 3
    add(root, "a", b'{"id": 4}', "ab")
    add(root, "b", b'{"id": 5}\n')
    assert streamed(spark, root, out).count() == 5  # a later file ends the one before
    assert found(streamed(spark, root, out)) == found(RF.lines(spark, root))


def test_the_same_offsets_give_the_same_rows(spark):
    root = folder(a=b"1\n2\n", b=b"3\n4")
    reader = RF.StreamReader(RF.Folder({"path": root, "split_bytes": "3"}))
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = lambda: [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.column("text").to_pylist()]
    assert rows() == ["1", "2", "3"]
    add(root, "b", b"4\n5\n", "ab")
    add(root, "c", b"6\n")
    assert rows() == ["1", "2", "3"]
    assert end == {"file": "b", "byte": 2, "files": 1, "bytes": 4}
    assert reader.partitions(end, end) == []


def test_a_file_that_comes_late_is_an_error_not_a_loss(spark):
    root, out = folder(b=b"1\n"), folder()
    assert streamed(spark, root, out).count() == 1
    add(root, "a", b"2\n")
    with pytest.raises(StreamingQueryException, match="came late"):
        streamed(spark, root, out)
