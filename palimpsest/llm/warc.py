"""WARC archives as a table of chunks.

A record is the run of its rows (record_no, chunk_no, n_chunks, data): the data of an archive file's records, one
after the other, is a WARC file. Payloads beyond `chunk` bytes take several rows and never stand in one value again
beside the source's own: the writer takes a running digest over slices of the source's bytes and hands out one chunk
after the other, a reader of chunks carries an incremental digest from row to row. Records of one row (nearly all) are
written and parsed by column expressions alone; only the rows of oversized records are brought together.

Of records with equal payloads (digest and size) of at least min_bytes, that with the smallest page_id is a
`response`, the others are `revisit` records without payload that refer to it.

Defined results: null html is an empty payload; a null page_id never serves as target and comes back as null; rows
with the same id and payload are all responses; a null url is `about:blank`; line ends and other control characters
in urls are percent-encoded; an empty table gives an empty archive; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import in_arrow, staged

CHUNK = 1 << 16
#: Rows of first records and of revisits up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Parts that the records of one digest are dealt in where that join is shuffled.
SALTS = 32
CRLF = "\r\n"
GAP = CRLF + CRLF
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """RFC 4648 base32 of 20 bytes given as 40 hex digits: 10 digits (40 bits) make 8 letters."""
    parts = [F.lpad(F.conv(F.substring(hex40, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _binary(c: Column) -> Column:
    return c.cast("binary")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, n) of oversized payloads, by a running digest over slices."""
    for b in batches:
        digests = [_running_digest(memoryview(v.as_buffer())) for v in b.column("payload")]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests, pa.string()), b.column("n")], names=["id", "digest", "n"])


def _running_digest(raw: memoryview) -> str:
    sha = hashlib.sha1()
    for at in range(0, len(raw), CHUNK):
        sha.update(raw[at : at + CHUNK])
    return sha.hexdigest()


def _bounded(df: DataFrame) -> DataFrame:
    """df, which was written, for a broadcast if its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _revisits(prints: DataFrame) -> DataFrame:
    """(id, digest, n, first) of the records that have a first one with a smaller id."""
    firsts = prints.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    firsts = staged(firsts, "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        joined = prints.join(F.broadcast(firsts), ["digest", "n"])
    else:  # an empty page may be a third of all
        dealt = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "n", "salt"])
    return staged(joined.where("id > first").select("id", "digest", "n", "first").distinct(), "revisits")


def _head(digest: Column, first: Column, again: Column, date: str) -> Column:
    """The record's own header lines and those of its HTTP block, as text."""
    def line(name: str, value: Column) -> list[Column]:
        return [F.lit(f"{name}: "), value, F.lit(CRLF)]

    safe = F.coalesce(F.col("url"), F.lit("about:blank"))
    for c, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        safe = F.when(safe.rlike(r"[\x00\r\n]"), F.replace(safe, F.lit(c), F.lit(code))).otherwise(safe) if c == "%" else F.replace(safe, F.lit(c), F.lit(code))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(GAP))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        *line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        *line("WARC-Record-ID", name(F.col("id"))),
        *line("WARC-Date", F.lit(date)),
        *line("WARC-Target-URI", safe),
        *line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(again, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{CRLF}"), *line("WARC-Refers-To", name(first)))).otherwise(F.lit("")),
        *line("Content-Type", F.lit("application/http; msgtype=response")),
        *line("Content-Length", block.cast("string")),
        F.lit(CRLF), http,
    )


ROWS = "record_no long, chunk_no int, n_chunks int, data binary"
# What stands in the header lines of an oversized record until its digest is known; urls have no such character.
_DIGEST, _FIRST = "\0d", "\0f"


def _chunks_of(chunk: int):
    """Oversized records to their rows, one chunk after the other."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def row(no: int, i: int, n: int, *data: memoryview | bytes) -> pa.RecordBatch:
        cells = [pa.array([no]), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([b"".join(data)], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, fresh_head, again_head, firsts, payload in zip(*(b.column(c) for c in ("record_no", "fresh", "again", "firsts", "payload"))):
                raw = memoryview(payload.as_buffer())
                digest = _running_digest(raw)
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                first = next((x["first"] for x in firsts.as_py() or () if x["digest"] == digest and x["n"] == len(raw)), None)
                if first is not None:
                    yield row(no.as_py(), 0, 1, again_head.as_py().replace(_DIGEST, b32).replace(_FIRST, str(first)).encode(), GAP.encode())
                    continue
                n = -(-len(raw) // chunk)
                for i in range(n):
                    head = fresh_head.as_py().replace(_DIGEST, b32).encode() if i == 0 else b""
                    yield row(no.as_py(), i, n, head, raw[i * chunk : (i + 1) * chunk], GAP.encode() if i == n - 1 else b"")

    return run


def write_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The chunk table of all pages' records, written to the shared folder."""
    cell = lambda c, kind: F.col(f"`{c}`").cast(kind)
    rows = pages.select(cell(key, "long").alias("id"), cell(url, "string").alias("url"), _binary(F.coalesce(cell(html, "string"), F.lit(""))).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long"))
    small, large = rows.where(F.col("n") <= chunk).withColumn("digest", F.sha1("payload")), rows.where(F.col("n") > chunk)
    # Rows without an id may be copies as well, but cannot be found again by it: they are responses.
    may = (F.col("n") >= min_bytes) & F.col("id").isNotNull()
    prints = small.where(may).select("id", "digest", "n").unionByName(in_arrow(large.where(may).select("id", "payload", "n"), _fingerprints, "id long, digest string, n long"))
    revisits = _revisits(staged(prints, "fingerprints"))

    again = F.col("first").isNotNull()
    head = _head(base32(F.col("digest")), F.col("first"), again, date)
    data = F.concat(_binary(head), F.when(again, F.lit(b"")).otherwise(F.col("payload")), _binary(F.lit(GAP)))
    one = small.join(_bounded(revisits.where(F.col("n") <= chunk)), ["id", "digest", "n"], "left")
    one = one.select(F.monotonically_increasing_id().alias("record_no"), F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks"), data.alias("data"))
    firsts = revisits.where(F.col("n") > chunk).groupBy("id").agg(F.collect_list(F.struct("digest", "n", "first")).alias("firsts"))
    many = large.join(_bounded(staged(firsts, "firsts")), "id", "left")
    heads = [_head(F.lit(_DIGEST), F.lit(_FIRST), F.lit(x), date).alias(name) for name, x in (("fresh", False), ("again", True))]
    many = many.select((-1 - F.monotonically_increasing_id()).alias("record_no"), *heads, "firsts", "payload")
    return staged(one.unionByName(in_arrow(many, _chunks_of(chunk), ROWS)), "warc")


READ = "head string, http string, payload_bytes long, digest string, whole boolean"


def _oversized(chunks: DataFrame) -> DataFrame:
    """Records of several rows, read chunk by chunk with a running digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = http = b""
        sha, seen, due = hashlib.sha1(), 0, 0
        for b in batches:
            out = []
            for no, n, data in zip(b.column("chunk_no").to_pylist(), b.column("n_chunks").to_pylist(), b.column("data").to_pylist()):
                if no == 0:
                    head, _, data = data.partition(GAP.encode())
                    http, _, data = data.partition(GAP.encode())
                    length = next(x for x in head.split(CRLF.encode()) if x.lower().startswith(b"content-length:"))
                    sha, seen, due = hashlib.sha1(), 0, int(length.split(b":")[1]) - len(http) - len(GAP)
                tail = b""
                if no == n - 1:
                    data, tail = data[: due - seen], data[due - seen :]
                sha.update(data)
                seen += len(data)
                if no == n - 1:
                    out.append((head.decode(), http.decode(), seen, sha.hexdigest(), seen == due and tail == GAP.encode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=[c.split()[0] for c in READ.split(", ")])

    ordered = chunks.where("n_chunks > 1").repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
    return in_arrow(ordered.select("chunk_no", "n_chunks", "data"), run, READ)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)\n{name}: *([^\r\n]*)", 1)


def read_records(chunks: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, intact) of every record of a chunk table.

    A revisit's size and digest are those that its own headers state; intact: lengths and digest of the stored
    bytes fit the headers.
    """
    text = F.col("data").cast("string")
    before = lambda c: F.substring_index(c, GAP, 1)
    one = chunks.where("n_chunks = 1").withColumn("head", before(text))
    one = one.withColumn("block", F.substring(F.col("data"), F.octet_length("head") + 5, F.octet_length("data")))
    one = one.withColumn("http", before(F.col("block").cast("string"))).withColumn("due", F.expr("try_cast(regexp_extract(head, '(?i)\\\\nContent-Length: *([0-9]+)', 1) as int)"))
    one = one.withColumn("payload", F.substring(F.col("block"), F.octet_length("http") + 5, F.col("due") - F.octet_length("http") - 4))
    one = one.select(
        "head", "http", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"),
        (F.octet_length("block") == F.col("due") + 4).alias("whole"),
    )
    both = one.unionByName(_oversized(chunks))
    again = F.col("record_type") == "revisit"
    return (
        both.withColumns({
            "record_type": _field("WARC-Type"),
            "page_id": _field("WARC-Record-ID"), "refers_to": _field("WARC-Refers-To"), "url": _field("WARC-Target-URI"),
            "stated": F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1),
        })
        .select(
            *[F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)").alias(c) for c in ("page_id",)],
            "url", "record_type",
            F.when(again, F.expr("try_cast(regexp_extract(http, '(?i)\\\\nContent-Length: *([0-9]+)', 1) as bigint)")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(again, F.col("stated")).otherwise(base32(F.col("digest"))).alias("payload_digest"),
            F.expr("try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1) as bigint)").alias("refers_to"),
            (F.col("whole") & (again | (base32(F.col("digest")) == F.col("stated")))).alias("intact"),
        )
    )
