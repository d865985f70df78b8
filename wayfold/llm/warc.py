"""WARC archives as a PySpark data source, named `warc`.

Writing: each task writes its own files, rolled at `roll_mb`, under names no other attempt uses; the commit
lists them in a manifest, which is all that a reader looks at. A lost or repeated task leaves files that no
manifest names. A payload is stored as an HTTP response with `Content-Encoding: gzip`, so the headers of
every record can be read as plain text and an unwanted body skipped by its Content-Length.

Reading: one partition for each file of the manifests. A reader parses a record's headers, tests the
predicates that Spark has pushed down (equality, IN, comparisons and null tests of the header columns), and
decodes the payload only of records that pass, and only as option `payload` asks: `full` (default),
`digest` (length and SHA-256 are taken from the payload, which is not returned) or `none` (as the headers
say).

Nulls: a null payload is an empty one, a null URL an empty header. A null page_id is written with an empty
id, read as null, and never the record that others refer to. Rows that repeat a page_id are records of
their own; of equal payloads under the smallest page_id all are responses. Empty tables make archives
without records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, WriterCommitMessage

from .common import new_path, ship, small, table, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, file string, position bigint, payload binary"
#: What a writer takes.
INPUT = ("page_id", "target_uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
HEADERS = ("record_id", "record_type", "target_uri", "date", "page_id", "refers_to", "payload_digest", "payload_bytes")
MANIFEST = "_manifest-"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 100
BATCH_BYTES = 8 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or ":/" in uri else f"file://{uri}")


def _clean(value) -> str:
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, level: int = 1) -> bytes:
    """One record's bytes. row: INPUT's names."""
    kind, revisit = row["record_type"], row["record_type"] == "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = b"" if revisit else gzip.compress(row["payload"] or b"", level, mtime=0)
    block = head + (b"\r\n" if revisit else b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body)) + body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_clean(row['page_id'])}>", f"WARC-Target-URI: {_clean(row['target_uri'])}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"WARC-X-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[str], records: int):
        self.files, self.records = files, records


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        files, out, size, n = [], None, 0, 0
        for batch in iterator:
            columns = {c: batch.column(c) for c in INPUT}
            for i in range(batch.num_rows):
                if out is None or size >= self.roll:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = fs.open_output_stream(f"{top}/{files[-1]}"), 0
                data = record({c: v[i].as_py() for c, v in columns.items()})
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
        return Written(files, n)

    def commit(self, messages) -> None:
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"files": sorted(x for m in messages if m for x in m.files)}).encode())

    def abort(self, messages) -> None:
        fs, top = _fs(self.path)
        for x in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{top}/{x}")


class File(InputPartition):
    def __init__(self, name: str):
        self.name = name


_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    EqualNullSafe: lambda v, x: v == x,
    In: lambda v, x: v is not None and v in x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    IsNull: lambda v, x: v is None,
    IsNotNull: lambda v, x: v is not None,
}


def _passes(filters: list, row: dict) -> bool:
    for f in filters:
        negated, g = (True, f.child) if isinstance(f, Not) else (False, f)
        value = row[g.attribute[0]]
        if negated and value is None:
            return False
        if _TESTS[type(g)](value, getattr(g, "value", None)) == negated:
            return False
    return True


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


def records(stream, filters: list, payload: str) -> Iterator[dict]:
    """The records of an archive that pass the filters; bodies of the others are skipped undecoded."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        at, lines = stream.tell() - len(line), []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        h = _headers(lines)
        row = {
            "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "page_id": _page(h.get("warc-record-id")), "refers_to": _page(h.get("warc-refers-to")), "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
            "payload_bytes": int(h["warc-x-payload-length"]) if "warc-x-payload-length" in h else None, "position": at, "payload": None,
        }
        size = int(h.get("content-length", 0))
        if not _passes(filters, row):
            stream.seek(size, 1)
            continue
        if payload == "none" or row["record_type"] != "response":
            stream.seek(size, 1)
        else:
            head, _, body = stream.read(size).partition(b"\r\n\r\n")
            body = zlib.decompress(body, 47) if b"content-encoding: gzip" in head.lower() else body
            if payload == "digest":
                row |= {"payload_digest": hashlib.sha256(body).hexdigest(), "payload_bytes": len(body)}
            else:
                row["payload"] = body
        yield row


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            g = f.child if isinstance(f, Not) else f
            ours = type(g) in _TESTS and len(g.attribute) == 1 and g.attribute[0] in HEADERS
            # with `digest`, what the payload says replaces these headers: Spark tests them
            if ours and not (self.payload == "digest" and g.attribute[0].startswith("payload_")):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        from pyarrow.fs import FileSelector

        fs, top = _fs(self.path)
        found: list[str] = []
        for x in fs.get_file_info(FileSelector(top)):
            if x.base_name.startswith(MANIFEST):
                with fs.open_input_stream(x.path) as f:
                    found += json.loads(f.read())["files"]
        return [File(x) for x in sorted(found)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, top = _fs(self.path)
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "position": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

        with fs.open_input_file(f"{top}/{partition.name}") as f:
            rows, size = [], 0
            for r in records(_Buffered(f), self.filters, self.payload):
                rows.append(r | {"file": partition.name})
                size += 500 + len(r["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class _Buffered:
    """readline, read, seek and tell over a file that has large reads only."""

    def __init__(self, f, block: int = 1 << 20):
        self.f, self.block, self.data, self.at, self.base = f, block, b"", 0, 0

    def _more(self) -> bool:
        self.base, self.data, self.at = self.base + self.at, self.data[self.at :], 0
        new = self.f.read(self.block)
        self.data += new
        return bool(new)

    def readline(self) -> bytes:
        while (i := self.data.find(b"\n", self.at)) < 0 and self._more():
            pass
        end = len(self.data) if i < 0 else i + 1
        out, self.at = self.data[self.at : end], end
        return out

    def read(self, n: int) -> bytes:
        while len(self.data) - self.at < n and self._more():
            pass
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def seek(self, n: int, _whence: int = 1) -> None:
        if self.at + n <= len(self.data):
            self.at += n
            return
        to = self.base + self.at + n
        self.f.seek(to)
        self.data, self.at, self.base = b"", 0, to

    def tell(self) -> int:
        return self.base + self.at


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "full"))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("roll_mb", "64")) << 20)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


BROADCAST_REVISITS = 100_000


def archive_rows(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """INPUT's columns for pages (page_id, url, html): which records are revisits, and of what."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digest, size = F.sha2(payload, 256), F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    keyed = pages.select("page_id", digest.alias("payload_digest"), size.alias("payload_bytes")).where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    groups = keyed.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select(F.col("payload_digest").alias("again"), "first")
    groups = small(written(groups, "revisits"), BROADCAST_REVISITS)
    rows = pages.select("page_id", F.col("url").alias("target_uri"), digest.alias("payload_digest"), size.alias("payload_bytes"), payload.alias("payload"))
    joined = rows.join(groups, F.col("payload_digest") == F.col("again"), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select(
        "page_id", "target_uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, roll_mb: int = 64) -> None:
    register(pages.sparkSession)
    archive_rows(pages).write.format("warc").option("path", path).option("roll_mb", str(roll_mb)).mode("append").save()


def read(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("path", path).load()


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    # digests are taken from the payloads of responses; revisits have none, and their headers say all
    responses = read(spark, path, "digest").where(F.col("record_type") == "response")
    revisits = read(spark, path, "none").where((F.col("record_type") == "revisit") & F.col("refers_to").isNotNull())
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM (SELECT p.*, first, first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM p LEFT JOIN f ON p.d = f.d AND n >= 100) AS p
"""
