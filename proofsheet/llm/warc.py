"""Operator 9: WARC archives as a PySpark Python data source.

Reading plans one partition per archive file, parses record headers first, and
jumps over the blocks of records that a pushed predicate rules out or whose
payload is not asked for.  Predicates on the record type and on the header
columns come from Spark's filters where
``spark.sql.python.filterPushdown.enabled`` is on, and from the options
``record_type`` and ``header.<Name>`` in any case.  Option ``payload`` asks for
the decoded payload, ``verify`` checks it against its digest.

Writing rolls files of about ROLL_BYTES; a task's files count only once the
driver has committed them to the manifest ``_files``, so that retried tasks
leave nothing that is read.  Files ending in .gz hold one member a record.

Records of equal payloads of at least ``min_bytes`` bytes: the smallest page id
is the response, the others are revisits of it without payload.

Defined results: a null payload is empty; a null URL leaves the header out and
comes back null; a null page id is written as such and always a response;
records with the smallest id are all responses; an empty table gives archives
without records and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    WriterCommitMessage)

from proofsheet.session import checkpoint_dir, saved

ROLL_BYTES = 64 << 20
#: Column of the data source -> WARC header (fixed names of the format).
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary"
#: A fixed date: archives of the same rows are the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Repeated digests that are broadcast at once (about 100 bytes each), and pages of one digest that no single task should get.
BROADCAST_DIGESTS, HOT_PAGES = 1 << 19, 1 << 12
#: Rows and payload bytes of a batch handed to Spark.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def record(fields: dict[str, str | None], payload: bytes | None, payload_bytes: int) -> bytes:
    """One WARC record: an HTTP response head that tells the payload's size, and the payload unless it is a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1"]
    for column, value in fields.items():
        if value is not None:
            lines.append(f"{HEADERS[column]}: {urllib.parse.quote(value, safe=URI_SAFE) if column == 'target_uri' else value}")
    lines += [f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload or b'')}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + head + (payload or b"") + b"\r\n\r\n"


#: Printable ASCII but the percent sign stays as it is in a URI header.
URI_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def parse_headers(stream) -> dict[str, str] | None:
    """Headers up to the blank line, by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no WARC record where one should begin")
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def http_size(stream, length: int) -> tuple[int, int]:
    """(bytes of the HTTP head, Content-Length it states) at the start of a block."""
    used, size = 0, -1
    while used < length:
        line = stream.readline()
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            size = int(value)
    return used, size


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        #: column, or header in lower case, -> values of which a record must have one
        self.wanted: dict[str, set[str]] = {}
        if "record_type" in options:
            self.want("record_type", {options["record_type"]})
        for name, value in options.items():
            if name.lower().startswith("header."):
                self.want(name[len("header."):].lower(), {value})

    def want(self, name: str, values: set[str]) -> None:
        self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self):
        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [ArchiveFile(self.path)]
        manifests = [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith("_files")]
        names = sorted({n for m in manifests for n in json.loads(fs.open_input_stream(m).read())}) if manifests else sorted(
            x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [ArchiveFile(f"{self.path.rstrip('/')}/{n}") for n in names]

    def records(self, stream) -> Iterator[tuple]:
        while (headers := parse_headers(stream)) is not None:
            length = int(headers["content-length"])
            row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
            if row["target_uri"] is not None:
                row["target_uri"] = urllib.parse.unquote(row["target_uri"])
            if row["payload_digest"] is not None:
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            if any((row[x] if x in row else headers.get(x)) not in values for x, values in self.wanted.items()):
                stream.seek(length, io.SEEK_CUR)
                continue
            used, size = http_size(stream, length) if "http" in headers.get("content-type", "") else (0, length)
            payload = None
            if self.payload and headers.get("warc-type") != "revisit":
                payload = stream.read(length - used)
                if self.verify and headers.get("warc-payload-digest") not in (None, f"sha1:{digest(payload)}"):
                    raise ValueError(f"payload of {headers.get('warc-record-id')} differs from its digest")
            else:
                stream.seek(length - used, io.SEEK_CUR)
            yield (*row.values(), size if size >= 0 else length - used, payload)

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where no partition was planned
            return
        fs, path = filesystem(partition.path)
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        names = [*HEADERS, "payload_bytes", "payload"]
        rows: list[tuple] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), types)], names)

        with fs.open_input_file(path) as raw:
            plain = io.BufferedReader(raw, 1 << 20)
            stream = gzip.GzipFile(fileobj=plain) if path.endswith(".gz") else plain
            for row in self.records(stream):
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()


class PushingReader(WarcReader):
    """Takes part in Spark's filter pushdown; Spark refuses such a reader where that is off."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
                self.want(name, {f.value})
            elif name in HEADERS and isinstance(f, In):
                self.want(name, {v for v in f.value if isinstance(v, str)})
            else:
                yield f  # Spark keeps what the headers do not decide


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.compress = options.get("compression", "none").lower() == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                payloads = batch.column("payload")
                for i, row in enumerate(batch.drop_columns("payload").to_pylist()):
                    body = payloads[i].as_py() or b""  # one payload at a time
                    n = row.pop("payload_bytes", None)
                    data = record(row, None if row["record_type"] == "revisit" else body, len(body) if n is None else n)
                    data = gzip.compress(data, 6) if self.compress else data
                    if out is None or size > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                        out, size = fs.open_output_stream(f"{path.rstrip('/')}/{names[-1]}", compression=None), 0  # members are compressed one by one
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                if x.base_name.startswith("_files"):
                    fs.delete_file(x.path)
        names = [n for m in messages if m is not None for n in m.names]
        with fs.open_output_stream(f"{path.rstrip('/')}/_files-{uuid.uuid4().hex}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, path = filesystem(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                fs.delete_file(f"{path.rstrip('/')}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader)(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages as WARC records, revisits of equal payloads among them.

    What is a revisit follows from digests and ids alone.  The repeated digests
    meet the pages by a broadcast where they are few (their number is counted
    first), so no payload moves.  Beyond that those of more than HOT_PAGES pages
    are broadcast, at most one for each HOT_PAGES pages of the table, and the
    pages of the others are joined by digest."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("target_uri"), body.cast("binary").alias("payload"),
                        F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).cast("long").alias("payload_bytes"))
    again = saved(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1"))
    if again.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(again.drop("n")), "sha", "left")
    else:
        hot, others = again.where(F.col("n") > HOT_PAGES).drop("n"), again.where(F.col("n") <= HOT_PAGES).drop("n")
        rows = rows.join(F.broadcast(hot), "sha").unionByName(rows.join(F.broadcast(hot), "sha", "left_anti").join(others, "sha", "left"))
    revisit = F.col("page") > F.col("first")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(urn(F.col("page")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
                       F.when(revisit, urn(F.col("first"))).alias("refers_to"), "sha", "payload_bytes",
                       F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"))


def base32(hex_digest: Column) -> Column:
    """Base 32 of a hex digest whose bits are a multiple of 40 and of 5: each 5 hex digits are 4 letters."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    def four(i):
        v = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("long")
        return [F.element_at(letters, (F.shiftright(v, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int")) for k in range(4)]
    return F.concat(*[c for i in range(8) for c in four(i)])


def write_pages(pages: DataFrame, path: str, **options) -> None:
    register(pages.sparkSession)
    records = page_records(pages, **options)
    (records.select("record_id", "record_type", "target_uri", "refers_to", F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"),
                    "payload_bytes", "payload").write.format("warc").mode("append").save(path))


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of the archives under ``path``; filters are pushed down where the session allows it."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").options(pushdown=pushdown, **options).load(path)


def records_of(spark: SparkSession, path: str, record_type: str, **options) -> DataFrame:
    """Records of one type: by a pushed filter where the session allows it, else the reader's option skips the others."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() != "true":
        options["record_type"] = record_type
    return read_archives(spark, path, **options).where(F.col("record_type") == record_type)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Pages written as archives into the shared folder and read back: responses
    with their payload checked, revisits by their headers alone."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, **options)
    responses = records_of(spark, path, "response", payload="true", verify="true")
    revisits = records_of(spark, path, "revisit")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return responses.unionByName(revisits).select(page(F.col("record_id")).alias("page_id"), "target_uri", "payload_bytes", "payload_digest", "record_type",
                                                  page(F.col("refers_to")).alias("refers_to"), "payload")
