"""WARC archives as a Spark data source, reading and writing.

``spark.read.format("warc").load(path)`` reads a file or a folder through Arrow's file systems, as the paths of
``spark.checkpoint.dir`` are. Partitions are plans of whole files of about ``partition_bytes`` each. Equality and IN
filters on header columns are pushed down: a record's header is parsed first, and the payload of a record that a filter
rejects is skipped, by a seek in plain files; with option ``payload`` set to false no payload is read. ``.warc.gz``
files are streams: a skipped payload is inflated, but not made into a row.

Columns: warc_type, record_id, target_uri, date, payload_digest, refers_to (a record id), page_id, refers_page (the page of
that record, where our writer made it), payload_length (of the full payload, for revisits also), payload (binary; the block
behind the HTTP header in responses and requests, else the whole block; null for revisits or when not wanted). Header names
are matched in any case. With option ``verify`` set to true the SHA-1 of each payload read is compared with the digest in its
header; a difference is an error, as damaged files are.

Null html is an empty payload; very long payloads are written and read whole, one at a time; an empty table writes no file
and reads as no row. Rows that repeat a page are each written. Of pages only page_id, url and html are read, so other
columns can't clash.

The writer compresses each record by itself, as the format has it, unless option ``compression`` is none. It writes a
file per task under a temporary name and renames it when the job commits; a repeated or lost task
leaves nothing behind that a reader would see.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from pixelmill.llm.shared import Scratch

SCHEMA = "warc_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, page_id string, refers_page string, payload_length long, payload binary"
_HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_id": "X-Page-ID", "refers_page": "X-Refers-To-Page"}
_ARROW = pa.schema([*[(c, pa.string()) for c in _HEADERS], ("payload_length", pa.int64()), ("payload", pa.binary())])
PARTITION_BYTES, BATCH_BYTES = 16 << 20, 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it. A path without a scheme is a local one; Scratch's have theirs."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, sha1: str) -> str:
    """The id of the response record of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{sha1}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record. Line ends in header values become spaces."""
    clean = lambda v: " ".join(v.splitlines()) if v.splitlines() != [v] else v
    lines = ["WARC/1.1", *[f"{k}: {clean(v)}" for k, v in headers.items()], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "false").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in _HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Files([self.path])]
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))]
        plans: list[Files] = []
        room = 0
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file:" if self.path.startswith("file:") else ""
        for f in sorted(found, key=lambda f: f.path):
            path = f.path
            if scheme and scheme != "file://" and scheme != "file:":
                host = self.path.split("://")[1].split("/")[0] if scheme in ("hdfs://", "viewfs://") else ""
                path = f"{scheme}{host}{f.path}"
            if not plans or room < f.size:
                plans.append(Files([]))
                room = self.partition_bytes
            plans[-1].paths.append(path)
            room -= f.size
        return plans or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            fs, name = _open(path)
            with fs.open_input_file(name) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in self._records(stream, path):
                    rows.append(row)
                    size += len(row[-1] or b"") + 300
                    if size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    def _records(self, stream, path: str) -> Iterator[tuple]:
        buffer, base = b"", 0  # bytes read ahead, and where in the stream they begin
        while True:
            end = buffer.find(b"\r\n\r\n")
            while end < 0:
                more = stream.read(1 << 14)
                if not more:
                    if buffer.strip():
                        raise ValueError(f"{path}: a record's header is cut off at {base}")
                    return
                buffer += more
                end = buffer.find(b"\r\n\r\n")
            head = buffer[:end].decode("utf-8", "replace").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise ValueError(f"{path}: no record at {base}")
            headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head[1:])}
            if "content-length" not in headers:
                raise ValueError(f"{path}: a record without a length at {base}")
            length, start = int(headers["content-length"]), end + 4
            values = [headers.get(h.lower()) for h in _HEADERS.values()]
            keep = all(v in self.wanted[c] for c, v in zip(_HEADERS, values, strict=True) if c in self.wanted)
            kind = headers.get("warc-type")
            if keep and self.payload and kind != "revisit":
                while len(buffer) < start + length + 4:
                    more = stream.read(max(1 << 14, start + length + 4 - len(buffer)))
                    if not more:
                        raise ValueError(f"{path}: a payload is cut off at {base}")
                    buffer += more
                block = buffer[start : start + length]
                payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "request") and "http" in headers.get("content-type", "") else block
                if self.verify and (said := headers.get("warc-payload-digest", "")).startswith("sha1:") and said[5:].upper() != digest(payload):
                    raise ValueError(f"{path}: a payload differs from its digest at {base}")
            else:
                payload = None
            size = headers.get("x-payload-length")
            if keep:
                yield (*values, int(size) if size is not None else None if payload is None else len(payload), payload)
            rest = start + length + 4
            if rest <= len(buffer):
                buffer, base = buffer[rest:], base + rest
            else:
                base += rest
                stream.seek(base)
                buffer = b""


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (page_id, url, html, refers_to): a response, or a revisit where the page refers_to is set.

    A response's record id follows from its page and digest, so a revisit names it without having seen it; rows that
    repeat a page with the same payload are records of one id. Records of pages without an id, and revisits, have random ids.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.plain = options.get("compression", "gzip").lower() == "none"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/_{uuid.uuid4().hex}.tmp"
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        any_row = False
        with fs.open_output_stream(name) as out:
            for batch in iterator:
                for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    any_row = True
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    sha1 = digest(payload)
                    own = record_id(page, sha1) if page is not None and refers is None else f"<urn:uuid:{uuid.uuid4()}>"
                    headers = {"WARC-Type": "revisit" if refers is not None else "response", "WARC-Record-ID": own, "WARC-Date": now, "WARC-Payload-Digest": "sha1:" + sha1, "X-Payload-Length": str(len(payload))}
                    for header, value in (("WARC-Target-URI", url), ("X-Page-ID", page), ("X-Refers-To-Page", refers)):
                        if value is not None:
                            headers[header] = str(value)
                    if refers is not None:
                        headers["WARC-Refers-To"] = record_id(refers, sha1)
                    if refers is not None:
                        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    headers["Content-Type"] = "application/http; msgtype=response"
                    whole = record(headers, b"" if refers is not None else _HTTP + payload)
                    out.write(whole if self.plain else gzip.compress(whole, 5, mtime=0))
        if not any_row:
            fs.delete_file(name)
            return Written(None)
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, f"{root}/part-{m.path.rpartition('/_')[2].removesuffix('.tmp')}.warc{'' if self.plain else '.gz'}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the least page_id of equal payloads, null for that page itself.

    Only digests move for the search; a payload moves once, by its page and digest. Payloads under ``least_bytes`` and pages
    without an id are all responses, and so are rows that repeat a page_id.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    slim = keyed.where(F.col("page_id").isNotNull()).select("page_id", "digest", F.octet_length(html).alias("size")).where(F.col("size") >= least_bytes)
    first = slim.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    refers = slim.join(first, ["digest", "size"]).where("page_id > refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    return keyed.join(refers, ["page_id", "digest"], "left").drop("digest")


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder and returns what they say of each page."""
    spark = pages.sparkSession
    register(spark)
    where = Scratch(spark, "warc").path("archive")
    text = deduplicated(pages).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    text.write.format("warc").mode("append").save(where)
    return spark.read.format("warc").option("payload", "true").option("verify", "true").load(where)


#: What op9 returns, for pages with distinct ids: base32 takes 20 bits of the SHA-1, five hexadecimal digits, to four characters.
ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
q as (
  select page_id, octet_length(encode(html))::bigint as payload_bytes, min(page_id) over (partition by h) as first,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::int, 5))::int >> s::int) & 31) + 1, 1)), '')), '') as payload_digest
  from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from q
"""
