"""WARC archives as a PySpark Python data source.

Reading plans one partition a file.  Conditions on the record type and other headers are
pushed down: headers are parsed first, and the block of a record that fails them is
skipped unread (by seeking where the file allows).  ``payload`` says what is done with
the rest: ``bytes`` decodes the payload, ``digest`` only measures and digests it, and
``skip`` passes over it unread (its size is what the headers say).

Writing is left to Spark's text writer with CRLF line ends, so archives go to any store
that Spark writes to; a write that loses an executor is committed once or not at all.
Payloads that equal another's (by SHA-1) become revisit records without a payload.

Record ids hold the page id, URL-encoded, and the start of the payload's digest, so any
id can be written, and pages of one id but different payloads have different record ids.

Edge cases: null html is the empty payload; a null page id is the smallest; rows that
share the largest id of their payload are all responses, repeated rows under one record
id; a file cut short yields its whole records; members of gzip files may hold one record
or many; an empty table gives archives without a page; a payload is held whole, however
long, by the task that writes or digests it; extra columns are not read.

``read_warc`` turns the session's ``spark.sql.python.filterPushdown.enabled`` on, which
lazy reads need until they run.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from quillgraph.llm.common import checkpointed, shared_dir

SCHEMA = "record_id string, record_type string, date string, target_uri string, payload_digest string, refers_to string, payload_bytes long, computed_digest string, headers map<string,string>, payload binary"
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
BROADCAST_ROWS = 300_000


@dataclass
class WarcFile(InputPartition):
    path: str


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _passed(stream: io.BufferedIOBase, size: int) -> None:
    """Go over ``size`` bytes, by seeking where the file allows."""
    if stream.seekable() and not isinstance(getattr(stream, "raw", None), gzip.GzipFile):
        stream.seek(size, 1)
        return
    while size and (got := len(stream.read(min(size, 1 << 16)))):
        size -= got


def records(stream: io.BufferedIOBase, wanted=lambda headers: True, whole: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The headers (lower-case names) and block of each whole record; None for the block of unwanted ones.

    Without ``whole`` the block ends with the HTTP headers, and the payload is passed over.
    """
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if not wanted(headers):
            _passed(stream, size)
            yield headers, None
        elif whole:
            block = stream.read(size)
            if len(block) < size:
                return
            yield headers, block
        else:
            head = b""
            while len(head) < size and "application/http" in headers.get("content-type", ""):
                line = stream.readline(size - len(head))
                head += line
                if line in (b"\r\n", b""):
                    break
            _passed(stream, size - len(head))
            if not stream.readline():  # the block's end lies beyond that of the file
                return
            yield headers, head


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("sha1:")


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in HEADER:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((HEADER[name], "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((HEADER[name], "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((HEADER[name], "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((HEADER[name], "known", None))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        from pyarrow import fs as pafs

        fs, path = _filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [WarcFile(self.path)]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        # What of the given path precedes the file system's own form of it: the scheme and perhaps the host.
        before = self.path[: len(self.path.rstrip("/")) - len(path.rstrip("/"))] if self.path.rstrip("/").endswith(path.rstrip("/")) else ""
        return [WarcFile(before + x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.size and x.base_name[0] not in "._"]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            own = _bare(headers.get(name))
            if own is None or (how == "in" and own not in value) or (how == "starts" and not own.startswith(value)):
                return False
        return True

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        if partition is None:  # a folder without archives
            return
        fs, path = _filesystem(partition.path)
        with fs.open_input_file(path) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            if path.endswith(".gz"):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
            for headers, block in records(stream, self._wanted, self.payload != "skip"):
                if block is None:
                    continue
                known = [_bare(headers.get(h)) for h in HEADER.values()]
                head, _, payload = block.partition(b"\r\n\r\n") if "application/http" in headers.get("content-type", "") else (b"", b"", block)
                size = len(payload)
                if known[1] == "revisit" or self.payload == "skip":  # the size of what it revisits, from the HTTP headers
                    sizes = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    size = int(sizes[0]) if sizes else None
                    if not head and self.payload == "skip":
                        size = int(headers.get("content-length", 0))
                full = known[1] != "revisit" and self.payload != "skip"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else None
                yield (*known, size, digest, headers, payload if full and self.payload == "bytes" else None)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """The records under ``path``; ``payload`` is bytes, digest or skip."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def base32(hexed: str) -> str:
    """SQL expression: the hex digits of 20 bytes in base 32."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (shiftright(v, {}) & 31) + 1, 1)"
    four = ", ".join(digit.format(k) for k in (15, 10, 5, 0))
    return f"array_join(transform(transform(sequence(0, 7), i -> cast(conv(substr({hexed}, 5 * i + 1, 5), 16, 10) AS int)), v -> concat({four})), '')"


def _urn(page: str) -> str:
    """SQL expression: the id of the record of ``page`` with the payload digest ``hex``; a null page is ``~``, which no encoded id is."""
    return f"concat('urn:page:', coalesce(url_encode(cast({page} AS string)), '~'), ':', substr(hex, 1, 16))"


def page_of(record: str) -> str:
    """SQL expression: the page of a record id, as a string."""
    return f"url_decode(nullif(regexp_extract({record}, '^urn:page:([^:]*):', 1), '~'))"


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Write a record a page; payloads of ``least`` bytes or more that repeat are revisits of the largest page id's."""
    rows = pages.select(pages[page_id].alias("n"), F.regexp_replace(F.coalesce(pages[url].cast("string"), F.lit("")), "[\\r\\n]+", " ").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html"), "hex": F.sha1(F.encode("html", "UTF-8"))})
    first = rows.where(F.col("size") >= least).groupBy("hex").agg(F.max("n").alias("top"), F.count("*").alias("c")).where("c > 1").select("hex", "top")
    first = checkpointed(first)
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(first) if few else first, "hex", "left").withColumn("again", F.expr("top IS NOT NULL AND NOT (n <=> top)"))
    known = "concat_ws('\\r\\n', 'WARC/1.1', concat('WARC-Type: ', IF(again, 'revisit', 'response')), concat('WARC-Record-ID: <', {id}, '>'), '{date}', IF(url = '', NULL, concat('WARC-Target-URI: ', url)), concat('WARC-Payload-Digest: sha1:', {digest}), IF(again, concat('WARC-Refers-To: <', {top}, '>'), NULL), IF(again, 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest', NULL), 'Content-Type: application/http; msgtype=response')"
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', size, '\\r\\n\\r\\n', IF(again, '', html))"
    rows = rows.withColumns({"head": F.expr(known.format(id=_urn("n"), top=_urn("top"), date=f"WARC-Date: {date}", digest=base32("hex"))), "block": F.expr(http)})
    record = F.expr("concat(head, '\\r\\nContent-Length: ', octet_length(block), '\\r\\n\\r\\n', block, '\\r\\n')")
    about = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n"
    info = pages.sparkSession.range(1).select(F.lit(about).alias("value"))
    rows.select(record.alias("value")).unionByName(info).write.option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and drop the archives."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least=least)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda record: f"cast({page_of(record)} AS {kind})"
    back = read_warc(spark, path, "digest").where("record_type IN ('response', 'revisit')")  # pushed down: other payloads are not decoded
    out = checkpointed(back.selectExpr(f"{page('record_id')} AS page_id", "payload_bytes", "coalesce(computed_digest, payload_digest) AS payload_digest", "record_type", f"{page('refers_to')} AS refers_to"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out
