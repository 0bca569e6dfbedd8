"""WARC archives as a Spark data source, written in Python.

``WarcSource`` (format ``warc``) reads and writes folders of archives. Each
record is a gzip member of its own, whose extra field holds the member's length,
so a reader may pass over it; plain ``.warc`` files are read as well. A reading
task gets whole files, packed by size. For each record it parses the headers
first, from the first bytes of the member, and holds them against the predicates
that Spark pushed down (on the record type and every other header column). Only
a record that passes has its payload decoded; with the option
``payload=false`` none has, and the column is null.

Paths go through ``pyarrow.fs``, so any store that it knows will do. A writing
task writes under a name of its own; the driver renames what committed tasks
wrote, so a task that is run again leaves nothing twice.

``archive_pages`` decides which of the equal payloads is the response and writes
the archives; ``page_records`` reads them back.

Defined results: a null payload counts as empty; rows of equal payloads that
share the smallest id are all responses; null ids sort last; where all ids of
equal payloads are null, all are responses; an empty table writes and gives
nothing; line ends in a URL become spaces; other columns are not read.
"""

from __future__ import annotations

import datetime
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import checkpointed, shared_dir

#: Column and header of what is read; page_id and refers_to are extension fields.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length", "page_id": "WARC-Page-ID", "refers_to": "WARC-Refers-To-Page-ID",
}
LONGS = ("payload_bytes", "page_id", "refers_to")
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, page_id long, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
#: At most so many groups of equal payloads (about 100 bytes each) are broadcast.
BROADCAST_GROUPS = 200_000


# -- records ----------------------------------------------------------------


def _member(data: bytes) -> bytes:
    """A gzip member whose extra field SL holds its whole length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: object) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def record(fields: dict, payload: bytes) -> bytes:
    """The bytes of one record; a revisit has the HTTP header alone."""
    revisit = fields["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = ["WARC/1.1", *(f"{name}: {_clean(fields[column])}" for column, name in HEADERS.items() if fields.get(column) is not None)]
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _value(headers: dict[str, str], column: str):
    value = headers.get(HEADERS[column].lower())
    if value is None:
        return None
    return int(value) if column in LONGS else value


def _payload(block: bytes, headers: dict[str, str]) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def read_records(f: io.BufferedIOBase, wanted, decode: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records that ``wanted(headers)`` lets pass."""
    while True:
        at = f.tell()
        start = f.read(2)
        if not start:
            return
        f.seek(at)
        found = _from_member(f, at, wanted, decode) if start == b"\x1f\x8b" else _from_plain(f, wanted, decode)
        if found:
            yield found


def _from_plain(f, wanted, decode):
    head = b""
    while not head.endswith(b"\r\n\r\n"):
        line = f.readline()
        if not line:
            if head.strip():
                raise ValueError("a WARC record ends within its headers")
            return None
        head = line if head in (b"", b"\r\n") else head + line
    headers = _headers(head)
    size = int(headers["content-length"])
    if not wanted(headers):
        f.seek(size + 4, io.SEEK_CUR)
        return None
    if not decode:
        f.seek(size + 4, io.SEEK_CUR)
        return headers, None
    block = f.read(size)
    f.seek(4, io.SEEK_CUR)
    return headers, _payload(block, headers)


def _from_member(f, at, wanted, decode):
    fixed = f.read(12)
    length = None
    if fixed[3] & 4:
        extra = f.read(struct.unpack("<H", fixed[10:12])[0])
        if len(extra) >= 8 and extra[:2] == b"SL":
            length = struct.unpack("<I", extra[4:8])[0]
    f.seek(at)
    unpack = zlib.decompressobj(31)
    data, left = b"", length
    while b"\r\n\r\n" not in data and not unpack.eof:
        more = f.read(min(2048, left) if left is not None else 2048)
        if not more:
            break
        left = None if left is None else left - len(more)
        data += unpack.decompress(more)
    head, _, block = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    keep = wanted(headers)
    need = keep and decode
    if length is not None and not need:
        f.seek(at + length)
        return (headers, None) if keep else None
    parts = [block]
    while not unpack.eof:  # without a length, the end is found by decompression
        more = f.read(1 << 16 if left is None else max(1, left))
        if not more:
            raise ValueError("a gzip member ends too early")
        left = None if left is None else left - len(more)
        out = unpack.decompress(more)
        if need:
            parts.append(out)
    f.seek(f.tell() - len(unpack.unused_data))
    if not keep:
        return None
    return headers, _payload(b"".join(parts)[: int(headers["content-length"])], headers) if need else None


# -- the data source --------------------------------------------------------


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


def _test(found: Filter):
    """What a pushed filter asks of a record's headers; None if it can't be answered from them."""
    if isinstance(found, Not):
        inner = _test(found.child)
        return inner and (lambda h: (x := inner(h)) is not None and not x)
    column = found.attribute[0] if len(getattr(found, "attribute", ())) == 1 else ""
    if column not in HEADERS:
        return None
    if isinstance(found, IsNull):
        return lambda h: _value(h, column) is None
    if isinstance(found, IsNotNull):
        return lambda h: _value(h, column) is not None
    if isinstance(found, EqualNullSafe):
        return lambda h: _value(h, column) == found.value
    tests = {EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, StringStartsWith: lambda v, w: v.startswith(w), StringEndsWith: lambda v, w: v.endswith(w), StringContains: lambda v, w: w in v}
    test = tests.get(type(found))
    if not test:
        return None
    return lambda h: None if (v := _value(h, column)) is None else test(v, found.value)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.decode = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]):
        for found in filters:
            test = _test(found)
            if test:
                self.tests.append(test)
            else:
                yield found

    def partitions(self) -> list[_Files]:
        store, path = fs.FileSystem.from_uri(self.path)
        files = sorted((x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
        packs, room = [], 0
        for x in files:
            if not packs or x.size > room:
                packs.append([])
                room = PARTITION_BYTES
            packs[-1].append(x.path)
            room -= x.size
        return [_Files(tuple(p)) for p in packs] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        wanted = lambda h: all(test(h) for test in self.tests)
        kinds = {c: pa.int64() if c in LONGS else pa.string() for c in HEADERS}
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([_value(h, c) for h, _ in rows], kind) for c, kind in kinds.items()]
            return pa.RecordBatch.from_arrays([*columns, pa.array([p for _, p in rows], pa.binary())], names=[*kinds, "payload"])

        for path in partition.paths:
            with io.BufferedReader(store.open_input_file(path), 1 << 18) as f:
                for headers, payload in read_records(f, wanted, self.decode):
                    rows.append((headers, payload))
                    size += 500 + len(payload or b"")
                    if size > BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, path = fs.FileSystem.from_uri(self.path)
        names, out = [], None
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in iterator:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                row = {c: v[k].as_py() for c, v in columns.items()}
                payload = row.pop("payload") or b""
                if out is None or out.tell() > FILE_BYTES:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{path}/_open")
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{path}/_open/{names[-1]}", compression=None)
                out.write(_member(record(row | {"date": date}, payload)))
        if out is not None:
            out.close()
        return _Written(tuple(names))

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{path}/_open/{name}", f"{path}/{name}")
        if store.get_file_info(f"{path}/_open").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_open")

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{path}/_open").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_open")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format ``warc`` known, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages ------------------------------------------------------------------


def archive_pages(pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> None:
    """Writes a record per row of ``pages`` into the folder ``path``."""
    register(pages.sparkSession)
    payload = F.coalesce(F.encode(pages[payload_column], "utf-8"), F.lit(b""))
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("target_uri"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    # groups of equal payloads: ids and digests alone are shuffled, counted where they are read
    groups = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = checkpointed(groups.filter("n > 1 and first is not null").select("of", "first"))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda x: F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws("/", x.cast("string"), "digest")), F.lit(">"))
    joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        "payload_bytes",
        "page_id",
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: of responses the payload's own digest and length, of revisits those of their headers."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read_warc(spark, path).filter("record_type = 'response'")
    responses = responses.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    revisits = revisits.withColumn("payload_digest", F.regexp_replace("payload_digest", "^sha256:", ""))
    return responses.select(columns).unionAll(revisits.select(columns))


def archive_and_read(pages: DataFrame, **columns) -> DataFrame:
    """``archive_pages`` into a new folder beside the checkpoints, then ``page_records``."""
    path = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive_pages(pages, path, **columns)
    return page_records(pages.sparkSession, path)
