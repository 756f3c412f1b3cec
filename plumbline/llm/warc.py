"""WARC archives as a Spark data source (format ``warc``), written and read in Python tasks.

Writing: each task writes its records to files of its own that roll over at ``rollBytes``; every record is a gzip member
whose extra field ``sl`` holds the lengths of the member and of its content, so a reader can go from record to record
without inflating. The driver's commit lists the files of successful attempts in ``_manifest.json``; what a lost or
repeated attempt left is never read.

Reading: files are the partitions, planned from the manifest, or, where there is none, from the folder. Equality and
``IN`` predicates on the record type, the page id, the target URI and the payload digest, prefixes of the URI and null
tests of these are pushed down: a record's headers are parsed first, and the payload of one that fails is neither
inflated nor decoded. Columns that a query does not ask for are left out by the ``columns`` option
(``payload`` is then never inflated beyond the headers).

Rows of a table: see ``plan_records``. A null payload counts as empty. A null page id gets a record id made from the
record's content. Control characters of a URL are percent-encoded. Broken members end a file with an error.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, refers_to long, payload_bytes long, payload binary"
_ARROW = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
_PUSHED = ("page_id", "record_type", "target_uri", "payload_digest", "refers_to")
#: A payload shorter than this is always stored.
LEAST_SHARED = 100
SALTS = 32
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a URI or a local path; a shared folder can be any that pyarrow reaches."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- records ---------------------------------------------------------------------------------------------------------


def _uri(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in text)


def _record_id(page_id: int | None, digest: str, url: str | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {url}')}>"


def member(row: dict, level: int = 1) -> bytes:
    """One record as a gzip member with its lengths in the extra field."""
    payload = row["payload"] or b""
    size, digest, revisit = row["payload_bytes"], row["payload_digest"], row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_record_id(row['page_id'], digest, row['target_uri'])}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    content = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(content) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip(" \t").lower()] = value.strip(" \t")  # other white space is part of a value
    return out


class Members:
    """The gzip members of a file, one after another; only as much is inflated as is asked for."""

    def __init__(self, stream, size: int, chunk: int = 1 << 20):
        self.stream, self.size, self.chunk = stream, size, chunk
        self.buffer, self.at, self.base = b"", 0, 0  # base: the file's offset of the buffer's first byte

    def need(self, n: int) -> bool:
        while len(self.buffer) - self.at < n:
            more = self.stream.read(max(self.chunk, n))
            if not more:
                return False
            self.buffer, self.base, self.at = self.buffer[self.at :] + more, self.base + self.at, 0
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, object]]:
        """Headers, the start of the block as far as it was inflated, and a function that gives the whole block."""
        while self.need(1):
            if not self.need(12) or self.buffer[self.at : self.at + 3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at {self.base + self.at}")
            head, known = 10, None
            flags = self.buffer[self.at + 3]
            if flags & 4:
                (n,) = struct.unpack_from("<H", self.buffer, self.at + 10)
                if not self.need(12 + n):
                    raise ValueError("a member ends early")
                extra, k = self.buffer[self.at + 12 : self.at + 12 + n], 0
                while k + 4 <= n:
                    (m,) = struct.unpack_from("<H", extra, k + 2)
                    if extra[k : k + 2] == b"sl" and m == 8:
                        known = struct.unpack_from("<I", extra, k + 4)[0]
                    k += 4 + m
                head += 2 + n
            if flags & ~4:
                raise ValueError("members with names or comments are not supported")
            if known is not None:
                if not self.need(known):
                    raise ValueError("a member ends early")
                raw = memoryview(self.buffer)[self.at + head : self.at + known - 8]
                inflate = zlib.decompressobj(-15)
                start = inflate.decompress(raw, 4096)
                while start.count(b"\r\n\r\n") < 2 and not inflate.eof:  # up to the end of the HTTP header behind the record's own
                    more = inflate.decompress(inflate.unconsumed_tail, len(start) or 4096)
                    if not more:
                        break
                    start += more
                crc = struct.unpack_from("<I", self.buffer, self.at + known - 8)[0]
                step = known
            else:  # its length is unknown: inflate it all
                inflate = zlib.decompressobj(-15)
                start, used = b"", self.at + head
                while not inflate.eof:
                    if used >= len(self.buffer):
                        held = used - self.at
                        if not self.need(held + 1):
                            raise ValueError("a member ends early")
                        used = self.at + held
                    start += inflate.decompress(self.buffer[used:])
                    used = len(self.buffer) - len(inflate.unused_data)
                held = used - self.at
                if not self.need(held + 8):
                    raise ValueError("a member ends early")
                crc = struct.unpack_from("<I", self.buffer, self.at + held)[0]
                step = held + 8
            headers, sep, rest = start.partition(b"\r\n\r\n")
            if not sep or not headers.startswith(b"WARC/"):
                raise ValueError("a record has no headers")
            parsed = parse_headers(headers)

            def whole(inflate=inflate, start=start, rest=rest, parsed=parsed, crc=crc) -> bytes:
                more = inflate.decompress(inflate.unconsumed_tail) + inflate.flush() if not inflate.eof or inflate.unconsumed_tail else b""
                if zlib.crc32(more, zlib.crc32(start)) != crc:
                    raise ValueError("a record's checksum does not match")
                return (rest + more)[: int(parsed["content-length"])]

            yield parsed, rest, whole
            self.at += step


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def header_row(headers: dict[str, str]) -> dict:
    digest = headers.get("warc-payload-digest", "")
    return {
        "page_id": _page(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha256:") or None,
        "refers_to": _page(headers.get("warc-refers-to")),
    }


# --- the data source -------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class File(InputPartition):
    path: str
    size: int


class WarcSource(DataSource):
    """Options: path; for writing rollBytes and level; for reading columns (comma-separated; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", ",".join(_ARROW)).split(",")]
        return ", ".join(x for x in SCHEMA.split(", ") if x.split(" ")[0] in wanted)

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("rollbytes", 64 << 20)), int(self.options.get("level", 1)))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, roll: int, level: int):
        self.path, self.roll, self.level = path.rstrip("/"), roll, level
        fs, at = filesystem(self.path)
        if overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir_contents(at)

    def write(self, iterator) -> Written:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{at}/{files[-1]}", compression=None), 0
                data = member(row, self.level)
                out.write(data)
                size += len(data)
                if size >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        manifest, kept = f"{at}/_manifest.json", []
        if fs.get_file_info(manifest).type != pafs.FileType.NotFound:  # appended to
            with fs.open_input_stream(manifest) as f:
                kept = json.loads(f.read())
        with fs.open_output_stream(manifest) as f:
            f.write(json.dumps(sorted([*kept, *(x for m in messages if m for x in m.files)])).encode())

    def abort(self, messages) -> None:
        fs, at = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{at}/{x}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path.rstrip("/"), columns, []

    def pushFilters(self, filters):
        for f in filters:
            test = None
            if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                test = (type(f).__name__, f.attribute[0], getattr(f, "value", None))
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def passes(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            x = row[name]
            ok = {
                "EqualTo": lambda: x is not None and x == value,
                "EqualNullSafe": lambda: x == value,
                "In": lambda: x is not None and x in value,
                "StringStartsWith": lambda: x is not None and x.startswith(value),
                "IsNull": lambda: x is None,
                "IsNotNull": lambda: x is not None,
            }[kind]()
            if not ok:
                return False
        return True

    def partitions(self) -> list[File]:
        fs, at = filesystem(self.path)
        manifest = f"{at}/_manifest.json"
        if fs.get_file_info(manifest).type != pafs.FileType.NotFound:
            with fs.open_input_stream(manifest) as f:
                found = fs.get_file_info([f"{at}/{x}" for x in json.loads(f.read())])
        else:
            found = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and ".warc" in x.base_name]
        return [File(x.path, x.size) for x in found] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        schema = pa.schema([(c, _ARROW[c]) for c in self.columns])
        inflate = "payload" in self.columns
        rows, held = [], 0
        with fs.open_input_stream(partition.path, compression=None) as stream:
            for headers, start, whole in Members(stream, partition.size):
                row = header_row(headers)
                if not self.passes(row):
                    continue
                block = whole() if inflate and row["record_type"] == "response" else start
                http, sep, payload = block.partition(b"\r\n\r\n")
                length = parse_headers(http).get("content-length") if sep else None
                row["payload_bytes"] = int(length) if length is not None else None
                row["payload"] = payload if inflate and row["record_type"] == "response" else None
                rows.append({c: row[c] for c in self.columns})
                held += 256 + (len(payload) if inflate else 0)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


# --- tables and archives ---------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """A record per row: of equal payloads of at least ``least`` bytes, the smallest id's is the response, and the others revisit it.

    Rows that repeat the smallest id itself are responses too, and so are rows without an id. The ids of shared payloads
    are found by an aggregation, and joined back on digest and a salt, so a payload that a third of all pages share is
    spread over ``SALTS`` parts.
    """
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "target_uri"), F.lit(SALTS)))
    out = rows.join(shared, ["payload_digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    out = out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    return out.select("page_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """``records``: rows as ``plan_records`` gives them."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*_ARROW).write.format("warc").mode(mode).options(path=path, **options).save()


def read_warc(spark, path: str, columns: str | None = None) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(path=path, **({"columns": columns} if columns else {})).load()


def stored_digest(df: DataFrame) -> DataFrame:
    """Adds ``read_digest``: of the payload where it was stored, else the one that the headers name."""
    return df.withColumn("read_digest", F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("payload_digest")))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
