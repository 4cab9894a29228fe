"""WARC archives as a Spark data source.

Reading plans partitions of whole files, takes predicates on record types and
other header fields into the scan, and parses a record's header before
anything else: the payload of a record that no predicate wants, or that nobody
asked for, is passed over. Writing makes one gzip member of each record, which
names its own length (the ``sl`` field of the format), so a reader passes over
it with a seek. Files are read and written through ``pyarrow.fs``, so they may
lie in any store that it knows; local paths have to be shared by all executors.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, likely_in, saved

__all__ = ["WarcDataSource", "base32", "read_warc", "records_of_pages", "write_warc"]

#: The columns of a record. ``payload_length`` and ``payload_digest`` are those of the full payload, also where a revisit leaves it out.
FIELDS = {
    "record_id": "string",
    "record_type": "string",
    "target_uri": "string",
    "date": "string",
    "content_type": "string",
    "content_length": "long",
    "payload_digest": "string",
    "refers_to": "string",
    "headers": "map<string,string>",
    "payload_length": "long",
    "digest_ok": "boolean",
    "payload": "binary",
    "file": "string",
    "offset": "long",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
#: Header fields by column; predicates on these columns are decided before anything else of a record is read.
NAMED = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Columns that need the whole block.
WHOLE = {"payload", "digest_ok"}
#: Bytes after which a task gives its rows on, and after which small files no longer share a partition.
BATCH_BYTES = 4_000_000
SPLIT_BYTES = 32 << 20
#: A writer begins another file after so many bytes, so no file is a large unit of work.
FILE_BYTES = 256 << 20
#: A header block longer than this isn't one.
MOST_HEADER = 1 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- one file -----------------------------------------------------------------------


class _Plain:
    """The records of a file that isn't compressed."""

    def __init__(self, file: io.BufferedReader, at: int):
        self.file, self.at = file, at

    def begin(self) -> bytes:
        self.file.seek(self.at)
        return self.until(b"\r\n\r\n")

    def until(self, mark: bytes) -> bytes:
        found = bytearray()
        while line := self.file.readline():
            found += line
            if found.endswith(mark):
                return bytes(found)
            if len(found) > MOST_HEADER:
                break
        if found.strip():
            raise ValueError(f"no header ends after byte {self.at}")
        return b""

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def end(self, header: int, length: int) -> int:
        """Where the next record begins: a record closes with two line ends."""
        return self.at + header + length + 4


class _Gzip:
    """The records of a file of gzip members, one member a record."""

    def __init__(self, file: io.BufferedReader, at: int):
        self.file, self.at = file, at

    def begin(self) -> bytes:
        self.file.seek(self.at)
        head = self.file.read(24)
        if not head:
            return b""
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {self.at}")
        # an extra field "sl" of eight bytes: lengths of the member and of the record
        self.skip = struct.unpack("<I", head[16:20])[0] if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00" else 0
        self.unzip = zlib.decompressobj(31)
        self.rest, self.read = self.unzip.decompress(head, 4096), len(head)
        return self.until(b"\r\n\r\n")

    def more(self, n: int) -> bool:
        """Inflate some more bytes; false at the member's end."""
        if self.unzip.eof:
            return False
        data = self.unzip.unconsumed_tail
        if not data:
            data = self.file.read(min(max(n, 8192), 1 << 20))
            self.read += len(data)
            if not data:
                raise ValueError(f"the file ends inside the member at byte {self.at}")
        self.rest += self.unzip.decompress(data, max(n, 8192))
        return True

    def until(self, mark: bytes) -> bytes:
        while (found := self.rest.find(mark)) < 0:
            if len(self.rest) > MOST_HEADER or not self.more(8192):
                raise ValueError(f"no header ends after byte {self.at}")
        out, self.rest = self.rest[: found + len(mark)], self.rest[found + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        self.rest = b""
        while have < n and self.more(n - have):
            parts.append(self.rest)
            have += len(self.rest)
            self.rest = b""
        data = b"".join(parts)
        data, self.rest = data[:n], data[n:]
        return data

    def end(self, header: int, length: int) -> int:
        """Where the next member begins, by the member's own word, else by inflating the rest without keeping it."""
        if self.skip:
            return self.at + self.skip
        while not self.unzip.eof:
            self.rest = b""
            self.more(1 << 16)
        return self.at + self.read - len(self.unzip.unused_data)


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before, and of repeated fields the first counts."""
    found: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def _bare(value: str | None) -> str | None:
    """An identifier without its angle brackets."""
    return value[1:-1] if value and value[:1] == "<" and value[-1:] == ">" else value


def _columns_of(fields: dict[str, str]) -> dict[str, Any]:
    """The columns that the header alone gives."""
    row: dict[str, Any] = {c: fields.get(name) for c, name in NAMED.items()}
    row["record_id"], row["refers_to"] = _bare(row["record_id"]), _bare(row["refers_to"])
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    row["content_length"] = int(fields["content-length"])
    row["headers"] = list(fields.items())
    return row


def base32(sha1: bytes) -> str:
    """A SHA-1 digest as archives write it."""
    return base64.b32encode(sha1).decode()


#: How a predicate of the scan is decided on a value that isn't null.
DECIDES = {
    D.EqualTo: lambda a, b: a == b,
    D.GreaterThan: lambda a, b: a > b,
    D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b,
    D.LessThanOrEqual: lambda a, b: a <= b,
    D.In: lambda a, b: a in b,
    D.StringStartsWith: lambda a, b: a.startswith(b),
    D.StringEndsWith: lambda a, b: a.endswith(b),
    D.StringContains: lambda a, b: b in a,
}


def _decided(test: D.Filter) -> bool:
    """Whether the scan can decide a predicate: on one header field, perhaps negated."""
    if isinstance(test, D.Not):
        return _decided(test.child)
    return (type(test) in DECIDES or isinstance(test, D.IsNull | D.IsNotNull)) and test.attribute[0] in {*NAMED, "content_length"} and len(test.attribute) == 1


def _holds(test: D.Filter, row: dict[str, Any]) -> bool | None:
    """What a predicate gives on a header's columns; as in SQL, that is null where the value is, but for predicates on nulls."""
    if isinstance(test, D.Not):
        held = _holds(test.child, row)
        return None if held is None else not held
    value = row[test.attribute[0]]
    if isinstance(test, D.IsNull | D.IsNotNull):
        return (value is None) == isinstance(test, D.IsNull)
    return None if value is None else DECIDES[type(test)](value, test.value)


def _records(file: Any, name: str, tests: list[D.Filter], wanted: set[str]) -> Iterator[dict[str, Any]]:
    """The rows of a file that pass the predicates, with the columns that are wanted."""
    raw = io.BufferedReader(file, 1 << 20)
    tape = (_Gzip if raw.peek(2)[:2] == b"\x1f\x8b" else _Plain)(raw, 0)
    while header := tape.begin():
        if not header.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at byte {tape.at}")
        fields = _fields(header)
        if "content-length" not in fields:
            raise ValueError(f"{name}: the record at byte {tape.at} has no length")
        row = _columns_of(fields) | {"file": name, "offset": tape.at}
        length = row["content_length"]
        if all(_holds(t, row) for t in tests):
            yield row | _block(tape, row, length, wanted)
        tape.at = tape.end(len(header), length)


def _block(tape: _Plain | _Gzip, row: dict[str, Any], length: int, wanted: set[str]) -> dict[str, Any]:
    """Payload, its length, and whether its digest is the header's; HTTP headers are no part of a payload.

    A revisit has no payload; its length is what its HTTP header says, if it says so.
    """
    if not wanted & {*WHOLE, "payload_length"}:
        return {}
    http, said = 0, {}
    if (row["content_type"] or "").lower().startswith("application/http") and length:
        block = tape.until(b"\r\n\r\n")
        http, said = len(block), _fields(block)
    if row["record_type"] == "revisit":
        told = said.get("content-length", "")
        return {"payload": None, "digest_ok": None, "payload_length": int(told) if told.isdigit() else None}
    if not wanted & WHOLE:
        return {"payload_length": length - http}
    payload = tape.take(length - http)
    if len(payload) < length - http:
        raise ValueError(f"{row['file']}: the record at byte {row['offset']} is cut short")
    told = row["payload_digest"]
    ok = base32(hashlib.sha1(payload).digest()) == told if told and "digest_ok" in wanted else None
    return {"payload": payload if "payload" in wanted else None, "digest_ok": ok, "payload_length": len(payload)}


# -- the source ---------------------------------------------------------------------


class WarcDataSource(D.DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``.

    Options: ``path``; ``splitBytes``, up to which files share a partition
    (reading); ``fileBytes``, after which another file begins (writing). The
    columns are ``SCHEMA``; a schema that names some of them is what is read.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)), overwrite)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


@dataclass
class Files(D.InputPartition):
    """Some files of one partition."""

    paths: list[str]


class WarcReader(D.DataSourceReader):
    """Reads archives below a folder, or one archive; names that begin with a dot or an underscore aren't read."""

    def __init__(self, path: str, split_bytes: int, schema: T.StructType):
        self.path, self.split_bytes, self.schema, self.tests = path, split_bytes, schema, []
        if unknown := set(schema.names) - set(FIELDS):
            raise ValueError(f"no columns of an archive: {sorted(unknown)}")

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Predicates on header fields are decided in the scan, all others by Spark."""
        for test in filters:
            if _decided(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        """Files in order of their names; small ones share a partition up to ``split_bytes``, a larger one has its own."""
        fs, path = _store(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        below = len(path.rstrip("/")) + 1
        files = sorted((f.path, f.size) for f in found if f.is_file and (info.is_file or not re.search(r"(^|/)[._]", f.path[below:])))
        dealt: list[Files] = []
        room = 0
        for name, size in files:
            if size > room:
                dealt.append(Files([]))
                room = self.split_bytes
            dealt[-1].paths.append(name)
            room -= size
        return dealt or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        kind, wanted = to_arrow_schema(self.schema), set(self.schema.names)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in _records(file, path, self.tests, wanted):
                    rows.append(row)
                    size += 1000 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield _batch(rows, kind)
                        rows, size = [], 0
        yield _batch(rows, kind)


def _batch(rows: list[dict[str, Any]], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kind], schema=kind)


# -- writing ------------------------------------------------------------------------


def _line(name: str, value: str) -> bytes:
    """A header field; control characters would end it, so they are written as per cent codes."""
    clean = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    return f"{name}: {clean}\r\n".encode("utf-8", "replace")


def _member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that names its length, so that readers needn't inflate it to pass it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 24 + len(body) + 8
    known = size < 1 << 32 and len(record) < 1 << 32
    extra = struct.pack("<HHHII", 12, 0x6C73, 8, size, len(record)) if known else struct.pack("<H", 0)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _info(date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: sessionloom\r\nformat: WARC File Format 1.1\r\n"
    head = [_line("WARC-Type", "warcinfo"), _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), _line("WARC-Date", date), _line("Content-Type", "application/warc-fields"), _line("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *head, b"\r\n", block, b"\r\n\r\n"])


def _record(row: dict[str, Any]) -> bytes:
    """The bytes of a response or revisit. A response's payload is its HTTP body; a revisit has the HTTP header only."""
    payload, kind = row["payload"] or b"", row["record_type"]
    digest = row["payload_digest"] or base32(hashlib.sha1(payload).digest())
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [b"WARC/1.1\r\n", _line("WARC-Type", kind), _line("WARC-Record-ID", f"<{row['record_id']}>"), _line("WARC-Date", row["date"])]
    if row["target_uri"] is not None:
        head.append(_line("WARC-Target-URI", row["target_uri"]))
    head.append(_line("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head.append(_line("WARC-Profile", PROFILE))
        if row["refers_to"] is not None:
            head.append(_line("WARC-Refers-To", f"<{row['refers_to']}>"))
    head += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", str(len(block))), b"\r\n"]
    return b"".join([*head, block, b"\r\n\r\n"])


@dataclass
class Written(D.WriterCommitMessage):
    """The files of one task."""

    names: list[str] = field(default_factory=list)


class WarcWriter(D.DataSourceArrowWriter):
    """Tasks write below ``_temporary``; the driver moves the files of the attempts that count, so a lost or repeated task leaves nothing behind."""

    def __init__(self, path: str, file_bytes: int, overwrite: bool):
        self.path, self.file_bytes, self.overwrite, self.job = path, file_bytes, overwrite, uuid.uuid4().hex

    def _temporary(self) -> tuple[pafs.FileSystem, str, str]:
        fs, path = _store(self.path)
        path = path.rstrip("/")
        return fs, path, f"{path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _, folder = self._temporary()
        fs.create_dir(folder, recursive=True)
        done, out, size = Written(), None, 0
        columns = ["record_id", "record_type", "target_uri", "date", "payload_digest", "payload_length", "refers_to", "payload"]
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in columns}
                    if out is None:
                        done.names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{folder}/{done.names[-1]}", compression=None), 0
                        size += out.write(_member(_info(row["date"])))
                    data = _member(_record(row))
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
                batch = row = data = None
                give_back()
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[D.WriterCommitMessage | None]) -> None:
        fs, path, folder = self._temporary()
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(path)):
                if info.is_file:
                    fs.delete_file(info.path)
        for message in messages:
            for name in message.names if message else []:
                fs.move(f"{folder}/{name}", f"{path}/{name}")
        self._clear(fs, folder)

    def abort(self, messages: list[D.WriterCommitMessage | None]) -> None:
        fs, _, folder = self._temporary()
        self._clear(fs, folder)

    def _clear(self, fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)
        above = folder.rpartition("/")[0]
        if fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


# -- for Spark programs -------------------------------------------------------------


def _registered(spark: SparkSession) -> SparkSession:
    """The session with this source, and with predicates handed to Python sources, which is a setting of its own."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives at ``path``, gzipped by record or plain, with the named columns of ``SCHEMA`` (all if none are named).

    ``where`` on header columns goes into the scan. A payload is decoded only if
    ``payload`` or ``digest_ok`` is among the columns and the record passes.
    Missing header fields are nulls. ``digest_ok`` says whether the payload has
    the digest that its header names (null where there is no payload or no such
    field). An empty folder gives no rows; a file that is no archive, or is cut
    short, is an error that names file and byte. One file is read by one task,
    and one record is held in memory.
    """
    chosen = ", ".join(f"{c} {FIELDS[c]}" for c in columns or FIELDS)
    return _registered(spark).read.format("warc").schema(chosen).option("splitBytes", str(split_bytes)).load(path)


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Append responses and revisits to the archives at ``path``.

    ``records`` has record_id, record_type, target_uri, date, payload_digest
    (base32; null: that of the payload), payload_length (null: the payload's),
    refers_to and payload; other columns aren't written. A null URI is left out,
    and control characters of one become per cent codes. An empty table writes
    no file.
    """
    columns = ["record_id", "record_type", "target_uri", "date", "payload_digest", "payload_length", "refers_to", "payload"]
    _registered(records.sparkSession)
    records.select(*columns).write.format("warc").option("fileBytes", str(file_bytes)).mode("append").save(path)


def base32_of(sha1_hex: Column) -> Column:
    """A SHA-1 digest in lower hex as base32: five hex digits are four of base 32."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records_of_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for every page, ready for ``write_warc``: of equal payloads of ``least_bytes`` or more the one with the largest id is a response, the others revisit it.

    The payload is the html in UTF-8; a null one is empty. Payloads are equal if
    their length, SHA-1 and SHA-256 are. Record ids are ``urn:x-page:<id>``. Null
    ids rank below all others; repeated rows (same id and payload) are alike.
    Other columns aren't read. An empty table gives none.

    Digests are gathered first; groups of copies are counted with partial sums,
    and a revisit needs no payload, so of a group of any size one row's html
    is moved or written. Pages that certainly are responses stay where they lie.
    """
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    marks = [F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha2")]
    known = saved(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), *marks), "payloads")
    groups = known.where(F.col("bytes") >= least_bytes).groupBy("bytes", "sha1", "sha2").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = saved(known.join(saved(groups, "payload-groups"), ["bytes", "sha1", "sha2"]).where(~F.col("id").eqNullSafe(F.col("keep"))), "revisits")
    gone = revisits.select(F.col("id").alias("_gone"), F.col("sha2").alias("_gone_sha2"))
    may = F.col("id").isNull() | likely_in(revisits, "id", F.col("id"))
    whole = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sure, unsure = whole.where(~may), whole.where(may)
    unsure = unsure.join(gone.distinct(), F.col("id").eqNullSafe(F.col("_gone")) & (F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256) == F.col("_gone_sha2")), "left_anti")
    own = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    none = lambda kind: F.lit(None).cast(kind)
    responses = sure.unionAll(unsure).select(urn("id").alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), none("string").alias("payload_digest"), none("long").alias("payload_length"), none("string").alias("refers_to"), own.alias("payload"))
    back = revisits.select(urn("id").alias("record_id"), F.lit("revisit").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), base32_of(F.col("sha1")).alias("payload_digest"), F.col("bytes").alias("payload_length"), urn("keep").alias("refers_to"), none("binary").alias("payload"))
    return responses.unionAll(back)
