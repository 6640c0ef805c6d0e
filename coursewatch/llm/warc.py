"""WARC files as a PySpark data source, reader and writer.

The driver lists the files and plans one partition for each (small ones
together). The reader takes equality and IN predicates on record type and on
headers down to the records: a record's headers are parsed first, and the
payload of a record that fails, or that wasn't asked for, is passed over
without being decoded: by a seek in plain files, in gzip files (a member for
each record) by the member's length, which the writer leaves in an extra field
of its head. Paths go through pyarrow's filesystems, so any store that it
knows will do.

Options: path; compression (gzip or none, for writing); payload (true or
false, for reading); record_type (comma-separated).
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
"""payload_bytes is the length of the full payload also where the record doesn't hold it."""
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and the path in it, of a URI or a local path."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Header values hold no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row) -> bytes:
    """A response with its payload in an HTTP message, or a revisit with the message's head only."""
    payload = bytes(row.payload or b"")
    n = row.payload_bytes if row.payload_bytes is not None else len(payload)
    sha1 = row.payload_digest or digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    body = head + (payload if row.record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{_clean(row.record_id)}>", f"WARC-Date: {row.record_date or DATE}", f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if row.target_uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(row.target_uri)}")
    if row.record_type == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_clean(row.refers_to or '')}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member that says in an extra field LX how long it is, packed and unpacked."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    if size >> 32:  # longer than the field can say: a member without it, found by inflating
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"LX" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Records:
    """Records of one file: next() gives the headers; body() the block of the last one, which is passed over otherwise."""

    def __init__(self, file, packed: bool):
        self.file, self.packed, self.end, self.buffer = file, packed, 0, b""

    def headers(self) -> dict[str, str] | None:
        self.file.seek(self.end)
        return self._packed_headers() if self.packed else self._plain_headers()

    def _parse(self, head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def _plain_headers(self) -> dict[str, str] | None:
        data = b""
        while (cut := data.find(b"\r\n\r\n")) < 0:
            more = self.file.read(1024)
            if not more:
                if data.strip():
                    raise ValueError("the file ends within a record's headers")
                return None
            data += more
        found = self._parse(data[:cut])
        self.start, self.length = self.end + cut + 4, int(found["content-length"])
        self.end = self.start + self.length + 4
        return found

    def _packed_headers(self) -> dict[str, str] | None:
        self.at, self.inflate, data, skip = self.end, zlib.decompressobj(31), b"", 0
        first = self.file.read(1024)
        if not first:
            return None
        if first[:2] != b"\x1f\x8b" or len(first) < 18:
            raise ValueError("no gzip member")
        if first[3] & 4 and first[12:14] == b"LX":
            skip = struct.unpack("<I", first[16:20])[0]
        self.tail, self.skip = first, skip
        while (cut := data.find(b"\r\n\r\n")) < 0:
            if not self.tail:
                raise ValueError("the file ends within a record's headers")
            data += self.inflate.decompress(self.tail, 4096)
            self.tail = self.inflate.unconsumed_tail or (b"" if self.inflate.eof else self.file.read(1024))
            if self.inflate.eof and data.find(b"\r\n\r\n") < 0:
                raise ValueError("a gzip member ends within a record's headers")
        found = self._parse(data[:cut])
        self.data, self.length, self.read = data[cut + 4 :], int(found["content-length"]), self.at + 1024
        if skip:
            self.end = self.at + skip
        else:  # another's file: the member's end is where inflating it ends
            self.data = self._inflate_rest()
            self.end = self.file.tell() - len(self.inflate.unused_data)
        return found

    def _inflate_rest(self) -> bytes:
        parts = [self.data]
        while not self.inflate.eof:
            part = self.tail or self.file.read(1 << 16)
            if not part:
                raise ValueError("the file ends within a gzip member")
            parts.append(self.inflate.decompress(part))
            self.tail = self.inflate.unconsumed_tail
        return b"".join(parts)

    def http_head(self) -> bytes:
        """The block's HTTP head with its empty line; what follows isn't read or inflated. Empty if the block has none."""
        data = self.data if self.packed else b""
        if not self.packed:
            self.file.seek(self.start)
        while (cut := data.find(b"\r\n\r\n")) < 0 and len(data) < self.length:
            if not self.packed:
                more = self.file.read(min(1024, self.length - len(data)))
            elif self.skip and not self.inflate.eof:
                part = self.tail or self.file.read(1024)
                more = self.inflate.decompress(part, 4096)
                self.tail = self.inflate.unconsumed_tail
                if not more and part:
                    continue
            else:
                more = b""
            if not more:
                break
            data += more
        cut = data.find(b"\r\n\r\n", 0, self.length)
        return data[: cut + 4] if cut >= 0 else b""

    def body(self) -> bytes:
        if self.packed:
            return (self._inflate_rest() if self.skip else self.data)[: self.length]
        self.file.seek(self.start)
        return self.file.read(self.length)


def _archives(store: fs.FileSystem, where: str) -> list[fs.FileInfo]:
    return [i for i in store.get_file_info(fs.FileSelector(where, recursive=True)) if i.is_file and i.path.endswith((".warc", ".warc.gz")) and "/_temporary" not in i.path]


@dataclass
class Files(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.wanted = options["path"], {}
        self.payload = options.get("payload", "true").lower() != "false"
        if kinds := options.get("record_type"):
            self.wanted["record_type"] = {k.strip() for k in kinds.split(",")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in HEADERS and all(isinstance(v, str) for v in values):
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        store, where = open_fs(self.path)
        found = _archives(store, where)
        plan, held, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            if held and size + i.size > PARTITION_BYTES:
                plan.append(Files(held))
                held, size = [], 0
            held.append(i.path)
            size += i.size
        return [*plan, Files(held)]

    def read(self, partition: Files):
        store, _ = open_fs(self.path)
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
        rows, held = [], 0
        for path in partition.files:
            with store.open_input_file(path) as f:
                records = Records(f, path.endswith(".gz"))
                while (found := records.headers()) is not None:
                    row = {k: _value(k, found.get(h.lower())) for k, h in HEADERS.items()}
                    if any(row[k] not in v for k, v in self.wanted.items()):
                        continue
                    rows.append(row | self._content(row, found, records))
                    held += len(rows[-1]["payload"] or b"") + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _content(self, row: dict, found: dict[str, str], records: Records) -> dict:
        """Length and, if asked for, bytes of the payload; an HTTP message's head is cut off."""
        http, revisit = found.get("content-type", "").startswith("application/http"), row["record_type"] == "revisit"
        if not http:
            return {"payload_bytes": records.length, "payload": records.body() if self.payload else None}
        if revisit or not self.payload:
            head = records.http_head()
            sizes = [int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()]
            return {"payload_bytes": (sizes[0] if sizes else None) if revisit else records.length - len(head), "payload": None}
        payload = records.body().partition(b"\r\n\r\n")[2]
        if row["payload_digest"] and row["payload_digest"] != digest(payload):
            raise ValueError(f"payload of {row['record_id']} doesn't match its digest")
        return {"payload_bytes": len(payload), "payload": payload}


def _value(name: str, raw: str | None) -> str | None:
    if raw is None:
        return None
    return raw.removeprefix("<").removesuffix(">") if name in ("record_id", "refers_to") else raw.removeprefix("sha1:") if name == "payload_digest" else raw


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Tasks write under _temporary; only files of tasks that Spark commits are moved into place, so a retried task leaves no double.

    What is overwritten goes when all that replaces it is written.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.packed, self.job, self.overwrite = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip", uuid.uuid4().hex, overwrite

    def write(self, rows):
        store, where = open_fs(self.path)
        store.create_dir(f"{where}/_temporary/{self.job}", recursive=True)
        files, out = [], None
        for row in rows:
            if out is None or out.tell() >= FILE_BYTES:
                if out is not None:
                    out.close()
                files.append(f"{where}/_temporary/{self.job}/{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                out = store.open_output_stream(files[-1], compression=None)
            data = record(row)
            out.write(member(data) if self.packed else data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, where = open_fs(self.path)
        store.create_dir(where, recursive=True)
        old = _archives(store, where) if self.overwrite else []
        for f in old:
            store.delete_file(f.path)
        for m in messages:
            for f in m.files if m else []:
                store.move(f, f"{where}/part-{posixpath.basename(f)}")
        self._clear(store, where)

    def abort(self, messages):
        self._clear(*open_fs(self.path))

    def _clear(self, store, where):
        """Only this writer's own folder: others may be writing beside it."""
        own = f"{where}/_temporary/{self.job}"
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_dir(own)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(sha1):
    """Bare upper-case base32 of a SHA-1 in hexadecimal digits, in built-in functions: 20 bits at a time."""
    from pyspark.sql import functions as F

    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    part = lambda k: F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substring(alphabet, (F.shiftright(part(k), s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8) for s in (15, 10, 5, 0)])


def archive(pages, path: str, compression: str = "gzip") -> None:
    """Write a record for each row of (page_id, url, html).

    Of rows with equal payloads the one with the smallest page_id becomes a
    response, as do rows with that same page_id; the others become revisits of
    it. A null html is an empty payload, a null url is left out, a row with a
    null page_id is a response. Other columns aren't read.
    """
    from pyspark.sql import functions as F

    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # the digest is a column of its own before anything is made of it: in an expression it would be computed again for each use
    digests = pages.select("page_id", F.sha1(payload).alias("sha1"))
    firsts = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")
    again = digests.join(firsts, "sha1").filter("first < page_id").distinct()
    # joined by page and digest: a payload that very many pages have is dealt over as many tasks as its pages are
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    joined = rows.filter("page_id is not null").join(again, ["page_id", "sha1"], "left")
    joined = joined.unionByName(rows.filter("page_id is null").withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    uri = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    revisit = F.col("first").isNotNull()
    out = joined.select(
        uri(F.col("page_id")).alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri",
        F.lit(DATE).alias("record_date"),
        F.when(revisit, uri(F.col("first"))).alias("refers_to"),
        base32_sha1(F.col("sha1")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("compression", compression).save(path)


def round_trip(pages, path: str):
    """Archive the pages at ``path`` and read back what the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Both readings push their record type down: responses are read with their
    payloads, which must match their digests, revisits by their heads alone.
    """
    from pyspark.sql import functions as F

    archive(pages, path)
    read = pages.sparkSession.read.format("warc")
    responses = read.load(path).filter("record_type = 'response'").drop("payload")
    revisits = pages.sparkSession.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'").drop("payload")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    id_ = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return responses.unionByName(revisits).select(id_("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_("refers_to").alias("refers_to"))
