"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP with two stored members: ``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdx``, a line
"offset length record-id" per record. The reader takes the end of the file, follows the ZIP64 directory if there is one, finds the
members by the central directory, reads the index and then ranges of records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasespark.llm.common import materialise, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Hash groups that may be broadcast (some 60 bytes each); more of them are joined by shuffle.
BROADCAST_GROUPS = 200_000


@dataclass(frozen=True)
class Member:
    """A member of a ZIP file, from the central directory."""

    name: str
    method: int
    encrypted: bool
    crc: int
    packed: int
    size: int
    header: int


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """The given 32-bit fields, with those at their maximum taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            more = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(more) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return values


def members(f) -> dict[str, Member]:
    """name -> member of an open random-access file. ValueError if it isn't a whole ZIP file."""
    size = f.size()
    start = max(0, size - 65557 - 20)
    tail = f.read_at(size - start, start)
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7" and (count == 0xFFFF or 0xFFFFFFFF in (length, offset)):
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        end = f.read_at(56, where)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, at, found = f.read_at(length, offset), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method, _, _, crc, packed, real, names, extras, comments = struct.unpack_from("<HHHHIIIHHH", directory, at + 8)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        real, packed, header = _zip64(directory[at + 46 + names : at + 46 + names + extras], [real, packed, header])
        found[name] = Member(name, method, bool(flags & 1), crc, packed, real, header)
        at += 46 + names + extras + comments
    return found


def data_offset(f, member: Member) -> int:
    """Where a stored member's bytes begin. ValueError for a compressed or encrypted one: its records have no ranges."""
    if member.method or member.encrypted:
        raise ValueError(f"{member.name} is not stored")
    local = f.read_at(30, member.header)
    if local[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record. A revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The columns of RECORD from one record. A response's length and digest are those of its own bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(v) if (v := fields.get(k, "<urn:page:>")[10:-1]) else None
    url = fields.get("WARC-Target-URI")
    out = {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}
    out["url"] = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if fields["WARC-Type"] == "revisit":
        length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        return out | {"payload_digest": fields["WARC-Payload-Digest"][5:], "payload_bytes": length, "payload": None}
    return out | {"payload_digest": digest(payload), "payload_bytes": len(payload), "payload": payload}


class ArchiveWriter:
    """Collects records to at most ``roll_bytes`` and writes them as archives ``<stem>-<k>.zip``, each under its last name only when whole."""

    def __init__(self, folder: str, stem: str, roll_bytes: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder)
        self.stem, self.roll_bytes, self.k = stem, roll_bytes, 0
        self.data, self.index, self.at = [], [], 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.data.append(packed)
        self.index.append(f"{self.at} {len(packed)} urn:page:{'' if page_id is None else page_id}\n")
        self.at += len(packed)

    def full(self) -> bool:
        return self.at >= self.roll_bytes

    def roll(self) -> tuple[str, int, int]:
        """(path, records, bytes) of the archive just written."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((DATA, b"".join(self.data)), (INDEX, "".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                    f.write(content)
        path = f"{self.folder}/{self.stem}-{self.k:04d}.zip"
        own = f"{path}.{uuid.uuid4().hex}"  # a second attempt at the task writes beside the first
        with self.store.open_output_stream(own) as f:
            f.write(out.getbuffer())
        self.store.move(own, path)
        done = (path, len(self.index), len(out.getbuffer()))
        self.data, self.index, self.at, self.k = [], [], 0, self.k + 1
        return done


def read_archive(f, chunk_bytes: int = 4 << 20) -> Iterator[dict]:
    """The records of an open archive: neighbouring ones by one range read of about ``chunk_bytes``."""
    found = members(f)
    base, index = data_offset(f, found[DATA]), found[INDEX]
    lines = f.read_at(index.size, data_offset(f, index)).decode().splitlines()
    ranges = [(int(a), int(n)) for a, n, _ in (x.split(" ") for x in lines)]
    k = 0
    while k < len(ranges):
        first, end, stop = ranges[k][0], sum(ranges[k]), k + 1
        while stop < len(ranges) and ranges[stop][0] == end and end + ranges[stop][1] - first <= chunk_bytes:
            end += ranges[stop][1]
            stop += 1
        chunk = f.read_at(end - first, base + first)
        for at, n in ranges[k:stop]:
            yield parse(zlib.decompress(chunk[at - first : at - first + n], 31))
        k = stop


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first_id, revisit): of equal payloads of at least ``min_bytes`` bytes, the smallest page_id is the response.

    Null html is an empty payload. Rows with that same smallest id are responses too; a null page_id comes after all others. Where all
    ids of a group are null, all its rows are responses.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = materialise(groups.filter("n > 1").drop("n"), "groups")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    out = rows.join(F.broadcast(groups) if small else groups, "sha1", "left").drop("sha1")
    later = F.col("first_id").isNotNull() & (F.octet_length("payload") >= min_bytes) & F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(True))
    return out.withColumn("revisit", later)


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write planned records below ``folder`` (a URI that executors can write) and return the manifest (path, records, bytes).

    Writing happens once, here; the manifest is a table in the shared folder. Task retries write the same archives again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, done = ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():05d}", roll_bytes), []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "first_id", "revisit")]
            for i in range(len(batch)):
                page_id, url, payload, first_id, revisit = (c[i].as_py() for c in columns)
                out.add(page_id, record(page_id, url, payload, first_id, revisit))
                if out.full():
                    done.append(out.roll())
        if out.index:
            done.append(out.roll())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return materialise(records.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True, batch_records: int = 500) -> DataFrame:
    """All records of the archives in a manifest, one task range per archive. Columns: RECORD; payload is null where not asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_file(path) as f:
                    for r in read_archive(f):
                        rows.append(r if with_payload else r | {"payload": None})
                        if len(rows) == batch_records:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    spread = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back: one row per record.

    Extra columns are ignored; an empty table gives no archive and no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/archives"
    return read_archives(write_archives(plan_records(pages, min_bytes), folder), folder, with_payload)
