"""Web archives in ZIP packages: written in parallel, and read back by range without extraction.

A package is a ZIP file of stored members: an archive of gzipped WARC records, and an index with the place of each
record. Readers parse the package's central directory (ZIP64 too), locate the archive and the index within the package,
and read single records by their range. Packages lie in the shared folder; any file system that pyarrow opens will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, flag_contained, save, shared_path

LEAST_BYTES = 1000
PACKAGE_BYTES = 64 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: A package is read in ranges of READ_BYTES; a task reads TASK_BYTES on average where there is that much.
READ_BYTES, TASK_BYTES = 4 << 20, 128 << 20
#: Packages whose index a task reads, where there are that many.
TASK_PACKAGES = 16
FILTER_BITS = 1 << 24


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# Records


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP head, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    target = " ".join((url or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, Any]:
    """page_id, record_type, refers_to, payload_digest (hex) and, for responses, the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    number = lambda v: int(n) if v and (n := v.strip("<>").rpartition(":")[2]) else None
    kind, named = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    out = {"page_id": number(fields["warc-record-id"]), "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "payload": None}
    out["payload_digest"] = base64.b32decode(named).hex()
    if kind == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(out["payload"]).hexdigest() != out["payload_digest"]:
            raise ValueError(f"record {out['page_id']}: the payload does not have its digest")
    return out


# Packages


class PackageWriter:
    """One package at a time: the archive member is streamed, the index follows."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, record: bytes) -> None:
        packed = zlib.compress(record, 1, 31)
        self.member.write(packed)
        self.lines.append({"offset": self.at, "length": len(packed)})
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(json.dumps(x) + "\n" for x in self.lines))
        self.zip.close()
        self.out.close()


def read_directory(file: pa.NativeFile, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name -> (place of its local header, stored bytes, method) from the central directory, ZIP64 or not."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        file.seek(struct.unpack("<Q", tail[locator + 8 : locator + 16])[0])
        end64 = file.read(56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack("<QQQ", end64[32:56])
    file.seek(start)
    directory, at, out = file.read(length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("no central directory entry")
        method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
        packed, whole, name_n, extra_n, note_n = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        header = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out[name] = header, packed, method
        at += 46 + name_n + extra_n + note_n
    return out


def member_start(file: pa.NativeFile, header: int) -> int:
    """Where a member's data starts, behind its local header."""
    file.seek(header)
    local = file.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name_n, extra_n = struct.unpack("<HH", local[26:30])
    return header + 30 + name_n + extra_n


def locate(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of each record of a package."""
    store, name = open_store(path)
    with store.open_input_file(name) as file:
        members = read_directory(file, file.size())
        for wanted in (ARCHIVE, INDEX):
            if wanted not in members or members[wanted][2] != zipfile.ZIP_STORED:
                raise ValueError(f"{path} has no stored member {wanted}")
        base = member_start(file, members[ARCHIVE][0])
        file.seek(member_start(file, members[INDEX][0]))
        for line in io.BytesIO(file.read(members[INDEX][1])):
            x = json.loads(line)
            yield base + x["offset"], x["length"]


# Jobs


def with_references(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload and `keep`: of equal payloads of `least` bytes or more, the largest page_id.

    Payloads that occur once never leave their partition: a bitmap of fixed size tells those that may occur again.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= least).select("page_id", key.alias("key"))
    again = save(large.groupBy("key").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    marked = rows.withColumn("key", F.when(F.octet_length("payload") >= least, key))
    marked = flag_contained(marked, F.col("key"), bit_filter(again, "key", FILTER_BITS), "again", FILTER_BITS)
    once = marked.filter("not again").withColumn("keep", F.lit(None).cast("long"))
    often = marked.filter("again").join(again, "key", "left")
    return once.select("page_id", "url", "payload", "keep").unionByName(often.select("page_id", "url", "payload", "keep"))


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each page; one row (path, records, bytes) for each package of the tasks that succeeded."""
    folder = shared_path(pages.sparkSession, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        writer, name, done = None, "", []
        for batch in batches:
            for page, url, payload, keep in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "keep"))):
                if writer is None:
                    # A name of its own for each attempt: the manifest lists those of the attempt that counts.
                    name = f"{uuid.uuid4().hex}.zip"
                    writer = PackageWriter(store, f"{base}/{name}")
                page, keep = page.as_py(), keep.as_py()
                writer.add(format_record(page, url.as_py(), payload.as_py(), keep, keep is not None and keep != page))
                if writer.at >= package_bytes:
                    writer.close()
                    done.append((f"{folder}/{name}", len(writer.lines), writer.at))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((f"{folder}/{name}", len(writer.lines), writer.at))
        yield pa.record_batch({"path": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64()), "bytes": pa.array([x[2] for x in done], pa.int64())})

    return save(pages.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest and payload (null for revisits) of all records of packages."""

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                at, length = zip(*locate(path)) if batch.num_rows else ((), ())
                yield pa.record_batch({"path": pa.array([path] * len(at), pa.string()), "at": pa.array(at, pa.int64()), "length": pa.array(length, pa.int64())})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch, found = whole.slice(i, 200), []
                for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length"))):
                    if path != open_path:
                        store, name = open_store(path)
                        open_path, file = path, store.open_input_file(name)
                    file.seek(at)
                    found.append(parse_record(zlib.decompress(file.read(length), 31)))
                columns = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
                yield pa.record_batch({k: pa.array([x[k] for x in found], t) for k, t in columns.items()})

    # Rows with places are small and what lies there is large: the numbers of tasks follow from the bytes to be read.
    sums = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    slots = manifest.sparkSession.sparkContext.defaultParallelism
    finders = max(1, min(slots, sums["n"]), -(-sums["n"] // TASK_PACKAGES))
    readers = max(1, min(slots, -(-sums["bytes"] // READ_BYTES)), -(-sums["bytes"] // TASK_BYTES))
    places = manifest.select("path").repartition(finders, "path").mapInArrow(directories, "path string, at long, length long")
    # Ranges of a package are dealt out, so that a large package is read by many tasks.
    dealt = places.repartition(readers, "path", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(records, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def archive(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write the pages to packages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of records with equal payloads of `least` bytes or more the one with the largest
    page_id is the response, and the others revisit it; rows that repeat its page_id are responses too, and so are all
    where no row has a page_id. A revisit's bytes come from the record that it refers to. A null page_id is kept as
    null. Rows alike in page_id and html are a record each, of the same type; pages of one page_id and other payloads are
    told apart by their digests. A very long page is one record, read whole. Other columns but url are ignored. An empty
    table gives an empty result.
    """
    read = read_packages(write_packages(with_references(pages, least)))
    records = save(read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"), "records")
    responses = records.filter(F.col("record_type") == "response")
    named = save(records.filter(F.col("record_type") == "revisit").select("refers_to", "payload_digest").distinct(), "named")
    of = responses.join(named.select(F.col("refers_to").alias("page_id"), "payload_digest"), ["page_id", "payload_digest"], "left_semi").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    of = save(of.withColumnRenamed("page_id", "refers_to"), "referred")
    revisits = records.filter(F.col("record_type") == "revisit").drop("payload_bytes").join(of, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits.select(*responses.columns))
