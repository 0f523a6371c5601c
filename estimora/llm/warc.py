"""Seekable Zstandard bundles of WARC records.

Each partition of pages becomes one bundle: records are grouped into independent frames, and a
skippable frame at the end holds a table of the frames' sizes, so that a reader can seek to any
frame and decompress it alone. An index maps each record's id to its bundle, frame and offset
within the decompressed frame. A payload that another record holds already is written as a
revisit record, which refers to the page with the smallest id. Records are those of WARC 1.1,
dated when they are written, as pages don't say when they were fetched; a payload stands behind
the head of a plain response.

Defined results: a null payload is an empty one; payloads under 100 bytes are all responses; of
rows with the same id and the same payload each is what that id is, and has a record id of its
own; a null id never is the page that others refer to, and is read back as null; a null or empty
url is written as about:blank; a page of any length is one record; an empty table makes no
bundle. Only page_id, url and html are used.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.llm.arrays import row_chunks
from estimora.llm.shared import bounded, dropped, file_system, new_path, saved

#: Bytes of records that a frame holds before it is closed; a longer record has a frame of its own.
FRAME_BYTES = 1 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Magic numbers of the seekable format, and the profile of revisits (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, name string, frame int, offset long, length long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BundleWriter:
    """Frames of records, and the table of frames at the end."""

    def __init__(self, out):
        self.out, self.frames, self.held, self.size = out, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame that the record will be in, and its offset there."""
        if self.held and self.size + len(record) > FRAME_BYTES:
            self.flush()
        at = self.size
        self.held.append(record)
        self.size += len(record)
        return len(self.frames), at

    def flush(self) -> None:
        frame = self.compressor.compress(b"".join(self.held))
        self.out.write(frame)
        self.frames.append((len(frame), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Seeks by the table at the end; keeps the frame that was read last."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        file.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.places, at = [], 0
        for packed, plain in sizes:
            self.places.append((at, packed, plain))
            at += packed
        self.now, self.data = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self.now:
            at, packed, plain = self.places[k]
            self.file.seek(at)
            self.now, self.data = k, zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)
        return self.data

    def record(self, k: int, offset: int, length: int) -> bytes:
        return self.frame(k)[offset : offset + length]


def record_id(page_id: int | None, digest: str, copy: str = "") -> str:
    """The id of a page's record; `copy` tells rows of one id and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{copy}')}>"


def warc_record(name: str, date: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, origin: str | None) -> bytes:
    """A response with the payload as a page, or a revisit of the page `refers_to` with its headers
    alone; `origin` is the id of that page's record where one record has it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") or "about:blank"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", origin if revisit else None), ("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to), ("Content-Length", len(block)),
    ]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """What a record says; the payload of a response is measured anew."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    response = fields["WARC-Type"] == "response"
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "payload_bytes": len(payload) if response else int(http.rpartition(b"Content-Length: ")[2]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
    }


def copies(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to, alone and many of the rows that aren't the only ones of their page
    and payload, or whose payload another page has: the page that they refer to, whether one record
    has that page, and whether several rows have this page and payload. Rows here are a few bytes,
    and partly aggregated before they move, so that a payload that very many have does no harm."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.sha2(payload, 256).alias("digest"), (F.octet_length(payload) >= LEAST_BYTES).alias("large"))
    each = saved(rows.groupBy("page_id", "digest", "large").agg(F.count("*").alias("n")), "records")
    first = F.min_by(F.struct(F.col("page_id").alias("origin"), (F.col("n") == 1).alias("alone")), "page_id")
    shared = each.filter("large").groupBy("digest").agg(first.alias("f"), F.count("*").alias("pages")).filter("pages > 1").select("digest", "f.*")
    found = each.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("origin")), F.col("origin")))
    found = found.filter("n > 1 OR refers_to IS NOT NULL").select("page_id", "digest", "refers_to", "alone", (F.col("n") > 1).alias("many"))
    out = saved(found, "copies")
    dropped(each)
    return out


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages(page_id, url, html) as bundles to `folder`; the index of all records.

    Pages join what is known of copies by page and digest, which are spread evenly; no page moves
    where the copies are few enough for Spark to send them.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = copies(pages).withColumnsRenamed({"page_id": "p", "digest": "d"})
    keyed = bounded(pages).select("page_id", "url", "html").withColumn("digest", F.sha2(payload, 256))
    dealt = keyed.join(known, keyed["page_id"].eqNullSafe(known["p"]) & (keyed["digest"] == known["d"]), "left")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each attempt of a task has names of its own; the saved index knows those that count
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        name = f"part-{part:06d}-{attempt}.warc.zst"
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        bundle, n = None, 0
        for chunk in row_chunks(batches, "html"):
            bundle = bundle or BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None))
            rows = []
            for r in chunk.to_pylist():
                n += 1
                own = record_id(r["page_id"], r["digest"], f"{attempt}/{n}" if r["many"] else "")
                origin = record_id(r["refers_to"], r["digest"]) if r["refers_to"] is not None and r["alone"] else None
                record = warc_record(own, date, r["page_id"], r["url"] or "", (r["html"] or "").encode(), r["digest"], r["refers_to"], origin)
                rows.append((own, r["page_id"], name, *bundle.add(record), len(record)))
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["record_id", "page_id", "name", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return saved(dealt.select("page_id", "url", "html", "digest", "refers_to", "alone", "many").mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, each read at its place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        name, reader = None, None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["name"] != name:
                    name, reader = r["name"], BundleReader(store.open_input_file(f"{base}/{r['name']}"))
                rows.append(parsed(reader.record(r["frame"], r["offset"], r["length"])))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return index.mapInArrow(read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to bundles in the shared folder and read every record back through the index."""
    folder = new_path(pages.sparkSession, "warc")
    index = write_bundles(pages, folder)
    # the index is small beside what it names: deal it by bundle and frame, not by its own size
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(tasks, "name", "frame").sortWithinPartitions("name", "frame", "offset")
    return read_records(dealt, folder)
