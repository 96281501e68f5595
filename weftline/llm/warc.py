"""Web archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is its
frames and a footer, the seek table of the public seekable format, in a skippable
frame that plain decompressors pass over. An index maps each record identifier
to bundle, frame, offset in the frame and length, so a record is read by
decompressing one frame.

Bundles are rows of a table (name, data), written by Spark's own committer into
any store it knows; export() makes files of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise

#: Bytes of records in a frame and in a bundle, before compression; a longer record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 22
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:x-page:%s>"

_INDEX = "array<struct<record_id:string,frame:int,offset:long,length:long>>"
_INDEX_ARROW = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, unique: str) -> tuple[str, bytes]:
    """Identifier and bytes of a response, or of a revisit if it refers to another page.

    A page without an id is named by `unique`.
    """
    name = _ID % (page if page is not None else f"none:{unique}")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name[1:-1]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_ID % refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size + 4
        yield at, stop - at, head, data[end + 4 : end + 4 + size]
        at = stop


class Bundle:
    """A bundle while it is written."""

    def __init__(self, name: str):
        import zstandard

        self.name, self.compress = name, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[dict] = []
        self.open, self.open_bytes, self.bytes = [], 0, 0
        self.add(_ID % f"bundle:{name}", f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_ID % f'bundle:{name}'}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC 1.1\r\n\r\n\r\n".encode())

    def add(self, name: str, data: bytes) -> bool:
        """True if the bundle is full."""
        if self.open and self.open_bytes + len(data) > FRAME_BYTES:
            self.end_frame()
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        self.bytes += len(data)
        return self.bytes >= BUNDLE_BYTES

    def end_frame(self) -> None:
        self.frames.append((self.compress(b"".join(self.open)), self.open_bytes))
        self.open, self.open_bytes = [], 0

    def row(self) -> pa.RecordBatch:
        if self.open:
            self.end_frame()
        table = b"".join(struct.pack("<II", len(x), n) for x, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        data = b"".join(x for x, _ in self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([data], pa.binary()), pa.array([self.index], _INDEX_ARROW)], names=["bundle", "data", "records"])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for k in range(n):
        size, plain = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - k))
        out.append((at, size, plain))
        at += size
    return out


def frame(data: bytes, number: int) -> bytes:
    """One decompressed frame."""
    import zstandard

    at, size, plain = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=plain)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number, bundle = TaskContext.get().partitionId(), 0, None
    for part, texts in chunks(batches, 2):
        for page, url, text, refers_to in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist(), strict=True):
            bundle = bundle or Bundle(f"{task:06d}-{number:06d}")
            if bundle.add(*record(page, url, text.encode("utf-8", "surrogatepass"), refers_to, f"{bundle.name}:{len(bundle.index)}")):
                yield bundle.row()
                number, bundle = number + 1, None
    if bundle:
        yield bundle.row()


def records_at(data: bytes, places: list[dict]) -> Iterator[tuple[dict, bytes]]:
    """The records at these places of a bundle (frame, offset, length), each frame decompressed once."""
    number, plain = None, b""
    for place in sorted(places, key=lambda x: (x["frame"], x["offset"])):
        if place["frame"] != number:
            number = place["frame"]
            plain = frame(data, number)
        yield place, plain[place["offset"] : place["offset"] + place["length"]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page_of = lambda name: int(name[12:-1]) if re.fullmatch(r"<urn:x-page:-?\d+>", name) else None
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset", "length"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for name, data, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            rows = []
            for place, record in records_at(data.as_py(), places.as_py()):
                ((_, _, head, block),) = parse(record)
                if head["WARC-Record-ID"] != place["record_id"]:
                    raise ValueError(f"the index of bundle {name} has another record for {place['record_id']}")
                if head["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                if head["WARC-Type"] == "response":
                    size, mark = len(payload), digest(payload)
                else:
                    size, mark = int(re.search(rb"Content-Length: (\d+)", http)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                refers_to = page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                rows.append((page_of(head["WARC-Record-ID"]), size, mark, head["WARC-Type"], refers_to, name, place["frame"], place["offset"], place["length"]))
            yield batch_of(rows)


def bundles(pages: DataFrame, least: int = 0) -> DataFrame:
    """bundle, data, records of the archives of pages (page_id, url, html).

    Payloads are the html in UTF-8 (null as empty). Of records with equal payloads
    of `least` bytes or more, that with the smallest page_id is a response and the
    others are revisits of it; rows that repeat this page_id are responses too.
    A page without an id is a revisit unless all its equals lack one. A null url
    is replaced by the record's identifier. An empty table gives no bundles.
    """
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    whole = whole.withColumn("sha", F.sha1(F.col("html")))
    equal = whole.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # written first: a join right above an aggregate can't split a payload that many pages have
    whole = whole.join(materialise(equal.select("sha", "first"), "warc-equal"), "sha", "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return whole.select("page_id", "url", "html", refers_to.alias("refers_to")).mapInArrow(_write, f"bundle string, data binary, records {_INDEX}")


def read(archives: DataFrame) -> DataFrame:
    """Every record of the bundles (bundle, data, records), found by the index: page_id, payload_bytes, payload_digest, record_type, refers_to, and its place."""
    return archives.select("bundle", "data", "records").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long, length long")


def index(archives: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length of every record."""
    return archives.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, places in zip(batch.column(0), batch.column(1), strict=True):
            for place, record in records_at(data.as_py(), places.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array([place["record_id"]]), pa.array([record], pa.binary())], names=["record_id", "record"])


def fetch(archives: DataFrame, ids: DataFrame) -> DataFrame:
    """record_id, record (bytes) for ids (record_id): of a bundle, only frames with such a record are decompressed, each once."""
    wanted = index(archives).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    # no more places than a bundle has records
    wanted = wanted.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("places"))
    return archives.select("bundle", "data").join(wanted, "bundle").select("data", "places").mapInArrow(_fetch, "record_id string, record binary")


def _export(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{path}/{name}.warc.zst") as out:
                    out.write(data)
                names.append(f"{folder}/{name}.warc.zst")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return run


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file into a shared folder (a URI); gives the paths. A task that runs again writes the same files."""
    return archives.select("bundle", "data").mapInArrow(_export(folder), "path string")
