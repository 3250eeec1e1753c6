"""Web archives as seekable Zstandard bundles.

A bundle is one archive file held in a row: groups of WARC records, each group an independent
Zstandard frame, and after them the seek table of the seekable format in a skippable frame. The
table of bundles also maps every record identifier to its frame and the offset in that frame, so
one record is read by decompressing one frame. Bundles are rows of a stored table because Spark's
writers reach any store that the cluster reads, which a task's own file calls do not.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialize

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEAST_REVISIT_BYTES = 100
# Of the seekable format: a skippable frame's number and the footer's number. Fixed values.
SKIPPABLE = 0x184D2A5E
FOOTER = 0x8F92EAB1

BUNDLES = (
    "bundle_id long, archive binary, "
    "records array<struct<record_id:string,frame:int,offset:long,length:long>>"
)
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    digest: str
    refers_to: int | None
    is_revisit: bool


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page_of(name: str) -> int | None:
    tail = name.strip("<>").removeprefix("urn:page:")
    return int(tail) if tail else None


def encode(record: Record, date: str) -> bytes:
    """One record as the archive format writes it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(record.payload)
    block = http if record.is_revisit else http + record.payload
    fields = [
        ("WARC-Type", "revisit" if record.is_revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(record.page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{record.digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if record.url is not None:
        fields.append(("WARC-Target-URI", quote(record.url, safe="!#$&'()*+,/:;=?@[]~%")))
    if record.is_revisit:
        fields.append(("WARC-Refers-To", f"<{record_id(record.refers_to)}>"))
        fields.append(
            (
                "WARC-Profile",
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            )
        )
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def decode(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Header fields and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins at byte {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    begin = end + 4
    stop = begin + int(fields["Content-Length"])
    return fields, data[begin:stop], stop + 4


def read_record(fields: dict, block: bytes) -> dict:
    """The row of a decoded record; a response's digest is computed from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(
        int(line.split(b":")[1])
        for line in head.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    revisit = fields["WARC-Type"] == "revisit"
    named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = named if revisit else hashlib.sha256(payload).hexdigest()
    if not revisit and (digest != named or size != len(payload)):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = 0
        self.raw_bytes = 0
        self.index: list[dict] = []

    def add(self, name: str, record: bytes) -> None:
        self.index.append(
            {
                "record_id": name,
                "frame": len(self.frames),
                "offset": self.open_bytes,
                "length": len(record),
            }
        )
        self.open.append(record)
        self.open_bytes += len(record)
        self.raw_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        table = entries + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def frame_places(archive: bytes) -> list[tuple[int, int, int]]:
    """Begin, compressed and full size of every frame, from the seek table at the end."""
    count, flags, footer = struct.unpack_from("<IBI", archive, len(archive) - 9)
    if footer != FOOTER:
        raise ValueError("the bundle has no seek table")
    wide = 12 if flags & 0x80 else 8
    at, out = len(archive) - 9 - wide * count, []
    begin = 0
    for i in range(count):
        packed, full = struct.unpack_from("<II", archive, at + wide * i)
        out.append((begin, packed, full))
        begin += packed
    return out


def unpack_frame(archive: bytes, place: tuple[int, int, int]) -> bytes:
    begin, packed, full = place
    return zstandard.ZstdDecompressor().decompress(
        archive[begin : begin + packed], max_output_size=full
    )


def with_originals(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Adds payload, digest, refers_to and is_revisit to page_id and url.

    Only payload digests that occur more than once are joined back; the rows of one frequent
    payload are on the many side, whose large partitions Spark's skew handling cuts.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    repeated = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))
    return rows.join(repeated, "digest", "left").withColumn("is_revisit", revisit)


def write_bundles(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the stored bundles.

    Of rows with equal payloads of at least 100 bytes that with the smallest page_id is the
    response, the others revisit it; shorter payloads are responses. A null html is an empty
    payload, a null url writes no target. Rows that repeat the smallest page_id are responses
    too. A row without page_id never is what others refer to. An empty table gives no bundle.
    Other columns are left out. ``date`` is the capture time, which the table does not have.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        writer = BundleWriter()

        def done() -> pa.RecordBatch:
            row = {
                "bundle_id": (part << 32) + made,
                "archive": writer.finish(),
                "records": writer.index,
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, body, digest, first, revisit = (c[row].as_py() for c in batch.columns)
                record = Record(page, url, b"" if revisit and body is None else body, digest, first, revisit)
                writer.add(record_id(page), encode(record, date))
                if writer.raw_bytes >= BUNDLE_BYTES:
                    yield done()
                    writer, made = BundleWriter(), made + 1
        if writer.index:
            yield done()

    schema = pa.schema(
        [
            ("bundle_id", pa.int64()),
            ("archive", pa.binary()),
            (
                "records",
                pa.list_(
                    pa.struct(
                        [
                            ("record_id", pa.string()),
                            ("frame", pa.int32()),
                            ("offset", pa.int64()),
                            ("length", pa.int64()),
                        ]
                    )
                ),
            ),
        ]
    )
    rows = with_originals(pages).select(
        "page_id", "url", "payload", "digest", "refers_to", "is_revisit"
    )
    return materialize(rows.mapInArrow(packed, BUNDLES), "warc-bundles")


def _rows(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        records,
        pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload", pa.binary()),
            ]
        ),
    )


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles, one frame in memory at a time; columns as RECORDS.

    A damaged payload raises. With ``payloads=False`` the payload is checked and then left out.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                archive = cell.as_py()
                for place in frame_places(archive):
                    data, at, records = unpack_frame(archive, place), 0, []
                    while at < len(data):
                        fields, block, at = decode(data, at)
                        records.append(read_record(fields, block))
                        if not payloads:
                            records[-1]["payload"] = None
                    yield _rows(records)

    return bundles.select("archive").mapInArrow(unpacked, RECORDS)


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the pages in ``wanted`` (page_id), by the index: only their frames are read."""
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    places = (
        bundles.select("bundle_id", F.explode("records").alias("r"))
        .select("bundle_id", "r.*")
        .join(wanted.select(name.alias("record_id")).distinct(), "record_id", "left_semi")
        .groupBy("bundle_id", "frame")
        .agg(F.collect_list("offset").alias("offsets"))
    )

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, frame, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack_frame(archive, frame_places(archive)[frame])
                yield _rows([read_record(*decode(data, at)[:2]) for at in offsets])

    return (
        bundles.select("bundle_id", "archive")
        .join(places, "bundle_id")
        .select("archive", "frame", "offsets")
        .mapInArrow(fetched, RECORDS)
    )
