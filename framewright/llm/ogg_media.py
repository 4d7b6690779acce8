"""Media columns in Ogg: pages, packets, logical streams and timestamps.

Reading. Pages are found at the capture pattern, their checksum is verified
(polynomial 0x04C11DB7, no reflection, zero start), packets are put together
from the lacing values (a packet ends at the first value under 255 and may go on
over pages), logical streams are separated by serial number, and every packet
gets a timestamp from the granule position of the page it ends on: granules
count samples, ``rate`` of them a second, and packets before the last of a page
step back by their own length.

Writing. ``write_ogg`` multiplexes any number of logical streams, page by page.
A document is stored as 8-bit samples in one stream (a header packet, then
packets of ``PACKET`` samples) beside a second stream that holds what the
samples cannot say: the length before padding.

The checksum is that of zlib with all bits mirrored, so both byte translation
and division run in C.

:func:`media_column` reads every stored file back, byte for byte as made, in the
task that made it; the files themselves leave it only ``with_media``.

Defined results: null text is empty and padded to one unit of 64 zero bytes; a
damaged page, a missing page or a packet without an end raises ``OggError``.
Equal texts give equal files (serials and granules depend on the text alone), so
rows that repeat give equal rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 64
PACKET = 16384
RATE = 8000
SAMPLES, NOTES = 1, 2  # serials of the two streams of a document
HEAD = struct.Struct("<4sBBqIIIB")
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """A file that is not a whole, undamaged Ogg bitstream."""


def page_checksum(page: bytes) -> int:
    """The Ogg CRC of a page whose checksum field is zero."""
    raw = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(MIRROR), "big")


# --- writing ---------------------------------------------------------------


@dataclass
class Track:
    """Packets of a logical stream, each with the granule position at its end."""

    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]


def _pages(track: Track) -> Iterator[bytes]:
    """The stream's first packet has a page of its own; the others fill pages of 255 lacing values."""
    number, lacing, body, granule, flags = 0, bytearray(), [], -1, FIRST

    def flush(last: bool) -> bytes:
        nonlocal number, lacing, body, granule
        page = _page(flags | LAST * last, granule, track.serial, number, bytes(lacing), b"".join(body))
        number, lacing, body, granule = number + 1, bytearray(), [], -1
        return page

    for at, (packet, end) in enumerate(track.packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(values):
            if len(lacing) == 255:
                page = flush(False)
                yield page
                flags = CONTINUED if done else 0
            part = values[done : done + 255 - len(lacing)]
            lacing += part
            body.append(packet[255 * done : 255 * done + sum(part)])
            done += len(part)
        granule = end
        if at == 0 or at == len(track.packets) - 1:
            page = flush(at == len(track.packets) - 1)
            yield page
            flags = 0


def write_ogg(tracks: list[Track]) -> bytes:
    """All first pages, then the other pages of the streams in turn."""
    sources = [_pages(t) for t in tracks]
    out = [next(s) for s in sources]
    while sources:
        still = []
        for source in sources:
            page = next(source, None)
            if page is not None:
                out.append(page)
                still.append(source)
        sources = still
    return b"".join(out)


# --- reading ---------------------------------------------------------------


@dataclass
class Packet:
    data: bytes
    granule: int | None  # of its end, if the page says so
    page: int


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of every page, checksum verified."""
    at = 0
    while at < len(data):
        if len(data) < at + HEAD.size:
            raise OggError(f"page head cut off at {at}")
        magic, version, flags, granule, serial, number, checksum, segments = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        body_at = at + HEAD.size + segments
        lacing = data[at + HEAD.size : body_at]
        end = body_at + sum(lacing)
        if end > len(data):
            raise OggError(f"page cut off at {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != checksum:
            raise OggError(f"checksum mismatch at {at}")
        yield flags, granule, serial, number, lacing, data[body_at:end]
        at = end


def read_ogg(data: bytes) -> dict[int, list[Packet]]:
    """Packets by logical stream, in order."""
    streams: dict[int, list[Packet]] = {}
    open_: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, number, lacing, body in read_pages(data):
        if (serial not in streams) != bool(flags & FIRST):
            raise OggError(f"stream {serial} begins wrongly")
        if serial in ended or number != expected.get(serial, 0):
            raise OggError(f"stream {serial}: page {number} is out of order")
        expected[serial] = number + 1
        packets, part = streams.setdefault(serial, []), open_.pop(serial, [])
        if bool(part) != bool(flags & CONTINUED):
            raise OggError(f"stream {serial}: page {number} does not continue as the one before")
        at = size = 0
        for value in lacing:
            size += value
            if value < 255:
                packets.append(Packet(b"".join([*part, body[at : at + size]]), None, number))
                part, at, size = [], at + size, 0
        if lacing and lacing[-1] == 255:
            open_[serial] = [*part, body[at:]]
        if granule >= 0 and packets and packets[-1].page == number:
            packets[-1].granule = granule
        if flags & LAST:
            ended.add(serial)
    if open_:
        raise OggError("a packet has no end")
    if set(streams) != ended:
        raise OggError("a stream has no last page")
    return streams


def timestamps(packets: list[Packet], rate: int, samples=len) -> list[float]:
    """The second at which each packet ends; ``samples`` counts those of a packet."""
    ends: list[float] = [0.0] * len(packets)
    known: int | None = None
    for at in range(len(packets) - 1, -1, -1):
        if packets[at].granule is not None:
            known = packets[at].granule
        if known is None:
            raise OggError("no granule position after a packet")
        ends[at] = known / rate
        known -= samples(packets[at].data)
    return ends


# --- documents as media ----------------------------------------------------


def store_text(text: str | None) -> tuple[int, bytes]:
    """(length in bytes, Ogg file) of a text as 8-bit samples."""
    raw = (text or "").encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    payload = raw.ljust(size, b"\0")
    packets = [(struct.pack("<8sII", b"PCM8    ", RATE, 1), 0)]
    packets += [(payload[at : at + PACKET], min(at + PACKET, size)) for at in range(0, size, PACKET)]
    notes = [(b"notes   ", 0), (struct.pack("<Q", len(raw)), size)]
    return len(raw), write_ogg([Track(SAMPLES, packets), Track(NOTES, notes)])


def load_samples(media: bytes) -> tuple[int, bytes, list[float]]:
    """(length before padding, samples, packet end times) of a stored text."""
    streams = read_ogg(media)
    head, *packets = streams[SAMPLES]
    magic, rate, _ = struct.unpack("<8sII", head.data)
    if magic != b"PCM8    ":
        raise OggError("no sample stream")
    ends = timestamps(packets, rate)
    (n_bytes,) = struct.unpack("<Q", streams[NOTES][1].data)
    payload = b"".join(p.data for p in packets)
    if round(ends[-1] * rate) != len(payload):
        raise OggError("the last granule position is not the number of samples")
    return n_bytes, payload, ends


def feature_of(payload: bytes, ends: list[float]) -> str:
    """Packets, seconds, mean, root mean square about 128 and sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    energy = int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={len(ends)};seconds={ends[-1]:.4f};mean={x.mean():.4f};rms={(energy / len(x)) ** 0.5:.4f};crossings={crossings}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stored, read back and described texts; ``with_media`` also returns the files."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("n_bytes", "payload_bytes")]
    fields += [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    if with_media:
        fields.append(T.StructField("media", T.BinaryType()))
    arrow = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for text in part.column(1):
                    _, media = store_text(text.as_py())
                    n_bytes, payload, ends = load_samples(media)
                    row = [n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, ends)]
                    rows.append([*row, media] if with_media else row)
                columns = [pa.array(c, arrow[type(f.dataType)]) for c, f in zip(zip(*rows), fields[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))


def op6_ogg_media(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
