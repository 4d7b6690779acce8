"""Capture files: pcap in both byte orders and time units, and pcapng.

Files are read as rows of the ``binaryFile`` source, so any store that Spark
reads will do; a task takes whole files and emits packets batch by batch.
Everything beyond the frame header is left to column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File magics and the link types that carry 802.11 frames.
PCAP_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 6), b"\xd4\xc3\xb2\xa1": ("<", 6), b"\xa1\xb2\x3c\x4d": (">", 9), b"\x4d\x3c\xb2\xa1": ("<", 9)}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
RADIOTAP, PLAIN = 127, 105
CUT = -1  # in place of a link type: the record is cut off
#: Alignment and size of the radiotap fields up to the channel.
RADIOTAP_FIELDS = ((8, 8), (1, 1), (1, 1), (2, 4))

IES = "array<struct<ord:int,id:int,len:int,info:binary>>"
PACKETS = f"path string, packet long, ts double, ts_text string, mac string, freq int, length int, radiotap_len int, fc_type int, fc_subtype int, seq_ctrl int, fcs binary, ies {IES}, bad string"
NAMES = [part.split()[0] for part in PACKETS.replace(IES, "ies").split(", ")]


def file_type(content: Column) -> Column:
    """``pcap``, ``pcapng`` or null, by the first four bytes."""
    magic = F.hex(F.substring(content, 1, 4))
    return F.when(magic.isin(*(m.hex().upper() for m in PCAP_MAGIC)), "pcap").when(magic == PCAPNG_MAGIC.hex().upper(), "pcapng")


def records(data: bytes) -> Iterator[tuple[int, Decimal, bytes]]:
    """(link type, seconds, frame) of every record.

    A record that is cut off ends the file: it comes as link type ``CUT`` with what there is of it.
    """
    if data[:4] in PCAP_MAGIC:
        order, digits = PCAP_MAGIC[data[:4]]
        (link,) = struct.unpack_from(order + "I", data, 20)
        at = 24
        while at + 16 <= len(data):
            seconds, part, size, _ = struct.unpack_from(order + "IIII", data, at)
            if at + 16 + size > len(data):
                yield CUT, Decimal(seconds) + Decimal(part).scaleb(-digits), data[at + 16 :]
                return
            yield link & 0xFFFF, Decimal(seconds) + Decimal(part).scaleb(-digits), data[at + 16 : at + 16 + size]
            at += 16 + size
    elif data[:4] == PCAPNG_MAGIC:
        yield from _pcapng(data)


def _pcapng(data: bytes) -> Iterator[tuple[int, Decimal, bytes]]:
    at, order, interfaces = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == PCAPNG_MAGIC:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            yield CUT, Decimal(0), data[at:]
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            (link,) = struct.unpack_from(order + "H", body)
            interfaces.append((link, _resolution(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            number, high, low, caught, _ = struct.unpack_from(order + "IIIII", body)
            link, unit = interfaces[number] if number < len(interfaces) else (0, Decimal("0.000001"))
            yield link, Decimal((high << 32) | low) * unit, body[20 : 20 + caught]
        elif kind == 3 and len(body) >= 4:  # simple packet: first interface, no time
            (original,) = struct.unpack_from(order + "I", body)
            yield interfaces[0][0] if interfaces else 0, Decimal(0), body[4 : 4 + original]
        elif kind == 2 and len(body) >= 20:  # obsolete packet block
            number, _, high, low, caught, _ = struct.unpack_from(order + "HHIIII", body)
            link, unit = interfaces[number] if number < len(interfaces) else (0, Decimal("0.000001"))
            yield link, Decimal((high << 32) | low) * unit, body[20 : 20 + caught]
        at += size


def _resolution(options: bytes, order: str) -> Decimal:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return Decimal(1) / (Decimal(2) ** (value & 0x7F)) if value & 0x80 else Decimal(1).scaleb(-value)
        if code == 0:
            break
        at += 4 + size + (-size % 4)
    return Decimal("0.000001")


def radiotap_channel(frame: bytes) -> int | None:
    """The channel frequency of a radiotap header."""
    present, at = struct.unpack_from("<I", frame, 4)[0], 8
    word = present
    while word & 0x80000000 and at + 4 <= len(frame):
        (word,) = struct.unpack_from("<I", frame, at)
        at += 4
    for bit, (align, size) in enumerate(RADIOTAP_FIELDS):
        if present >> bit & 1:
            at += -at % align
            if bit == 3:
                return struct.unpack_from("<H", frame, at)[0]
            at += size
    return None


def dissect(link: int, frame: bytes) -> dict:
    """The header fields and information elements of one frame."""
    out: dict = {"length": len(frame), "freq": None, "radiotap_len": 0}
    start = 0
    if link == RADIOTAP:
        (start,) = struct.unpack_from("<H", frame, 2)
        out["radiotap_len"], out["freq"] = start, radiotap_channel(frame)
    elif link == CUT:
        raise ValueError("record cut off")
    elif link != PLAIN:
        raise ValueError(f"link type {link}")
    body = frame[start:]
    if len(body) < 24:
        raise ValueError("frame shorter than its header")
    out["fc_type"], out["fc_subtype"] = body[0] >> 2 & 3, body[0] >> 4
    out["mac"] = ":".join(f"{b:02x}" for b in body[10:16])
    out["seq_ctrl"] = struct.unpack_from("<H", body, 22)[0]
    elements = body[24:]
    out["fcs"] = elements[-4:]
    ies, at = [], 0
    # an element that is cut off runs on into the check sequence, as a bit reader takes it
    while at < len(elements) - 4:
        size = elements[at + 1]
        ies.append({"ord": len(ies), "id": elements[at], "len": size, "info": elements[at + 2 : at + 2 + size]})
        at += 2 + size
    out["ies"] = ies
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    element = pa.struct([("ord", pa.int32()), ("id", pa.int32()), ("len", pa.int32()), ("info", pa.binary())])
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.binary(), pa.list_(element), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[dict] = []
            for number, (link, when, frame) in enumerate(records(content.as_py())):
                row = {"path": path, "packet": number, "ts": float(when), "ts_text": f"{when:.6f}"}
                try:
                    row |= dissect(link, frame)
                except (ValueError, struct.error, IndexError) as why:
                    row["bad"] = str(why)
                rows.append(row)
                if len(rows) == 4096:
                    yield _batch(rows, kinds)
                    rows = []
            if rows:
                yield _batch(rows, kinds)


def _batch(rows: list[dict], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(NAMES, kinds, strict=True)], NAMES)


def read_packets(spark: SparkSession, folder: str, dataset: str = "", glob: str = "*.pcap", recursive: bool = False) -> DataFrame:
    """Packets of all captures in a folder: dataset, label (file name without suffix), row_id and the fields.

    ``row_id`` orders packets by file and position. Frames that cannot be
    dissected have a reason in ``bad``.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return packets_of((reader.option("recursiveFileLookup", "true") if recursive else reader).load(folder), dataset)


def packets_of(files: DataFrame, dataset: str = "") -> DataFrame:
    """The same from a table of captures (path, content)."""
    packets = files.select("path", "content").mapInArrow(_read, PACKETS)
    label = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return packets.select(F.lit(dataset).alias("dataset"), F.url_decode(label).alias("label"), "*")


def probe_requests(packets: DataFrame) -> DataFrame:
    """Management frames of subtype 4 that could be dissected."""
    return packets.filter(F.col("bad").isNull() & (F.col("fc_type") == 0) & (F.col("fc_subtype") == 4))


def capture_folders(spark: SparkSession, root: str) -> DataFrame:
    """A row for each sub-folder: device, files (sorted), types, mergeable.

    Files of an unknown type are left out; folders that mix types are not
    mergeable.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pcap,pcapng,PCAP,PCAPNG,Pcap,PcapNG}").load(root)
    known = files.select("path", file_type(F.col("content")).alias("type")).filter("type is not null")
    device = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    grouped = known.groupBy(device.alias("device")).agg(F.array_sort(F.collect_list("path")).alias("files"), F.array_sort(F.collect_set("type")).alias("types"))
    return grouped.withColumn("mergeable", F.size("types") == 1)


def merge_captures(contents: list[bytes]) -> bytes:
    """One capture out of several of the same type: later pcap files lose their header, pcapng is appended."""
    if not contents:
        return b""
    if contents[0][:4] == PCAPNG_MAGIC:
        return b"".join(contents)
    if any(c[:4] != contents[0][:4] or c[20:24] != contents[0][20:24] for c in contents):
        raise ValueError("captures differ in byte order, time unit or link type")
    return contents[0] + b"".join(c[24:] for c in contents[1:])


def merge_folders(spark: SparkSession, root: str, out: str) -> DataFrame:
    """One capture for each sub-folder of ``root`` whose files are of one type, written to ``out``: device, path, bytes.

    Files are copied from stream to stream in the JVM, through any store that
    Spark reads. Files of an unknown type are left out, folders that mix types
    refused.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    # the list of files is as long as the devices; their bytes stay in the store
    for r in capture_folders(spark, root).filter("mergeable").orderBy("device").collect():
        target = f"{out}/{r.device}.{r.types[0]}"
        where = jvm.org.apache.hadoop.fs.Path(target)
        sink = where.getFileSystem(conf).create(where, True)
        try:
            first = None
            for path in r["files"]:
                source = jvm.org.apache.hadoop.fs.Path(path)
                stream = source.getFileSystem(conf).open(source)
                try:
                    if r.types[0] == "pcap":
                        head = bytes(stream.readNBytes(24))
                        if first is None:
                            sink.write(head)
                            first = head
                        elif head[:4] != first[:4] or head[20:24] != first[20:24]:
                            raise ValueError(f"{path} differs in byte order, time unit or link type")
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, 65536, False)
                finally:
                    stream.close()
        finally:
            sink.close()
        done.append((r.device, target, where.getFileSystem(conf).getFileStatus(where).getLen()))
    return spark.createDataFrame(done, "device string, path string, bytes long")
