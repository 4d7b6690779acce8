"""Captures made from ``documents``: a probe request for each row, its elements from digests of the whole text.

The driver's tables hold no captures, so the queries over hex, binary and
dissected tables read these; their SQL computes what must come out from the
documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators import decode
from framewright.sources import pcap

PER_FILE = 500  # document numbers a file, so a file is small whatever the table
#: Fixed values in hex: file header (little-endian, microseconds, radiotap), radiotap start, frame control, broadcast.
HEADER, RADIOTAP, CONTROL, ALL = "d4c3b2a1020004000000000000000000ffff00007f000000", "00000c0008000000", "40000000", "ff" * 6
LENGTH = 183  # bytes of a frame


def number(value: Column, size: int) -> Column:
    """Little-endian hex of a number."""
    big = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))))


def element(kind: int, payload: Column, size: int) -> Column:
    return F.concat(F.lit(f"{kind:02x}{size:02x}"), payload)


def frame() -> Column:
    """Hex of a probe request: sender and sequence from the id, elements from ``sha`` and ``md``."""
    i = F.col("doc_id")
    parts = [
        F.lit(RADIOTAP), number(2412 + 5 * (i % 13), 2), F.lit("a000" + CONTROL + ALL + "02"), F.lpad(F.hex(i), 10, "0"), F.lit(ALL), number(16 * i % 65536, 2),
        element(decode.SSID, F.hex(F.encode("md", "UTF-8")), 32), element(decode.RATES, F.lit("02040b16"), 4), element(decode.DS, number(i % 11 + 1, 1), 1),
        element(decode.HT, F.substring("sha", 1, 52), 26), element(decode.EXT_CAP, F.substring("sha", 47, 18), 9),
        element(decode.VENDOR, F.col("sha"), 32), element(decode.VENDOR, F.col("md"), 16),
        element(decode.EXTENSION, F.concat(F.lit(f"{decode.HE_EXTENSION:02x}"), F.substring("md", 1, 12)), 7), F.substring("md", 25, 8),
    ]
    return F.concat(*parts)


def captures(docs: DataFrame) -> DataFrame:
    """path, content: a capture for each language and ``PER_FILE`` document numbers, packets in order of the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", F.sha2(text, 256).alias("sha"), F.md5(text).alias("md"))
    size = number(F.lit(LENGTH), 4)
    record = F.concat(number(1000 + F.col("doc_id"), 4), number(F.col("doc_id") % 1000000, 4), size, size, frame())
    name = F.concat_ws("-", F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / PER_FILE).cast("string"))
    files = rows.groupBy(name.alias("name")).agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("record")))).alias("records"))
    whole = F.concat(F.lit(HEADER), F.array_join(F.transform("records", lambda r: r["record"]), ""))
    return files.select(F.concat(F.lit("/captures/"), "name", F.lit(".pcap")).alias("path"), F.unhex(whole).alias("content"))


def probes(docs: DataFrame) -> DataFrame:
    """The packets of those captures."""
    return pcap.probe_requests(pcap.packets_of(captures(docs)))
