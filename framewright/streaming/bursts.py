"""Bursts over a stream of packets. An addition: the batch operators stand without it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.pcap import PACKETS, _read, probe_requests


def stream_packets(spark: SparkSession, folder: str, glob: str = "*.pcap", files_per_trigger: int = 64) -> DataFrame:
    """Packets of captures as they arrive in a folder, with ``time`` as event time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    packets = files.select("path", "content").mapInArrow(_read, PACKETS)
    label = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return packets.withColumns({"label": label, "time": F.timestamp_micros((F.col("ts") * 1e6).cast("long"))})


def stream_bursts(packets: DataFrame, gap: str = "1 second", late: str = "1 minute") -> DataFrame:
    """label, mac, start, end, n: runs of probe requests without a pause of ``gap``; rows later than ``late`` are let go."""
    probes = probe_requests(packets).withWatermark("time", late)
    return probes.groupBy(F.session_window("time", gap).alias("w"), "label", "mac").agg(F.count(F.lit(1)).alias("n")).select("label", "mac", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def event_bursts(events: DataFrame, key: str, time: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """The same over any stream or table of events."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
