from captures import ALL, DS, frame, pcap
from pyspark.sql import functions as F

from framewright.streaming import bursts

MAC = "02:00:00:00:00:01"


def test_stream_of_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "dev.pcap").write_bytes(pcap([frame(MAC, ALL), frame(MAC, ALL), frame(MAC, [DS], subtype=8)]))
    found = bursts.stream_bursts(bursts.stream_packets(spark, f"file://{tmp_path}/in"), gap="5 seconds")
    query = found.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("found").collect()
    assert [(r.label, r.mac, r.n) for r in rows] == [("dev", MAC, 2)]
    query.stop()


def test_event_sessions(spark):
    df = spark.createDataFrame([("a", 0), ("a", 60), ("a", 3600), ("b", 5)], "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    rows = bursts.event_bursts(df, "user", "ts").collect()
    assert sorted((r.user, r.n) for r in rows) == [("a", 1), ("a", 2), ("b", 1)]
