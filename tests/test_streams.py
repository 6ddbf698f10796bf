"""Streams with state: windows that close, late events, documents whose pages come bit by bit."""

from __future__ import annotations

import time

from foliospark.streaming import jobs as streams
from pyspark.sql import Window
from pyspark.sql import functions as F

EVENT = "event_type string, value double, ts timestamp_ntz"


def test_windows_close_and_late_events_go_aside(spark, tmp_path):
    at = str(tmp_path)
    batches = [
        [("a", 1.0, "2024-01-01 10:05:00"), ("a", 2.0, "2024-01-01 10:06:00"), ("b", 3.0, "2024-01-01 11:05:00"), (None, 4.0, "2024-01-01 10:00:00"), ("a", 9.0, None)],
        [("a", 5.0, "2024-01-01 14:05:00"), ("b", 5.5, "2024-01-01 10:59:00")],
        [("a", 6.0, "2024-01-01 10:07:00"), ("a", 7.0, "2024-01-01 14:06:00")],
        [("b", 8.0, "2024-01-01 23:00:00")],
    ]
    opened = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_type string, value double, t string").select("event_type", "value", F.to_timestamp_ntz("t").alias("ts")).coalesce(1).write.parquet(f"{at}/in/{k}")
        stream = streams.stream_parquet(spark, f"{at}/in/*", spark.createDataFrame([], EVENT).schema)
        streams.stream_throughput(stream, f"{at}/out", f"{at}/checkpoint")
        opened.append({(str(r.window_start)[11:13], r.event_type): r.n for r in streams.open_windows(spark, f"{at}/checkpoint").collect()})
    closed = spark.read.parquet(f"{at}/out/closed")
    assert sorted((str(r.window_start)[11:13], r.event_type or "", r.n) for r in closed.collect()) == [("10", "", 1), ("10", "a", 2), ("10", "b", 1), ("11", "b", 1), ("14", "a", 2)]
    late = spark.read.parquet(f"{at}/out/late")
    assert sorted((r.event_type, r.value, str(r.ts)) for r in late.collect()) == [("a", 6.0, "2024-01-01 10:07:00")]
    # The state holds only windows that the watermark (ten minutes before the latest event) hasn't passed.
    assert opened[-1] == {("23", "b"): 1} and ("14", "a") in opened[2] and all(k[0] != "10" for k in opened[2])


def test_all_windows_once_whatever_the_batches(spark, tmp_path, sf):
    """Events of one type in the order of time, cut into files: every window is counted once."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        n = events.count()
        events.withColumn("r", F.row_number().over(Window.orderBy("ts"))).where((F.col("r") > n * k // 3) & (F.col("r") <= n * (k + 1) // 3)).drop("r").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        streams.stream_throughput(streams.stream_parquet(spark, f"{tmp_path}/in/*", events.schema), f"{tmp_path}/out", f"{tmp_path}/c", every="1 day")
    closed = spark.read.parquet(f"{tmp_path}/out/closed").select("window_start", "event_type", "n")
    got = closed.unionByName(streams.open_windows(spark, f"{tmp_path}/c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.throughput(events, every="1 day").collect()))
    assert spark.read.parquet(f"{tmp_path}/out/late").count() == 0 and closed.count() > streams.open_windows(spark, f"{tmp_path}/c").count()


def test_documents_from_their_state(spark, tmp_path):
    at, shape = str(tmp_path), "pdf_name string, page int, natural_text string"
    expected = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 2)], "pdf_name string, n_pages int")

    def run(rows, wait):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = streams.stream_parquet(spark, f"{at}/in", spark.createDataFrame([], shape).schema)
        streams.stream_documents(stream, expected, f"{at}/out", f"{at}/checkpoint", wait=wait)
        docs = {r.pdf_name: r.text for r in spark.read.parquet(f"{at}/out/documents").collect()}
        left = sorted((r.pdf_name, r.page, r.natural_text) for r in spark.read.parquet(f"{at}/out/unfinished").collect())
        return docs, left

    assert run([("a", 1, "One."), ("b", 1, "B"), ("x", 1, "unknown")], 600_000) == ({"b": "B"}, [])
    assert run([("a", 2, "Two."), ("a", 1, "again"), ("c", 1, "C")], 600_000) == ({"b": "B"}, [])
    assert run([("a", None, "End."), ("b", 1, "once more")], 600_000)[0].keys() == {"a", "b"}
    assert run([("d", 2, "D")], 1)[1] == []
    time.sleep(0.1)
    docs, left = run([("b", 1, "and again")], 1)  # d's time is over; c may wait
    assert docs["a"].count("One.") == 1 and left == [("d", 2, "D")]
