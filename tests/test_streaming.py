from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docsift.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "job string, at timestamp, event_id long, status string, value double"


def rows(spark, *items):
    return spark.createDataFrame([(j, T0 + timedelta(seconds=s), i, st, 1.0) for i, (j, s, st) in enumerate(items)], SCHEMA)


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_latest_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, ("a", 0, "running"), ("a", 9, "completed"), ("b", 5, "running")).write.parquet(folder)
    stream = jobs.latest_state(jobs.event_stream(spark, folder, SCHEMA), "job", "at", "event_id", ["status"])
    drained(stream.writeStream.outputMode("complete").format("memory").queryName("latest").start())
    got = {r["job"]: (r["status"], r["n_events"]) for r in spark.table("latest").collect()}
    assert got == {"a": ("completed", 2), "b": ("running", 1)}
    batch = jobs.latest_state(spark.read.parquet(folder), "job", "at", "event_id", ["status"])
    assert {r["job"]: (r["status"], r["n_events"]) for r in batch.collect()} == got


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, ("a", 0, "x"), ("a", 59, "x"), ("a", 60, "x")).write.parquet(folder)
    stream = jobs.windowed(jobs.event_stream(spark, folder, SCHEMA), "at", ["job"], "1 minute", late="10 seconds")
    drained(stream.writeStream.outputMode("update").format("memory").queryName("w").start())
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
    sessions = jobs.sessions(spark.read.parquet(folder), "at", "job", "30 seconds").collect()
    assert sorted(r["n"] for r in sessions) == [1, 2]


def test_silence(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, ("a", 0, "running"), ("b", 0, "running"), ("b", 1, "completed")).coalesce(1).write.parquet(folder)
    stream = jobs.silence(jobs.event_stream(spark, folder, SCHEMA), "job", "at", "status", late="1 second")
    query = stream.writeStream.outputMode("append").format("memory").queryName("silence").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    assert {(r["job"], r["health"]) for r in spark.table("silence").collect()} == {("a", "active"), ("b", "completed")}
    for later in (500, 900):
        rows(spark, ("z", later, "completed")).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    drained(query)
    assert ("a", "stale") in {(r["job"], r["health"]) for r in spark.table("silence").collect()}


def test_ingest(spark, tmp_path):
    schema = "file_id string, mtime_ms long, size long"
    source, manifest = str(tmp_path / "s"), str(tmp_path / "m")
    spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, 1)], schema).write.parquet(source)
    files = lambda: spark.readStream.schema(schema).parquet(source)
    jobs.ingest(files(), manifest, lambda df: df, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(manifest).count() == 2
    spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], schema).write.mode("append").parquet(source)
    jobs.ingest(files(), manifest, lambda df: df.withColumn("size", F.col("size")), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(manifest).count() == 3
