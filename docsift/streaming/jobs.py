"""Structured Streaming: latest state of jobs, silence timeouts, windows and sessions of events, incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def latest_state(events: DataFrame, key: str, at: str, tie: str, fields: list[str]) -> DataFrame:
    """The fields of each key's latest event; runs alike on a stream (update or complete mode) and on a table."""
    row = F.struct(F.col(at), F.col(tie), *(F.col(f) for f in fields))
    best = events.groupBy(key).agg(F.max(row).alias("_r"), F.count("*").alias("n_events"))
    return best.select(key, F.col(f"_r.{at}").alias(at), *(F.col(f"_r.{f}").alias(f) for f in fields), "n_events")


def windowed(events: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of value by tumbling or sliding window; with `late`, under a watermark of that delay."""
    df = events.withWatermark(at, late) if late else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = df.groupBy(w.alias("_w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each key: runs of events without a pause of `gap`."""
    df = events.withWatermark(at, late) if late else events
    out = df.groupBy(F.session_window(at, gap).alias("_w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def silence(events: DataFrame, key: str, at: str, status: str, stale_seconds: int = 120, late: str = "10 minutes") -> DataFrame:
    """(key, health, last): active on progress of a running job, its end state when it ends, and stale once the
    watermark is stale_seconds past its last progress. State is one small row for each job that runs."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(health: str, last: pd.Timestamp) -> pd.DataFrame:
            return pd.DataFrame({key: [k[0]], "health": [health], "last": [last]})

        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0], unit="ms")
            state.remove()
            yield row("stale", last)
            return
        best = None
        for f in frames:
            newest = f.loc[f[at].idxmax()]
            if best is None or newest[at] > best[0]:
                best = (newest[at], newest[status])
        if best is None:
            return
        ms = int(best[0].timestamp() * 1000)
        if state.exists and state.get[0] > ms:
            return
        if best[1] != "running":
            if state.exists:
                state.remove()
            yield row(str(best[1]), best[0])
            return
        state.update((ms,))
        state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs()) + stale_seconds * 1000)
        yield row("active", best[0])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(at, late).select(key, at, status)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, health string, last timestamp", "ms long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(files: DataFrame, manifest_path: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, keys: tuple[str, ...] = ("file_id", "mtime_ms", "size")) -> StreamingQuery:
    """Process each new or changed file of a stream once and add it to the manifest, as far as there is input.

    A batch that is run again after a failure finds its files in the manifest and adds nothing."""

    def batch(df: DataFrame, _id: int) -> None:
        from docsift.operators.maintenance import changed_files

        spark = df.sparkSession
        schema = df.schema
        try:
            known = spark.read.schema(schema).parquet(manifest_path)
            fresh = changed_files(df.dropDuplicates(list(keys)), known, keys)
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = df.dropDuplicates(list(keys))
        process(fresh.select(*df.columns)).write.mode("append").parquet(manifest_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
