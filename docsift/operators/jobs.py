"""Jobs and runs from an event log: latest state, health, failure runs, totals, history groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_MS = 120_000


def latest(jobs: DataFrame, key: str, times: tuple[str, ...], tie: str) -> DataFrame:
    """The latest row of each key by the first of the times that isn't null.

    An aggregate of (time, tie, row), so it combines before the shuffle however many rows a key has."""
    at = F.coalesce(*map(F.col, times))
    rest = [c for c in jobs.columns if c != key]
    best = jobs.groupBy(key).agg(F.max(F.struct(at.alias("_at"), F.col(tie).alias("_tie"), *(F.col(c) for c in rest))).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def with_latest_job(sources: DataFrame, jobs: DataFrame, key: str, times: tuple[str, ...], tie: str) -> DataFrame:
    return sources.join(latest(jobs, key, times, tie), key, "left")


def health(status: Column, phase: Column, updated: Column, now: Column, alive: Column, stale_ms: int = STALE_MS) -> Column:
    """(health, code, stale, age_ms) of a job."""
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    age = F.greatest(F.lit(0), ms(now) - ms(updated))
    running = status == "running"
    gone = (running & ~alive) | ((status == "failed") & (phase == "interrupted"))
    silent = running & alive & (age > stale_ms)
    name = F.when(gone, "interrupted").when(silent, "stale").when(running, "active").when(status.isin("failed", "cancelled", "completed"), status).otherwise("idle")
    code = F.when(gone, "process_missing").when(silent, "no_recent_progress").when(running, "progress_recent").when(F.coalesce(status, F.lit("")) != "", status).otherwise("not_indexed")
    return F.struct(name.alias("health"), code.alias("code"), F.coalesce(gone | silent, F.lit(False)).alias("stale"), age.alias("age_ms"))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column, abort_at: int = 3) -> DataFrame:
    """Each run of consecutive failures: key, its length, first and last place, and whether it reaches abort_at."""
    over = Window.partitionBy(key).orderBy(*order)
    df = events.withColumn("_i", F.row_number().over(over)).withColumn("_f", failed)
    df = df.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(key, "_f").orderBy(*order)))
    runs = df.filter("_f").groupBy(key, "_run").agg(F.count("*").alias("length"), F.min("_i").cast("long").alias("first"), F.max("_i").cast("long").alias("last"))
    return runs.drop("_run").withColumn("aborted", F.col("length") >= abort_at)


def history_group(day: Column, today: Column) -> Column:
    """today, yesterday, week, or the month."""
    d = F.datediff(today, day)
    return F.when(d <= 0, "today").when(d == 1, "yesterday").when(d < 7, "week").otherwise(F.date_format(day, "yyyy-MM"))


def run_totals(runs: DataFrame, counters: list[str]) -> DataFrame:
    return runs.agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters))


def reinterpreted(status: Column, alive: Column) -> Column:
    """A running job without a live process is interrupted."""
    return F.when((status == "running") & ~alive, "interrupted").otherwise(status)


def progress_percent(done: Column, total: Column, status: Column) -> Column:
    return F.when(status == "completed", 100).when(total > 0, F.least(F.lit(99), F.floor(100.0 * done / total))).otherwise(0).cast("int")


def merged_status(status: Column, counted: Column, found: Column) -> Column:
    """A counter that never falls behind what the index holds; a finished job with its own count keeps it."""
    return F.when((status == "completed") & (counted > 0), counted).otherwise(F.greatest(counted, found))
