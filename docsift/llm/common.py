"""Helpers shared by the corpus operators: code shipping, shared storage, native span columns."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions.arrays import prefix_sums
from docsift.session import checkpointed, shared_root  # noqa: F401

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docsift/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passing(df: DataFrame, text: str, keep_text: bool, *made: str) -> list[T.StructField]:
    """The input's columns that an operator hands on: not those whose names it makes itself, which it replaces."""
    return [f for f in df.schema if f.name not in (*made, "_text") and (keep_text or f.name != text)]


def ddl(fields: list[T.StructField], *made: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *made])


def shielded(df: DataFrame, core: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(df), with the columns outside core under names of their own meanwhile, so that none can clash."""
    own = {c: f"__extra_{i}" for i, c in enumerate(df.columns) if c not in core}
    return work(df.withColumnsRenamed(own)).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def find_all(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]], out: str) -> DataFrame:
    """Add an array of (kind, ord, start, end, match) structs: all leftmost non-overlapping matches of each kind.

    patterns: kind -> (regular expression, a cheap condition without which nothing can match, or None); ord is the
    kind's place among them. Offsets are code points, the end exclusive; they come from the lengths of the matches and
    of the gaps between them, as Spark's functions return matches without their places. One lambda serves all kinds,
    which keeps the plan small.
    """
    none = F.array().cast("array<string>")
    guarded = lambda value, guard: value if guard is None else F.when(guard, value).otherwise(none)
    df = df.withColumns({f"_m_{k}": guarded(F.regexp_extract_all(F.col(text), F.lit(r), F.lit(0)), g) for k, (r, g) in patterns.items()})
    rows = [
        F.struct(F.lit(k).alias("kind"), F.lit(i).alias("ord"), F.col(f"_m_{k}").alias("m"), F.when(F.size(f"_m_{k}") > 0, F.split(F.col(text), r, -1)).otherwise(none).alias("g"))
        for i, (k, (r, _)) in enumerate(patterns.items())
    ]
    df = df.withColumn("_found", F.array(*rows)).drop(*(f"_m_{k}" for k in patterns))

    def spans(row: Column) -> Column:
        steps = F.transform(row["m"], lambda m, i: F.length(F.get(row["g"], i)) + F.coalesce(F.length(F.get(row["m"], i - 1)), F.lit(0)))
        return F.zip_with(
            row["m"],
            prefix_sums(steps),
            lambda m, s: F.struct(row["kind"].alias("kind"), row["ord"].alias("ord"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")),
        )

    found = F.filter("_found", lambda row: F.size(row["m"]) > 0)
    return df.withColumn(out, F.flatten(F.transform(found, spans))).drop("_found")


def spans_text(spans: Column) -> Column:
    """kind:start:end of an array of (start, ord, end, kind, ...) structs, in their order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few hundred rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean() -> None:
    """Let this worker's freed arrays go back to the system at once, where the C library is one that can be told so."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass
    pa.default_memory_pool().release_unused()
