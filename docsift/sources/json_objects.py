"""JSON files of many objects, read by ranges of their bytes: one large array is the work of many tasks.

What a byte means depends on all before it: a brace within a string is text. A first pass gives, for each range and each
state that it may be entered in (outside a string, within one, behind a backslash), the state that it is left in and how
many braces it opens; composing these rows, one after the other, tells how each range is entered. In the second pass each
range gives the outermost objects that begin in it, reading on behind its end while the last one is open. Objects are
text, parsed by Spark.

Everything outside the outermost objects is skipped, so arrays, objects one behind the other and JSON lines are read
alike. Defined results: an absent file gives no rows if asked so, an empty one none; an object that its file doesn't end
is left out; one that is no valid JSON has null columns.

Files must lie in a folder that driver and executors share as an ordinary one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import checkpointed, importable
from docsift.sources.matrices import local

RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
#: States: outside a string, within one, within one behind a backslash.
OUTSIDE, WITHIN, ESCAPED = range(3)
_RANGE = "path string, part long, first long, last long"


def scanned(data: bytes, state: int) -> tuple[np.ndarray, int]:
    """Braces outside strings, by place (1 opens, -1 closes, 0 is no brace), and the state behind the data."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), state
    slash = (b == 0x5C).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], slash, [0]))))
    first, behind = edges[::2], edges[1::2]
    length = behind - first
    if state == ESCAPED and len(first) and first[0] == 0:
        length[0] -= 1  # the first backslash is itself escaped
    skipped = behind[length % 2 == 1]
    quote = b == 0x22
    quote[skipped[skipped < len(b)]] = False
    if state == ESCAPED:
        quote[0] = False
    within = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    step = (b == 0x7B).astype(np.int64) - (b == 0x7D)
    step[within] = 0
    return step, ESCAPED if len(skipped) and skipped[-1] == len(b) else int(within[-1])


def transitions(path: str, first: int, last: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """For each state that a range may be entered in: the state that it is left in, and the braces it opens less those it
    closes."""
    now = [(s, 0) for s in (OUTSIDE, WITHIN, ESCAPED)]
    with open(local(path), "rb") as f:
        f.seek(first)
        for at in range(first, last, block):
            data = f.read(min(block, last - at))
            found = {s: scanned(data, s) for s in {s for s, _ in now}}
            now = [(found[s][1], depth + int(found[s][0].sum())) for s, depth in now]
    return now


def objects(path: str, first: int, last: int, state: int, depth: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each outermost object that begins in a range entered in this state and depth."""
    with open(local(path), "rb") as f:
        f.seek(first)
        at, began, held = first, None, []
        while began is not None or at < last:
            data = f.read(block)
            if not data:
                return
            step, state = scanned(data, state)
            level = depth + np.cumsum(step)
            places = np.flatnonzero((step == 1) & (level == 1) | (step == -1) & (level == 0))
            kept = 0
            for p in places.tolist():
                if step[p] == 1:
                    if at + p >= last:
                        return
                    began, kept = at + p, p
                elif began is not None:
                    held.append(data[kept : p + 1])
                    yield began, b"".join(held)
                    began, held = None, []
            if began is not None:
                held.append(data[kept:])
            at += len(data)
            depth = int(level[-1])


def _ranges(spark: SparkSession, paths: str | list[str], size: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length").filter("length > 0")
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    return parts.select("path", "part", (F.col("part") * size).alias("first"), F.least("length", (F.col("part") + 1) * size).alias("last"))


def _spread(ranges: DataFrame) -> DataFrame:
    """One range a task, up to 10,000 tasks, in the order of the files."""
    return ranges.repartitionByRange(max(1, min(ranges.count(), 10_000)), "path", "part")


def _measured(ranges: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                found = transitions(r.path, r.first, r.last)
                yield pd.DataFrame([(*r, [s for s, _ in found], [d for _, d in found])], columns=[*f.columns, "states", "depths"])

    return ranges.mapInPandas(run, f"{_RANGE}, states array<int>, depths array<long>")


def _composed(frame: pd.DataFrame, state: int = OUTSIDE, depth: int = 0) -> tuple[pd.DataFrame, int, int]:
    """The state and depth that each of a file's ranges is entered in, and those behind the last."""
    frame = frame.sort_values("part")
    entered = []
    for states, depths in zip(frame["states"], frame["depths"]):
        entered.append((state, depth))
        state, depth = int(states[state]), depth + int(depths[state])
    return frame[["path", "part", "first", "last"]].assign(state=[s for s, _ in entered], depth=[d for _, d in entered]), state, depth


def _texts(entered: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                rows, size = [], 0
                for place, raw in objects(r.path, r.first, r.last, r.state, r.depth):
                    rows.append((r.path, place, raw.decode("utf-8", "replace")))
                    size += len(raw)
                    if size > 4 * BLOCK:
                        yield pd.DataFrame(rows, columns=["path", "place", "json"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "place", "json"])

    return entered.mapInPandas(run, "path string, place long, json string")


def json_texts(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, place, json) of every outermost object of the files; place is the byte where it begins."""
    importable(spark)
    measured = checkpointed(_measured(_spread(_ranges(spark, paths, range_bytes))))  # a row of some bytes for each range
    entered = measured.groupBy("path").applyInPandas(lambda f: _composed(f)[0], f"{_RANGE}, state int, depth long")
    return _texts(_spread(checkpointed(entered)))


def read_objects(spark: SparkSession, paths: str | list[str], schema: str, fallback: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects' fields by this schema; absent files give no rows if fallback."""
    from pyspark.errors import AnalysisException

    try:
        texts = json_texts(spark, paths, range_bytes)
    except AnalysisException as e:
        if not fallback or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return texts.select(F.from_json("json", schema).alias("_o")).select("_o.*")


def first_object(spark: SparkSession, path: str, schema: str, condition: Column, range_bytes: int = RANGE_BYTES, together: int = 8) -> DataFrame:
    """The first object of a file that meets the condition, or no row. Ranges are read a few at a time, then more, and none
    behind the step in which it is found but for the end of that step's last object."""
    importable(spark)
    ranges = checkpointed(_ranges(spark, path, range_bytes))
    total, low, state, depth = ranges.count(), 0, OUTSIDE, 0
    while low < total:
        step = ranges.filter((F.col("part") >= low) & (F.col("part") < low + together))
        rows = _measured(_spread(step)).toPandas()  # at most 4,096 rows of some bytes
        entered, state, depth = _composed(rows, state, depth)
        texts = _texts(_spread(spark.createDataFrame(entered, f"{_RANGE}, state int, depth long")))
        found = texts.select("place", F.from_json("json", schema).alias("_o")).select("place", "_o.*").filter(condition).orderBy("place").limit(1).drop("place").collect()
        if found:
            return spark.createDataFrame(found, schema)
        low, together = low + together, min(together * 4, 4096)
    return spark.createDataFrame([], schema)


def write_arrays(df: DataFrame, folder: str) -> None:
    """Each partition as one file with a JSON array, in a folder that executors share. A task writes under a name of its
    own and renames, so one that runs again replaces its file by an equal one."""
    importable(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        goal = os.path.join(local(folder), f"part-{number:06d}.json")
        draft = f"{goal}.{uuid.uuid4().hex}.draft"
        os.makedirs(local(folder), exist_ok=True)
        n = 0
        with open(draft, "wb") as f:
            f.write(b"[")
            for frame in frames:
                for text in frame["_json"]:
                    f.write((b",\n" if n else b"\n") + text.encode())
                    n += 1
            f.write(b"\n]\n")
        os.replace(draft, goal)
        yield pd.DataFrame({"rows": [n]})

    df.select(F.to_json(F.struct(*df.columns)).alias("_json")).mapInPandas(run, "rows long").agg(F.sum("rows")).collect()
