"""A walk of folders, level by level: tasks list the folders of one level, and those not excluded are the next.

A folder that is excluded is counted but never listed, whatever lies below it. Empty files and those whose names start
with a dot are listed, links are not followed. A folder that can't be read is a row with the error; the walk goes on.
Folders must be reachable by the executors as ordinary ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.paths import excluded, included
from docsift.session import checkpointed, importable
from docsift.sources.matrices import local
from docsift.sources.readers import classified

_COLUMNS = ("root", "path", "inner", "kind", "mtime_ms", "size", "error")
_ENTRY = "root string, path string, inner string, kind string, mtime_ms long, size long, error string"
#: Rows that a task holds at a time.
_BATCH = 10_000


def _entries(root: str, path: str, inner: str) -> Iterator[tuple]:
    """What a folder holds: files and folders; or one row with the error."""
    try:
        with os.scandir(path) as listing:
            for e in listing:
                below = f"{inner}/{e.name}" if inner else e.name
                if e.is_dir(follow_symlinks=False):
                    yield root, e.path, below, "folder", None, None, None
                elif e.is_file(follow_symlinks=False):
                    try:
                        facts = e.stat(follow_symlinks=False)
                        yield root, e.path, below, "file", facts.st_mtime_ns // 1_000_000, facts.st_size, None
                    except OSError as x:  # gone since it was listed
                        yield root, e.path, below, "file", None, None, f"{type(x).__name__}: {x.strerror}"
    except OSError as x:
        yield root, path, inner, "unreadable", None, None, f"{type(x).__name__}: {x.strerror}"


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    table = lambda: pd.DataFrame(rows, columns=list(_COLUMNS)).astype({"mtime_ms": "Int64", "size": "Int64"})
    for f in frames:
        for root, path, inner in zip(f["root"], f["path"], f["inner"]):
            for row in _entries(root, path, inner):
                rows.append(row)
                if len(rows) >= _BATCH:
                    yield table()
                    rows = []
    if rows:
        yield table()


def walk(spark: SparkSession, roots: list[str], exclude: list[str] | None = None) -> DataFrame:
    """(root, path, relative_path, kind, mtime_ms, size, error): every file, folder, pruned and unreadable folder below the
    roots. With more than one root, relative paths start with the root's name in brackets; patterns look at the path below
    the root alone. Each level is stored before the next is listed; a tree has few levels."""
    importable(spark)
    roots = list(dict.fromkeys(local(r).rstrip("/") or "/" for r in roots))
    level = spark.createDataFrame([(r, r, "") for r in roots], "root string, path string, inner string")
    count, levels = len(roots), []
    while count:
        spread = level.repartition(max(1, min(count, 2_000)), "path")
        found = checkpointed(spread.mapInPandas(_listed, _ENTRY).withColumn("kind", F.when((F.col("kind") == "folder") & excluded(F.col("inner"), exclude or []), "pruned").otherwise(F.col("kind"))))
        levels.append(found)
        level = found.filter("kind = 'folder'").select("root", "path", "inner")
        count = level.count()
    out = spark.createDataFrame([], _ENTRY) if not levels else levels[0]
    for found in levels[1:]:
        out = out.unionByName(found)
    label = F.concat(F.lit("["), F.substring_index("root", "/", -1), F.lit("]/")) if len(roots) > 1 else F.lit("")
    return out.withColumn("relative_path", F.concat(label, "inner")).select("root", "path", "relative_path", "kind", "mtime_ms", "size", "error")


def walked_files(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The files of a walk in the form of a scan, with extension and reason."""
    return classified(entries.filter("kind = 'file'").select("path", "relative_path", "root", "mtime_ms", "size"), include, exclude)


def scan_counters(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """One row of counters: files by what becomes of them, folders met (pruned ones too), folders that can't be read."""
    include, exclude = include or [], exclude or []
    df = classified(entries, include, exclude)
    file, by_exclude = F.col("kind") == "file", excluded(F.col("relative_path"), exclude)
    of = lambda reason: file & (F.col("reason") == reason)
    counts = {
        "total_files": file,
        "eligible_files": of("eligible"),
        "unsupported_files": of("unsupported"),
        "temporary_files": of("temporary"),
        "excluded_files": of("excluded"),
        "included_files": of("eligible") | of("unsupported"),
        "excluded_by_exclude": of("excluded") & by_exclude,
        "excluded_by_include": of("excluded") & ~by_exclude & ~included(F.col("relative_path"), include),
        "directories": F.col("kind").isin("folder", "pruned"),
        "unreadable_directories": F.col("kind") == "unreadable",
    }
    return df.agg(*(F.count_if(c).alias(name) for name, c in counts.items()))


def skipped_files(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that an index leaves out, and why."""
    return walked_files(entries, include, exclude).filter("reason <> 'eligible'")
