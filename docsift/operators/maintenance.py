"""Keeping tables up to date: prune, replace, upsert, cascade, retention, pending work, backfill.

All are joins and unions on keys, with no rows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune_unseen(manifest: DataFrame, seen: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(kept, gone): rows of the manifest whose key was seen, and the others."""
    keys = seen.select(key).distinct()
    return manifest.join(keys, key, "left_semi"), manifest.join(keys, key, "left_anti")


def replace_partition(current: DataFrame, fresh: DataFrame, key: str = "source_id") -> DataFrame:
    """current without the partitions that fresh has, and fresh."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: the latest by version; of equals, a change, then the greatest by its other columns.

    An aggregate of structs, so it combines before the shuffle however many rows a key has."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.select(*current.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in (key, version)]
    best = both.groupBy(key).agg(F.max(F.struct(version, "_new", *rest)).alias("_r"))
    return best.select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in current.columns))


def cascade_delete(removed: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of removed keys."""
    gone = removed.select(key).distinct()
    return {n: t.join(gone, key, "left_anti").select(*t.columns) for n, t in tables.items()}


def newest(runs: DataFrame, at: str, keep: int = 50, tie: str = "id", by: str | None = None) -> DataFrame:
    """The `keep` newest rows, in all (a plain top-k) or for each value of `by`."""
    if by is None:
        return runs.orderBy(F.desc(at), F.asc(tie)).limit(keep)
    order = Window.partitionBy(by).orderBy(F.desc(at), F.asc(tie))
    return runs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def pending(chunks: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("chunk_id", "model", "text_hash")) -> DataFrame:
    """Chunks without a cached vector of the same model and text."""
    return chunks.join(cached.select(*keys).distinct(), list(keys), "left_anti")


def reused(chunks: DataFrame, vectors: DataFrame, key: str = "text_hash") -> DataFrame:
    """Chunks with the vector of any earlier chunk of the same text, null if there is none."""
    known = vectors.groupBy(key).agg(F.first("vector").alias("vector"))
    return chunks.join(known, key, "left")


def changed_files(scan: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("file_id", "mtime_ms", "size")) -> DataFrame:
    """Files that the manifest doesn't hold with the same time and size."""
    return scan.join(manifest.select(*keys).distinct(), list(keys), "left_anti")


def file_actions(scan: DataFrame, manifest: DataFrame, key: str = "file_id", same: tuple[str, ...] = ("mtime_ms", "size")) -> DataFrame:
    """(key, action) of each file of either: new, changed, unchanged (all of `same` equal) or gone. One join."""
    now, was = F.struct(*(F.col(c).cast("long") for c in same)), F.struct(*(F.col(c).cast("long") for c in same))
    df = scan.select(key, now.alias("_now")).join(manifest.select(key, was.alias("_was")), key, "full")
    action = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") == F.col("_was"), "unchanged").otherwise("changed")
    return df.select(key, action.alias("action"))


def merge_vectors(old: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def stale_ocr_cache(recognized: Column, total: Column, limit: Column) -> Column:
    """Whether a cached scan covers fewer pages than are wanted now."""
    wanted = F.when(limit > 0, F.least(limit, total)).otherwise(total)
    return recognized < wanted


def vector_provider(provider: str, enabled: bool, available: bool) -> tuple[str, bool]:
    """(provider used, whether a vector service is expected)."""
    p = provider.strip().lower()
    p = p if p in ("qdrant", "json", "auto") else "auto"
    if not enabled or p == "json":
        return "json", False
    return (p, True) if p != "auto" else ("qdrant" if available else "json", True)


def backfill_rows(sources: DataFrame, chunks: DataFrame, json_vectors: DataFrame, service_counts: DataFrame, provider: str = "json") -> DataFrame:
    """Per source: chunks, vectors stored by the provider, missing, ready; sources without chunks have zeros."""
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    df = sources.join(count(chunks, "chunks"), "source_id", "left").join(count(json_vectors, "json_vectors"), "source_id", "left").join(service_counts.select("source_id", "service_vectors"), "source_id", "left")
    df = df.fillna(0, ["chunks", "json_vectors", "service_vectors"])
    stored = F.col("json_vectors" if provider == "json" else "service_vectors")
    return df.withColumn("stored_vectors", stored).withColumn("missing", F.greatest(F.lit(0), F.col("chunks") - stored)).withColumn("ready", (F.col("chunks") > 0) & (stored >= F.col("chunks")))


def backfill_order() -> list[Column]:
    """Incomplete sources first, fewest missing first, then the complete ones by title."""
    return [F.asc(F.col("missing") == 0), F.asc("missing"), F.asc("title")]


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def ordered_concat(*frames: DataFrame) -> DataFrame:
    """All rows, with part, the number of the frame that each comes from, to order by."""
    out = None
    for i, f in enumerate(frames):
        g = f.withColumn("part", F.lit(i))
        out = g if out is None else out.unionByName(g)
    return out


def merge_models(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per model: the loaded one first, then the first by name of its origin."""
    return rows.groupBy(key).agg(F.max("loaded").alias("loaded"), F.max_by("origin", F.struct("loaded", "origin")).alias("origin"))
