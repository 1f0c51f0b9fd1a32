"""Sinks: staged overwrite, partition overwrite, portable export, front matter of cached texts."""

from __future__ import annotations

import io
import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap by two renames; df may read the table. Readers see the old rows or the new, but
    for the moment between the renames; if the second fails, the old table is put back."""
    spark = df.sparkSession
    fs, target, jvm = _fs(spark, path)
    staged, old = jvm.org.apache.hadoop.fs.Path(path + ".next"), jvm.org.apache.hadoop.fs.Path(path + ".old")
    df.write.mode("overwrite").parquet(path + ".next")
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't rename {path}")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't rename {path}.next")
    fs.delete(old, True)


def replace_partitions(df: DataFrame, path: str, by: str = "source_id") -> None:
    """Overwrite only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _partition(spark: SparkSession, path: str, by: str, value: str) -> str:
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, value)
    return f"{path}/{name}"


def drop_partition(spark: SparkSession, path: str, by: str, value: str) -> None:
    fs, folder, _ = _fs(spark, _partition(spark, path, by, value))
    fs.delete(folder, True)


def replace_partition_of(df: DataFrame, path: str, by: str, value: str) -> None:
    """Put df's rows, all of this value, in the place of the partition's; df may read the table. Without rows the
    partition goes."""
    if df.isEmpty():
        drop_partition(df.sparkSession, path, by, value)
    else:
        replace_partitions(df, path, by)


def migrate(spark: SparkSession, source: str, schema: str, target: str, overwrite: bool = False) -> bool:
    """JSON to parquet; a target with rows stays unless overwrite. Says whether it wrote."""
    fs, path, _ = _fs(spark, target)
    if not overwrite and fs.exists(path) and not spark.read.parquet(target).isEmpty():
        return False
    spark.read.schema(schema).json(source, multiLine=True).write.mode("overwrite").parquet(target)
    return True


def npy_header(rows: int, columns: int) -> bytes:
    """The header of a version 1.0 .npy file of half-precision rows, padded to 64 bytes."""
    text = f"{{'descr': '<f2', 'fortran_order': False, 'shape': ({rows}, {columns}), }}"
    total = -(-(10 + len(text) + 1) // 64) * 64
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", total - 10) + text.ljust(total - 11).encode("latin-1") + b"\n"


def npy_bytes(vectors: list[list[float]], columns: int) -> bytes:
    """Short vectors are filled with zeros."""
    import numpy as np

    table = np.zeros((len(vectors), columns), "<f2")
    for i, v in enumerate(vectors):
        table[i, : min(len(v), columns)] = v[:columns]
    out = io.BytesIO()
    out.write(npy_header(*table.shape))
    out.write(table.tobytes())
    return out.getvalue()


def export_index(chunks: DataFrame, vectors: DataFrame, path: str, dimensions: int, dry_run: bool = False, key: str = "row") -> dict:
    """A portable index: manifest.json, chunks as JSON lines and vectors.f16.npy, both ordered by key; returns the manifest."""
    counts = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("documents"), F.countDistinct("file_path", "page").alias("pages"), F.count_if("has_crop_text").alias("cropped")).first().asDict()
    manifest = {"version": 1, "dimensions": dimensions, **counts}
    if not dry_run:
        from docsift.sources.matrices import write_matrix

        spark = chunks.sparkSession
        chunks.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(f"{path}/chunks.jsonl")
        write_matrix(vectors, f"{path}/vectors.f16.npy", dimensions, key)
        spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def with_front_matter(text: Column, **fields: Column) -> Column:
    """Text under a block of `name: JSON` lines."""
    lines = [F.concat(F.lit(f"{n}: "), F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)) for n, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---\n"), text)


def front_matter(text: Column) -> Column:
    """Its lines as a map from name to JSON text; empty without a block."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n?", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(": ")))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1), F.substr(x, F.instr(x, ": ") + 2))))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")


def event_text(name: Column, payload: Column) -> Column:
    """A server-sent event; each line of the payload is a data line."""
    return F.concat(F.lit("event: "), name, F.lit("\n"), F.array_join(F.transform(F.split(payload, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def parsed_events(stream: Column) -> Column:
    """Array of (event, data) from a text of server-sent events."""
    blocks = F.filter(F.split(F.regexp_replace(stream, "\r\n", "\n"), "\n\n"), lambda b: F.trim(b) != "")

    def one(block: Column) -> Column:
        data = F.transform(F.filter(F.split(block, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", ""))
        name = F.regexp_extract(block, r"(?m)^event: ?(.*)$", 1)
        return F.struct(F.when(name == "", "message").otherwise(name).alias("event"), F.array_join(data, "\n").alias("data"))

    return F.transform(blocks, one)
