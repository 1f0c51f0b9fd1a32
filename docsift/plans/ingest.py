"""Indexing a source: scan, skip what is unchanged, convert, convert again what came out badly, verify, cut into chunks,
replace the source's partitions, embed. And the index's vectors, kept up to date in the same way.

An index is a store of versions (sources/snapshots.py) of the tables files, chunks and vectors, each in one part for
each source. What a run computes is first written to the shared folder, so that no file is converted twice; then files and
chunks of the source become one new version, so that readers never see one without the other, and a run that dies leaves
the version before. Of two runs over one source at once, the later one is told of the conflict."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.paths import base_name
from docsift.functions.text import normalize_text
from docsift.operators import chunking, embedding, maintenance, quality
from docsift.session import shared_root
from docsift.sources import readers
from docsift.sources.conversions import Conversions
from docsift.sources.snapshots import Snapshots

_QUALITY = "struct<status:string,score:int,warnings:array<string>,chars:int,words:int,chunks:int>"
_RETRY = "struct<retried:boolean,status:string,reasons:array<string>,improved:boolean>"
FILES = f"file_id string, path string, relative_path string, title string, extension string, mtime_ms long, size long, error string, quality {_QUALITY}, reindex {_RETRY}, source_id string"
CHUNKS = "chunk_id string, file_id string, path string, title string, chunk_index int, text string, page_start int, page_end int, sheet_name string, section_title string, source_id string"
VECTORS = "chunk_id string, model string, text_hash string, vector array<float>, source_id string"
TABLES = {"files": FILES, "chunks": CHUNKS, "vectors": VECTORS}


@dataclass(frozen=True)
class Run:
    """What a run did: files of the scan by what became of them, and the chunks that the source has now."""

    files: int
    new: int
    changed: int
    unchanged: int
    gone: int
    failed: int
    retried: int
    chunks: int


def store(spark: SparkSession, index: str) -> Snapshots:
    return Snapshots(spark, index)


def read_index(spark: SparkSession, index: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the index, in its latest version or the given one; no rows where there is none yet."""
    return store(spark, index).read(table, TABLES[table], version)


def _of_source(spark: SparkSession, index: str, table: str, version: int, source_id: str) -> DataFrame:
    return store(spark, index).read(table, TABLES[table], version, [source_id])


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/docsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def judged(texts: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, markdown, error, quality, pieces) of converted texts (key, markdown, error).

    pieces are the chunks of the text, none for a file whose conversion failed or whose text is suppressed for noise; the
    quality says so."""
    body = F.coalesce("markdown", F.lit(""))
    df = texts.withColumn("_text", body).withColumn("pieces", chunking.pack(normalize_text(F.col("_text"))))
    df = df.withColumns({"_n": F.size("pieces"), "_how": F.struct(F.when(F.col("error").isNotNull(), "conversion-error").otherwise("text").alias("method"))})
    df = quality.verify(df, "_text", "_n", "_how", "_quality").withColumn("quality", quality.suppressed(F.col("_quality")).cast(_QUALITY))
    none = F.array().cast("array<string>")
    return df.withColumn("pieces", F.when(F.col("quality.chunks") > 0, F.col("pieces")).otherwise(none)).select(key, "markdown", "error", "quality", "pieces")


def retried(first: DataFrame, again: DataFrame, key: str = "file_id") -> DataFrame:
    """first, with the rows of a second conversion in the place of theirs; one that failed changes nothing but the report."""
    second = again.select(key, *(F.col(c).alias(f"_{c}") for c in ("markdown", "error", "quality", "pieces")))
    df = first.join(second, key, "left")
    tried, failed = F.col("_quality").isNotNull(), F.col("_error").isNotNull()
    report = quality.retry_report(F.col("quality"), F.col("_quality"), failed)
    reindex = F.when(tried, F.struct(F.lit(True).alias("retried"), report["status"].alias("status"), report["final_reasons"].alias("reasons"), report["improved"].alias("improved")))
    columns = [F.when(tried & ~failed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("markdown", "error", "quality", "pieces")]
    return df.select(key, *columns, reindex.cast(_RETRY).alias("reindex"))


#: Files whose contents are read in one go; their paths go through the driver, as those of any listing do.
PATHS = 5_000


def _contents(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """(file_id, extension, content) of wanted files, opened by path, so that no other file is read."""
    rows = wanted.select("path", "file_id", "extension")
    blocks = max(1, -(-rows.count() // PATHS))
    out = None
    for i in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("path"), F.lit(blocks)) == i)
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in block.collect()]  # names that look like patterns
        if paths:
            files = spark.read.format("binaryFile").load(paths).select("path", "content").join(F.broadcast(block), "path").select("file_id", "extension", "content")
            out = files if out is None else out.unionByName(files)
    return out if out is not None else rows.select("file_id", "extension", F.lit(b"").alias("content")).limit(0)


def index_source(
    spark: SparkSession,
    index: str,
    source_id: str,
    roots: list[str],
    converter: Callable[[str, bytes], str] = readers.to_markdown,
    second: Callable[[str, bytes], str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    force: bool = False,
    conversions: Conversions | None = None,
    versions: tuple[str, str] = ("", ""),
) -> dict[str, int]:
    """Bring the index's files and chunks of a source up to date, and say what was done.

    Unchanged files (time and size) keep their rows unless force. A file whose conversion fails has a row with the error
    and no chunks, and is tried again by the next run. With `second`, files that came out badly are converted once more.
    Files that are gone lose their rows. With `conversions`, equal contents are converted once by the converters that
    `versions` name, in any source."""
    if conversions is not None and not all(versions[: 1 if second is None else 2]):
        raise ValueError("kept conversions need the names and versions of their converters")

    def convert(rows: DataFrame, how: Callable[[str, bytes], str], version: str) -> DataFrame:
        load = partial(_contents, spark)
        return readers.convert(load(rows), how) if conversions is None else conversions.convert(rows, how, version, load=load).drop("fresh")

    own, writer = F.lit(source_id), store(spark, index).begin()
    base = writer.base.number
    scan = readers.classified(readers.scan_folders(spark, roots), include, exclude).filter(F.col("reason") == "eligible")
    scan = staged(readers.with_ids(scan, own).withColumn("title", base_name(F.col("path"))), "scan")
    manifest = _of_source(spark, index, "files", base, source_id)
    known = manifest.filter("error is null")
    actions = maintenance.file_actions(scan, known.limit(0) if force else known)
    actions = staged(actions, "actions")
    todo = scan.join(actions.filter(F.col("action").isin("new", "changed")), "file_id")

    first = staged(judged(convert(todo, converter, versions[0])), "converted")
    done = first.withColumn("reindex", F.lit(None).cast(_RETRY))
    if second is not None:
        queued = first.filter(quality.retry_decision(F.col("quality"), F.lit(False), F.lit(0))["queued"])
        again = judged(convert(scan.join(queued.select("file_id"), "file_id"), second, versions[1]))
        done = staged(retried(first, again), "retried")

    facts = todo.select("file_id", "path", "relative_path", "title", "extension", "mtime_ms", "size").join(done, "file_id").withColumn("source_id", own)
    places = chunking.placed(facts.select("file_id", "path", "title", "source_id", F.posexplode("pieces").alias("chunk_index", "chunk_text")), "file_id")
    places = places.withColumnRenamed("chunk_text", "text").withColumn("chunk_id", F.concat_ws(":", "file_id", F.col("chunk_index").cast("string")))
    kept = actions.filter("action = 'unchanged'").select("file_id")
    chunks = _of_source(spark, index, "chunks", base, source_id)
    writer.replace("chunks", chunks.join(kept, "file_id", "left_semi").select(*chunks.columns).unionByName(places.select(*chunks.columns)), source_id)
    writer.replace("files", manifest.join(kept, "file_id", "left_semi").select(*manifest.columns).unionByName(facts.select(*manifest.columns)), source_id)
    made = writer.commit(action="index", source_id=source_id)

    by = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    after = _of_source(spark, index, "files", made.number, source_id)
    ends = after.agg(F.count("*").alias("files"), F.count("error").alias("failed"), F.count_if("reindex.retried").alias("retried"), F.coalesce(F.sum("quality.chunks"), F.lit(0)).alias("chunks")).first()
    return asdict(Run(ends["files"], by.get("new", 0), by.get("changed", 0), by.get("unchanged", 0), by.get("gone", 0), ends["failed"], ends["retried"], ends["chunks"]))


def embed_source(spark: SparkSession, index: str, source_id: str, embedder: Callable, model: str, native: bool = False, batch: int = embedding.BATCH) -> dict[str, int]:
    """Embed the chunks of a source that have no vector of this model and text; vectors of chunks that are gone go."""
    writer = store(spark, index).begin()
    chunks, cached = (_of_source(spark, index, t, writer.base.number, source_id) for t in ("chunks", "vectors"))
    known = embedding.with_cached(chunks.select("chunk_id", "text"), cached, model)
    fresh = staged(embedding.embedded(known.filter("vector is null"), embedder, model, native=native, batch=batch), "vectors")
    old = known.filter("vector is not null").select("chunk_id", F.lit(model).alias("model"), "text_hash", "vector")
    rows = old.unionByName(fresh).withColumn("source_id", F.lit(source_id))
    writer.replace("vectors", rows, source_id)
    made = writer.commit(action="embed", source_id=source_id)
    total, new = chunks.count(), fresh.count()
    stored = _of_source(spark, index, "vectors", made.number, source_id).count()
    return {"chunks": total, "embedded": new, "cached": stored - new, "pending": total - stored}


def remove_source(spark: SparkSession, index: str, source_id: str) -> None:
    """Drop the source from every table of the index, at once."""
    writer = store(spark, index).begin()
    for table in TABLES:
        writer.drop(table, source_id)
    writer.commit(action="remove", source_id=source_id)
