"""Incremental embedding: only chunks without a vector of the same model and text go to the embedder.

An embedder is a function from a pandas series of texts to one of vectors, called with a bounded batch; hashed_vector is
a native stand-in for tests and for runs without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.arrays import let
from docsift.functions.text import tokens
from docsift.functions.vectors import unit

#: Fixed value: texts of one call.
BATCH = 64


def text_hash(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))


def hashed_vector(text: Column, dimensions: int = 16) -> Column:
    """Counts of tokens by the first 16 bits of their MD5, over the vector's length; empty for a text without tokens."""
    bucket = lambda t: (F.conv(F.substr(F.md5(t), F.lit(1), F.lit(4)), 16, 10).cast("int") % dimensions).cast("string")
    # Buckets as one string ",3,,12,,3,": a count is what the string loses by its bucket, far cheaper than a lambda for each token.
    marks = F.concat(F.lit(","), F.array_join(F.transform(tokens(text), bucket), ",,"), F.lit(","))
    mark = lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))
    lost = lambda m, i: (F.octet_length(m) - F.octet_length(F.replace(m, mark(i), F.lit("")))) / F.octet_length(mark(i))
    return let(let(marks, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: lost(m, i))), unit)


def with_cached(chunks: DataFrame, cached: DataFrame, model: str, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunks with text_hash, and the vector that the cache has for this chunk, model and text, else null."""
    known = cached.filter((F.col("model") == model) & (F.size("vector") > 0)).groupBy(key, "text_hash").agg(F.first("vector").alias("vector"))
    return chunks.withColumn("text_hash", text_hash(F.col(text))).join(known, [key, "text_hash"], "left")


def embedded(chunks: DataFrame, embedder: Callable[[pd.Series], pd.Series] | Callable[[Column], Column], model: str, key: str = "chunk_id", text: str = "text", batch: int = BATCH, native: bool = False) -> DataFrame:
    """(key, model, text_hash, vector) of chunks that have none. Empty vectors give no row, so those chunks stay pending.

    native: embedder is a function of a column and runs without Python. An embedder that raises ends the job."""
    rows = chunks.select(key, F.lit(model).alias("model"), text_hash(F.col(text)).alias("text_hash"), F.coalesce(text, F.lit("")).alias("_text"))
    if native:
        # Exploded, as a filter on the vector would be pushed below it and compute it twice.
        vector = F.filter(F.array(embedder(F.col("_text")).cast("array<float>")), lambda v: F.size(v) > 0)
        return rows.select(key, "model", "text_hash", F.explode(vector).alias("vector"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].reset_index(drop=True)
                vectors = pd.Series(list(embedder(part.pop("_text")))).reindex(part.index)
                part["vector"] = vectors
                yield part[[v is not None and hasattr(v, "__len__") and len(v) > 0 for v in vectors]]

    kind = chunks.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"{key} {kind}, model string, text_hash string, vector array<float>")


def embedding_plan(chunks: DataFrame, cached: DataFrame, model: str, by: str = "source_id") -> DataFrame:
    """Per source: chunks, those cached and those pending."""
    df = with_cached(chunks, cached, model)
    return df.groupBy(by).agg(F.count("*").alias("chunks"), F.count("vector").alias("cached"), F.count_if(F.col("vector").isNull()).alias("pending"))
