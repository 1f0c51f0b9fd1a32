"""Conversions kept by content: equal bytes are converted once by a version of a converter, whatever files hold them.

A text's address is the SHA-256 and length of the bytes, the extension and the converter's name and version. Addresses are
taken natively; only the contents of one file of each unseen address go to the converter. Kept texts are rows of a table,
one folder for each converter version, to which runs append. Two runs that convert the same content at once add a row each
and readers take one. A failure is an error row of every file with those bytes; it is
stored with its run but doesn't count as kept: the next run tries again.

Defined results: rows without content have the error `no content`; rows of one key with different contents are converted each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import shared_root
from docsift.sources import readers

KEPT = "address string, markdown string, error string, run string"


class Conversions:
    """The conversions in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, version: str) -> str:
        return f"{self.folder}/{hashlib.sha256(version.encode()).hexdigest()[:24]}"

    def kept(self, version: str) -> DataFrame:
        """(address, markdown) of a converter version, each address once."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(KEPT).parquet(self._path(version))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], KEPT).select("address", "markdown")
        return rows.filter("error is null").groupBy("address").agg(F.min("markdown").alias("markdown"))

    def _staged(self, df: DataFrame) -> DataFrame:
        path = f"{shared_root(self.spark)}/docsift/conversions-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def convert(self, files: DataFrame, converter: Callable[[str, bytes], str], version: str, key: str = "file_id", load: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(key, markdown, error, fresh) of files; fresh says that this file's content went to the converter now.

        load opens contents: rows (key, extension, ...) to (key, extension, content). Without it, files have theirs. New texts are kept when this returns. Contents are read to take their addresses, and those of chosen files once
        more; they are never shuffled where `load` opens files by path."""
        opened = load or (lambda rows: rows)
        address = F.concat_ws(":", F.sha2("content", 256), F.length("content"), F.col("extension"))
        seen = self._staged(opened(files).select(key, "extension", F.when(F.col("content").isNotNull(), address).alias("address")))
        known = self.kept(version)
        unseen = seen.filter("address is not null").join(known.select("address"), "address", "left_anti")
        chosen = self._staged(unseen.groupBy("address").agg(F.min(key).alias(key)))
        wanted = files.join(chosen.select(key).distinct(), key, "left_semi")
        # The address goes along as the key, so that a file with other contents under its key can't answer for it.
        addressed = opened(wanted).filter("content is not null").withColumn("address", address)
        run = uuid.uuid4().hex
        readers.convert(addressed, converter, "address").withColumn("run", F.lit(run)).write.mode("append").parquet(self._path(version))
        made = self.spark.read.schema(KEPT).parquet(self._path(version)).filter(F.col("run") == run).dropDuplicates(["address"])
        texts = made.select("address", "markdown", "error").unionByName(known.join(made.select("address"), "address", "left_anti").withColumn("error", F.lit(None).cast("string")))
        now = chosen.select("address", F.col(key).alias("_chosen"))
        df = seen.join(texts, "address", "left").join(now, "address", "left")
        error = F.when(F.col("address").isNull(), "no content").otherwise(F.col("error"))
        return df.select(key, "markdown", error.alias("error"), F.coalesce(F.col("_chosen") == F.col(key), F.lit(False)).alias("fresh"))
