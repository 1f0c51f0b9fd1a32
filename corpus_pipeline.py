"""A corpus pipeline of five stages, each from docsift.llm.

1. Language ID: rejected documents go. The model is fitted on a bounded sample of the labelled rows of its input; where
   no row is labelled there is no language to be unlike, so all documents stay.
2. SimHash near-duplicates: of each component one row stays, that with the smallest doc_id; null ids come last.
3. Decontamination: documents that hold a window of a benchmark item go.
4. Secrets: found spans are replaced by a mark; n_chars follows.
5. BPE: the documents as token ids, with all their columns but the text.

A null or empty text has no letter (stage 1 drops it), no words (stage 3 keeps it), no secrets and no tokens. Empty tables
give empty results; texts are taken whole whatever their length; repeated rows are near copies of each other. Any extra
column passes through under its name; stage 5 replaces one that is called n_tokens or token_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm import bpe, decontam, langid, secrets, simhash
from docsift.llm.common import read_table, shared_path, shielded, text_or_empty


#: The columns that stages look at; others pass through under names of their own, whatever they are called.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those too unlike every language of the labels. Without labels all stay."""
    model = langid.train(docs.filter(langid.in_sample(F.col("doc_id"))))
    if not model.langs:
        return docs
    return shielded(docs, CORE, lambda df: langid.identify(df, model).filter(~F.col("lang_rejected")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: that with the smallest doc_id, of those the one with the least SHA-256 of its
    text. A row without a doc_id stays if its component has no other."""
    # Ordered like that choice, and the same for rows of one doc_id and text only, so each names one component.
    pick = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.unhex(F.sha2(text_or_empty(F.col("text")), 256)).alias("sha"))
    groups = simhash.near_duplicates(docs.select(pick.alias("_pick"), "text"), "_pick")
    first = groups.filter(F.col("_pick") == F.col("component_id")).select("_pick")
    one = F.row_number().over(Window.partitionBy("_pick").orderBy("text"))
    return shielded(docs, CORE, lambda df: df.withColumn("_pick", pick).withColumn("_one", one).filter("_one = 1").join(first, "_pick", "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark window."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return shielded(docs, CORE, lambda df: decontam.scan_benchmark(df, benchmark, spans=False).filter(F.col("n_hit") == 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; all documents stay."""

    def redacted(df: DataFrame) -> DataFrame:
        out = secrets.scan_versions(df).withColumn("text", secrets.redact(F.col("text"), F.col("findings")))
        if "n_chars" in docs.columns:
            n = F.length("text").cast(docs.schema["n_chars"].dataType)
            out = out.withColumn("n_chars", F.when(F.size("findings") > 0, n).otherwise(F.col("n_chars")))
        return out

    return shielded(docs, CORE, redacted)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers, beside its other columns."""
    made = ("n_tokens", "token_ids")
    own = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    out = bpe.encode_texts(docs.withColumnsRenamed(own))
    kept = [c for c in docs.columns if c != "text" and c not in made]
    return out.select(*(F.col(own[c]).alias(c) for c in kept), *made)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]
#: Character models, SimHash and BPE have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
