"""Shared parts of the registered queries: table access, roles of the test tables, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries of a vector search: rows whose id is divisible by this.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the role of chunks: chunk_id, text, source_title."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("source_title"), F.col("source").alias("source_id"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in the role of queries: query_id, query_text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query_text"))


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_-]+'), lambda t: length(t) > 1)"


def normalized_sql(text: str) -> str:
    """Normalised text, for texts without no-break spaces at their ends."""
    step = f"regexp_replace(regexp_replace(coalesce({text}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({step}, '\\n{{4,}}', repeat(chr(10), 3), 'g'), '^\\s+|\\s+$', '', 'g')"


#: BM25 parts of documents (text, and source under its boost) for the terms of benchmark items.
BM25_SQL = f"""
d AS (SELECT doc_id, {tokens_sql('text')} AS tt, {tokens_sql('source')} AS st FROM documents),
docs AS (SELECT doc_id, tt, st, greatest(1, len(tt) + len(st)) AS doc_len FROM d),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM docs),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark),
t AS (SELECT DISTINCT term FROM q),
p AS (SELECT doc_id, term, sum(w) AS tf, any_value(doc_len) AS doc_len FROM (
    SELECT doc_id, doc_len, unnest(tt) AS term, 1.0 AS w FROM docs UNION ALL SELECT doc_id, doc_len, unnest(st), 1.7 FROM docs) JOIN t USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
parts AS (SELECT doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS part FROM p JOIN df USING (term), stats),
scored AS (SELECT query_id, doc_id AS chunk_id, round(sum(part), 6) AS score FROM parts JOIN q USING (term) GROUP BY ALL HAVING sum(part) > 0)"""

VECTOR_SQL = f"""
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % {EVERY} = 0),
vs AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(qe, embedding::DOUBLE[]), 6) AS score FROM embeddings, qv WHERE list_dot_product(qe, embedding::DOUBLE[]) > 0)"""
