"""Vectors, fusion of rankings, hybrid scores, reranking, and the search that composes them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import citations
from docsift.functions.arrays import let
from docsift.functions.text import expand_synonyms, phrase_boost, snippet, tokens
from docsift.functions.vectors import clamp01, dot
from docsift.operators import best, lexical

VECTOR_WEIGHT, LEXICAL_WEIGHT, RRF_K = 0.82, 0.18, 60
VECTOR_TOP, LEXICAL_TOP, FUSED_TOP, RERANK_TOP = 200, 200, 60, 30


def prepare_queries(queries: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    """Add original_terms, terms (with synonyms) and phrase; queries without terms find nothing and go."""
    df = queries.withColumn("original_terms", tokens(F.col(text)))
    df = df.withColumn("terms", expand_synonyms(F.col("original_terms"))).withColumn("phrase", F.lower(F.trim(text)))
    return df.filter(F.size("original_terms") > 0)


def vector_scores(vectors: DataFrame, queries: DataFrame, key: str = "chunk_id", query_key: str = "query_id", max_query_rows: int = 10_000) -> DataFrame:
    """(query_key, key, score > 0) by dot product. vectors: key, vector[, model]; queries: query_key, query_vector[, model].

    The queries are a stated set, sent to the vectors when there are at most max_query_rows of them (counted); else
    they are dealt into blocks of that many, so that each pass sends a bounded block."""
    blocks = max(1, -(-queries.count() // max_query_rows))
    guard = "model" in vectors.columns and "model" in queries.columns
    q = queries.withColumnRenamed("model", "_model") if guard else queries
    out = None
    for i in range(blocks):
        block = q if blocks == 1 else q.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i)
        pairs = vectors.crossJoin(F.broadcast(block))
        pairs = pairs.filter(F.col("model") == F.col("_model")) if guard else pairs
        found = pairs.select(query_key, key, dot(F.col("query_vector"), F.col("vector")).alias("score")).filter("score > 0")
        out = found if out is None else out.unionByName(found)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """The k best of vector_scores, with their rank, chosen inside tasks (`operators/best`). Vectors with a null, a NaN or an
    infinite element are compared one by one."""
    plain = lambda c: F.forall(F.coalesce(c, F.array()), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    v, q = plain(F.col("vector")), plain(F.col("query_vector"))
    found = best.by_vectors(vectors.filter(v), queries.filter(q), k, key, query_key)
    odd = queries.filter(~q)
    found = found.unionByName(vector_scores(vectors.filter(~v), queries, key, query_key))
    if not odd.isEmpty():
        found = found.unionByName(vector_scores(vectors.filter(v), odd, key, query_key))
    return lexical.top_k(found, k, query_key, key)


def rrf(vector: DataFrame, lex: DataFrame, k: int = FUSED_TOP, key: str = "chunk_id", query_key: str = "query_id", rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_key, key, score, rank); one row per chunk of either."""
    none = F.lit(None)
    a = vector.select(query_key, key, F.col("rank").alias("vector_rank"), none.cast("long").alias("lexical_rank"), F.col("score").alias("vector_score"), F.lit(0.0).alias("lexical_score"))
    b = lex.select(query_key, key, none.cast("long").alias("vector_rank"), F.col("rank").alias("lexical_rank"), F.lit(0.0).alias("vector_score"), F.col("score").alias("lexical_score"))
    share = lambda c: F.coalesce(1 / (rrf_k + F.min(c)), F.lit(0.0))
    fused = (
        a.unionByName(b)
        .groupBy(query_key, key)
        .agg(
            F.min("vector_rank").alias("vector_rank"),
            F.min("lexical_rank").alias("lexical_rank"),
            F.max("vector_score").alias("vector_score"),
            F.max("lexical_score").alias("lexical_score"),
            (share("vector_rank") + share("lexical_rank")).alias("rrf_score"),
        )
        .withColumn("existing_score", F.col("vector_score") + F.col("lexical_score"))
        .withColumn("rrf_score", F.round("rrf_score", 12))
        .withColumn("existing_score", F.round("existing_score", 9))
    )
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("rrf_score"), F.desc("existing_score"), F.asc_nulls_last("vector_rank"), F.asc(key)))
    return fused.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def hybrid(fused: DataFrame, query_key: str = "query_id", has_vector: Column | None = None, boost: Column | None = None) -> DataFrame:
    """Add lexical_normalized, vector_normalized, rerank_boost, score and search_mode.

    lexical_score is over the best of the query's candidates; without a query vector it alone counts."""
    most = F.max("lexical_score").over(Window.partitionBy(query_key))
    lex = F.when(most > 0, F.col("lexical_score") / most).otherwise(0.0)
    with_vector = F.lit(True) if has_vector is None else has_vector
    df = fused.withColumns({"lexical_normalized": lex, "vector_normalized": clamp01(F.col("vector_score")), "rerank_boost": F.lit(0.0) if boost is None else boost})
    base = F.when(with_vector, F.col("vector_normalized") * VECTOR_WEIGHT + F.col("lexical_normalized") * LEXICAL_WEIGHT).otherwise(F.col("lexical_normalized"))
    return df.withColumn("score", base + F.col("rerank_boost")).withColumn("search_mode", F.when(with_vector, "hybrid").otherwise("keyword"))


def rerank(ranked: DataFrame, scores: DataFrame, candidates: int = RERANK_TOP, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """Reorder each query's first `candidates` rows by rerank_score; rows without one keep their order behind.

    A query without any score keeps its order, as when the scorer failed."""
    df = ranked.join(scores.select(query_key, key, "rerank_score"), [query_key, key], "left")
    df = df.withColumn("rerank_score", F.when(F.col("rank") <= candidates, F.col("rerank_score")))
    order = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("rerank_score"), F.asc("rank"))
    return df.withColumn("rank", F.row_number().over(order).cast("long"))


def rerank_scores(ranked: DataFrame, scorer: Callable, text: str = "text", max_chars: int = 4000, candidates: int = RERANK_TOP, key: str = "chunk_id", query_key: str = "query_id", query_text: str = "query_text", fail_open: bool = True) -> DataFrame:
    """(query_key, key, rerank_score) by scorer(queries, texts), two Pandas series to one of floats or nulls.

    fail_open: where the scorer raises, its rows have no score, and so keep their order."""
    from pyspark.sql.functions import pandas_udf

    def scored(queries: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return scorer(queries, texts)
        except Exception:
            if not fail_open:
                raise
            return pd.Series([None] * len(texts), dtype="float64")

    udf = pandas_udf(scored, "double")
    first = ranked.filter(F.col("rank") <= candidates)
    return first.select(query_key, key, udf(F.col(query_text), F.substr(text, F.lit(1), F.lit(max_chars))).alias("rerank_score"))


def simple_score(text: Column, terms: Column, phrase: Column) -> Column:
    """The simple score of one text for one query, without a join."""

    def scored(held: Column) -> Column:
        counts = F.transform(terms, lambda t: F.size(F.filter(held, lambda x: x == t)))
        return F.aggregate(counts, F.lit(0.0), lambda a, n: a + F.when(n > 0, 2 + F.log1p(n)).otherwise(0.0))

    return let(tokens(text), scored) + F.when((phrase != "") & F.contains(F.lower(text), phrase), 8.0).otherwise(0.0)


def search(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, limit: int = 8, mode: str = "bm25", scorer: Callable | None = None, source_ids: list[str] | None = None) -> DataFrame:
    """Hybrid search of many queries in one job.

    chunks: chunk_id, text and any of title, path, source_title, source_id, and position columns. queries: query_id,
    query_text[, query_vector]. vectors: chunk_id, vector. Returns the `limit` best per query with scores, snippet
    and citation label."""
    chunks = lexical.in_scope(chunks, source_ids=source_ids)
    q = prepare_queries(queries)
    lex = lexical.lexical_candidates(chunks, q, mode, LEXICAL_TOP)
    if vectors is not None:
        scoped = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        vec = nearest(scoped, q.filter("query_vector is not null").select("query_id", "query_vector"), VECTOR_TOP)
    else:
        vec = lex.limit(0)
    fused = rrf(vec, lex)
    columns = ["query_id", "query_text", "original_terms"] + (["query_vector"] if vectors is not None else [])
    full = fused.join(chunks, "chunk_id").join(q.select(*columns, "terms", "phrase"), "query_id")
    # Candidates that only the vectors found have the simple score, beside the others' BM25.
    full = full.withColumn("lexical_score", F.when(F.col("lexical_rank").isNull(), simple_score(F.col("text"), F.col("terms"), F.col("phrase"))).otherwise(F.col("lexical_score"))).drop("rank")
    has_vector = F.col("query_vector").isNotNull() if vectors is not None else F.lit(False)
    scored = hybrid(full, has_vector=has_vector, boost=phrase_boost(F.col("text"), F.col("original_terms"))).filter("score > 0")
    ranked = lexical.top_k(scored, max(limit, RERANK_TOP), digits=9)
    if scorer is not None:
        ranked = rerank(ranked, rerank_scores(ranked, scorer))
        ranked = ranked.withColumn("search_mode", F.when(F.col("rerank_score").isNotNull(), F.concat("search_mode", F.lit("+rerank"))).otherwise(F.col("search_mode")))
    first = ranked.filter(F.col("rank") <= limit)
    keep = [c for c in ("source_id", "title", "path", "source_title") if c in chunks.columns]
    return first.select(
        "query_id",
        "rank",
        "chunk_id",
        *keep,
        *(F.round(c, 3).alias(c) for c in ("score", "vector_score", "lexical_score", "lexical_normalized", "rerank_boost")),
        "vector_rank",
        "lexical_rank",
        "search_mode",
        citations.label_of(first).alias("citation_label"),
        snippet(F.col("text"), F.col("query_text")).alias("snippet"),
    )


def metrics(ranks: DataFrame, rank: str = "rank", ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Recall at each k and the mean reciprocal rank, over rows with the rank of the first hit or null."""
    r = F.col(rank)
    hits = [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n_cases"), *hits, F.avg(F.when(r.isNotNull(), 1.0 / r).otherwise(0.0)).alias("mrr"))
