"""Lexical search of many requests at once, each within sources of its own.

A request's scope is a relation (request, source); a request that has no row there searches all sources. Requests with the
same sources share a scope. BM25's statistics are those of the scope: they are counted by source and term once, for all
requests, and summed over each scope's sources, so the chunks are read once however many scopes there are. A posting
is scored once for each scope, and goes to the requests of that scope that have its term. All joins are on (source, term) or
(scope, term).

Null sources of chunks are a source of their own, that only requests without a scope search. Requests without terms find nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators import lexical
from docsift.operators.best import by_terms
from docsift.session import checkpointed

EVERYWHERE = ""


def with_scopes(requests: DataFrame, scopes: DataFrame, query_key: str = "query_id", source: str = "source_id") -> DataFrame:
    """Add scope, a name of the request's sources (EVERYWHERE without any), and sources, in order."""
    own = scopes.filter(F.col(source).isNotNull()).groupBy(F.col(query_key).alias("_request")).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    joined = requests.join(own, F.col(query_key) == F.col("_request"), "left").drop("_request")
    name = F.sha2(F.to_json(F.struct("sources")), 256)
    return joined.withColumn("scope", F.when(F.size("sources") > 0, name).otherwise(F.lit(EVERYWHERE)))


def bm25(chunks: DataFrame, requests: DataFrame, scopes: DataFrame, key: str = "chunk_id", query_key: str = "query_id", source: str = "source_id", fields: dict[str, float] | None = None, k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
    """(query_key, key, score > 0) of every chunk in the request's scope that shares a term with it. requests: query_key, terms."""
    parts, wanted = _parts(chunks, requests, scopes, key, query_key, source, fields, k1, b)
    return parts.join(wanted, "term").groupBy(query_key, key).agg(F.sum("part").alias("score")).filter("score > 0")


def _parts(chunks: DataFrame, requests: DataFrame, scopes: DataFrame, key: str, query_key: str, source: str, fields: dict[str, float] | None = None, k1: float = lexical.K1, b: float = lexical.B) -> tuple[DataFrame, DataFrame]:
    """(key, term, part) and (query_key, term), a term being that of a scope: the scope, a blank, the term."""
    scoped = checkpointed(with_scopes(requests, scopes, query_key, source))
    wanted = lexical.query_terms(scoped, query_key).join(scoped.select(query_key, "scope"), query_key)
    at = F.struct(F.col(source).cast("string").alias("source"), F.col(key).alias("key"))
    post = lexical.postings(lexical.tokenized(chunks, fields).withColumn("_at", at), wanted, "_at", fields)
    post = post.select(F.col("_at")["key"].alias(key), F.coalesce(F.concat(F.lit("="), F.col("_at")["source"]), F.lit("")).alias("_source"), "term", "tf", "doc_len")
    post = checkpointed(post)  # a row for each chunk and term that a request has
    counts = post.groupBy("_source", "term").agg(F.count("*").alias("n"), F.sum("doc_len").alias("len"))
    # Which sources each scope has, and of those which terms its requests ask for; the empty term stands once in each chunk.
    everywhere = counts.filter("term = ''").select(F.lit(EVERYWHERE).alias("scope"), "_source")
    listed = scoped.filter(F.col("scope") != EVERYWHERE).dropDuplicates(["scope"]).select("scope", F.explode("sources").alias("_s")).select("scope", F.concat(F.lit("="), F.col("_s").cast("string")).alias("_source"))
    members = everywhere.unionByName(listed)
    terms = wanted.select("scope", "term").distinct()
    sums = members.join(counts.filter("term = ''"), "_source").groupBy("scope").agg(F.sum("n").alias("n_docs"), (F.sum("len") / F.sum("n")).alias("avg_len"))
    asked = terms.join(members, "scope")
    df = asked.join(counts, ["_source", "term"]).groupBy("scope", "term").agg(F.sum("n").alias("df"))
    stats = df.join(sums, "scope")
    part = lexical.idf(F.col("n_docs"), F.col("df")) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    parts = post.filter("term <> ''").join(asked.join(stats, ["scope", "term"]), ["_source", "term"])
    scoped_term = F.concat_ws(" ", "scope", "term").alias("term")
    return parts.select(key, scoped_term, part.alias("part")), wanted.select(query_key, scoped_term)


def search(chunks: DataFrame, requests: DataFrame, scopes: DataFrame, key: str = "chunk_id", query_key: str = "query_id", source: str = "source_id", limit: str = "top_k") -> DataFrame:
    """(query_key, key, score, rank): each request's best chunks, as many as its column limit says; ties by key."""
    most = requests.agg(F.max(limit)).first()[0] or 0
    if most < 1:
        most = 1  # no row is within the limits
    parts, wanted = _parts(chunks, requests, scopes, key, query_key, source)
    found = lexical.top_k(by_terms(parts, wanted, int(most), key, query_key), int(most), query_key, key)
    return found.join(requests.select(query_key, limit), query_key).filter(F.col("rank") <= F.col(limit)).drop(limit)


def resolved(requests: DataFrame, sources: DataFrame, members: DataFrame | None = None, query_key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(query_key, status, source_id) of requests (query_key, query_text, source), and their scopes (query_key, source_id).

    A source is named by its id, else by its title or its folder's name, whatever the case; of several the one with the least id.
    Status: 400 without a text, 404 if nothing has the name, else 200. members: (source_id, member_id), what a source's scope
    holds; a source alone by default. A request that names no source has no scope."""
    from docsift.functions.paths import base_name

    folded = lambda c: F.lower(F.replace(F.trim(c), F.lit("\\"), F.lit("/")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    named = requests.select(query_key, F.trim("source").alias("_id"), folded(F.col("source")).alias("_name"), blank(F.col("query_text")).alias("_empty"), blank(F.col("source")).alias("_any"))
    names = F.array_distinct(F.array_compact(F.array(F.struct(F.lit(0).alias("tier"), F.col("source_id").alias("name")), F.when(~blank(F.col("title")), F.struct(F.lit(1).alias("tier"), folded(F.col("title")).alias("name"))), F.when(~blank(F.col("path")), F.struct(F.lit(1).alias("tier"), folded(base_name(F.col("path"))).alias("name"))))))
    known = sources.select("source_id", F.inline(names)).groupBy("tier", "name").agg(F.min("source_id").alias("found"))
    asked = named.filter("NOT _any").select(query_key, F.inline(F.array(F.struct(F.lit(0).alias("tier"), F.col("_id").alias("name")), F.struct(F.lit(1).alias("tier"), F.col("_name").alias("name")))))
    best = asked.join(known, ["tier", "name"]).groupBy(F.col(query_key).alias("_q")).agg(F.min(F.struct("tier", "found")).alias("m"))
    out = named.join(best, F.col(query_key) == F.col("_q"), "left").select(
        query_key,
        F.when(F.col("_empty"), 400).when(~F.col("_any") & F.col("m").isNull(), 404).otherwise(200).alias("status"),
        F.when(~F.col("_empty"), F.col("m")["found"]).alias("source_id"),
    )
    own = out.filter("status = 200 AND source_id IS NOT NULL").select(query_key, "source_id")
    scopes = own if members is None else own.join(members, "source_id").select(query_key, F.col("member_id").alias("source_id")).unionByName(own).distinct()
    return out, scopes
