"""BM25 and simple lexical scores of chunks for many queries at once.

Statistics (document frequency, mean length) are those of the chunks given, so a scope is filtered first. Terms
that no query has are dropped within the array of a chunk's tokens, before anything is exploded or shuffled: what
travels is one row for each chunk and query term that it holds. The queries are a stated set whose distinct terms are
counted: up to MAX_TERMS of them are a set within the plan, more are joined. Texts are read once for a score:
frequencies, statistics and scores all start from one exchange of these rows by chunk and term, so that a term which
most chunks hold has its rows on many tasks; what is looked up by term is a table of the queries' terms.

bm25 and simple_scores give every scored pair; bm25_top and simple_top only the k best of each query, which tasks choose
from the chunks that they hold (`operators/best`), so that their pairs are never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import tokens
from docsift.operators.best import by_terms

K1, B = 1.2, 0.75
BOOSTS = {"text": 1.0, "title": 2.2, "path": 1.2, "source_title": 1.7}


def query_terms(queries: DataFrame, key: str = "query_id", terms: str = "terms") -> DataFrame:
    """(key, term): each query's distinct lower-case terms."""
    low = F.filter(F.transform(F.col(terms), lambda t: F.lower(t)), lambda t: t != "")
    return queries.select(key, F.explode(F.array_distinct(low)).alias("term"))


def tokenized(chunks: DataFrame, fields: dict[str, float] | None = None) -> DataFrame:
    """Add _tokens_<field> for each field present, and doc_len, their unboosted count (1 at least)."""
    fields = {f: b for f, b in (fields or BOOSTS).items() if f in chunks.columns}
    df = chunks.withColumns({f"_tokens_{f}": tokens(F.col(f)) for f in fields})
    total = F.lit(0)
    for f in fields:
        total = total + F.size(f"_tokens_{f}")
    return df.withColumn("doc_len", F.greatest(F.lit(1), total).cast("long"))


#: Distinct terms of the queries that may be a set in the plan.
MAX_TERMS = 20_000


def _among(terms: DataFrame) -> tuple[str, ...] | None:
    """The distinct terms, or None if there are more than MAX_TERMS."""
    rows = terms.select("term").distinct().limit(MAX_TERMS + 1).collect()  # bounded
    return tuple(sorted(r["term"] for r in rows)) if len(rows) <= MAX_TERMS else None


def postings(chunks: DataFrame, terms: DataFrame, key: str = "chunk_id", fields: dict[str, float] | None = None) -> DataFrame:
    """(key, doc_len, term, tf): boosted frequencies of the terms (column term) in tokenised chunks, and for each chunk a
    row with the empty term, which no token is, so that statistics of all chunks can be told from these rows."""
    fields = {f: b for f, b in (fields or BOOSTS).items() if f"_tokens_{f}" in chunks.columns}
    few = _among(terms)
    known = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in few or ("",))
    wanted = lambda c: F.col(c) if few is None else F.expr(f"filter(`{c}`, t -> t IN ({known}))")
    # Never null, so that no test for nulls parts the uses of the exchange.
    entry = lambda w: lambda t: F.struct(F.coalesce(t, F.lit("")).alias("term"), F.lit(w).alias("w"))
    tagged = [F.transform(wanted(f"_tokens_{f}"), entry(float(b))) for f, b in fields.items()]
    rows = chunks.select(key, "doc_len", F.inline(F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w"))), *tagged)))
    if few is None:
        rows = rows.join(terms.select("term").unionByName(terms.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.sum("w").alias("tf"), F.first("doc_len").alias("doc_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def term_statistics(post: DataFrame) -> DataFrame:
    """(term, df, n_docs, avg_len) of the queries' terms, and of the empty term, from postings.

    One aggregate gives all: the empty term stands once in each chunk. It names all columns of the postings, so that it
    reads the exchange that scores read too. The window is over as many rows as the queries have terms."""
    counted = post.groupBy("term").agg(F.count_if((F.col("tf") >= 0) & (F.col("doc_len") > 0)).alias("df"), F.avg("doc_len").alias("_len"))
    all_, own = Window.partitionBy(), F.col("term") == ""
    return counted.select("term", "df", F.coalesce(F.max(F.when(own, F.col("df"))).over(all_), F.lit(0)).alias("n_docs"), F.max(F.when(own, F.col("_len"))).over(all_).alias("avg_len"))


def _parts(post: DataFrame, key: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, term, part): each posting's share of a BM25 score."""
    part = idf(F.col("n_docs"), F.col("df")) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return post.join(term_statistics(post), "term").select(key, "term", part.alias("part"))


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", query_key: str = "query_id", fields: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_key, key, score > 0) of every chunk that shares a term with a query. queries: query_key, terms."""
    wanted = query_terms(queries, query_key)
    post = postings(tokenized(chunks, fields), wanted, key, fields)
    return _scored(_parts(post, key, k1, b), wanted, key, query_key)


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", fields: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """The k best of bm25, with their rank; the queries' terms are read when this is called."""
    wanted = query_terms(queries, query_key)
    post = postings(tokenized(chunks, fields), wanted, key, fields)
    return top_k(by_terms(_parts(post, key, k1, b), wanted, k, key, query_key), k, query_key, key)


def _scored(parts: DataFrame, wanted: DataFrame, key: str, query_key: str) -> DataFrame:
    return parts.join(wanted, "term").groupBy(query_key, key).agg(F.sum("part").alias("score")).filter("score > 0")


def simple_scores(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", query_key: str = "query_id", text: str = "text", phrase: str | None = "phrase") -> DataFrame:
    """(query_key, key, score > 0): 2 + ln(1 + count) for each query term held, and 8 if the text holds the phrase.

    Chunks that hold the phrase without any whole term aren't looked for: a phrase of words implies its terms. Within a
    phrase that a text holds all terms but the first and the last are whole tokens of the text, so only chunks with all
    but two of them are compared with the phrase, and only their texts travel."""
    held, wanted = _simple_parts(chunks, queries, key, query_key, text, phrase)
    both = held.join(wanted, "term")
    if phrase is None:
        return both.groupBy(query_key, key).agg(F.sum("part").alias("score"))
    scored = both.groupBy(query_key, key).agg(F.sum("part").alias("score"), (F.sum("_mine") >= F.first("_n") - 2).alias("_near"))
    near = _with_phrase(scored.filter("_near"), chunks, queries, key, query_key, text, phrase)
    return scored.filter("not _near").select(query_key, key, "score").unionByName(near.select(query_key, key, (F.col("score") + F.when(F.col("_held"), 8.0).otherwise(0.0)).alias("score")))


def _simple_parts(chunks: DataFrame, queries: DataFrame, key: str, query_key: str, text: str, phrase: str | None) -> tuple[DataFrame, DataFrame]:
    """(key, term, part), and the queries' terms, with a phrase told whether they are of it and how many it has."""
    docs = chunks.withColumn("_tokens_text", tokens(F.col(text))).withColumn("doc_len", F.lit(1))
    wanted = query_terms(queries, query_key)
    if phrase is not None:
        own = queries.select(query_key, F.array_distinct(tokens(F.col(phrase))).alias("_own"))
        wanted = wanted.join(own, query_key).select(query_key, "term", F.array_contains("_own", F.col("term")).cast("int").alias("_mine"), F.size("_own").alias("_n"))
    return postings(docs, wanted, key, {"text": 1.0}).filter("term <> ''").select(key, "term", (2 + F.log1p("tf")).alias("part")), wanted


def _with_phrase(near: DataFrame, chunks: DataFrame, queries: DataFrame, key: str, query_key: str, text: str, phrase: str) -> DataFrame:
    """Rows of near with _held: whether the chunk's text holds the query's phrase."""
    texts = chunks.select(key, F.lower(F.col(text)).alias("_low"))
    met = near.join(texts, key).join(queries.select(query_key, F.lower(F.trim(phrase)).alias("_phrase")), query_key)
    return met.withColumn("_held", (F.col("_phrase") != "") & F.contains("_low", F.col("_phrase"))).drop("_low", "_phrase")


def simple_top(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", text: str = "text", phrase: str | None = "phrase") -> DataFrame:
    """The k best of simple_scores, with their rank: the k best without regard to phrases, and every chunk that holds one."""
    held, wanted = _simple_parts(chunks, queries, key, query_key, text, phrase)
    if phrase is None:
        return top_k(by_terms(held, wanted, k, key, query_key), k, query_key, key)
    found = by_terms(held, wanted, k, key, query_key, near=True)
    bonus = _with_phrase(found.filter("_near"), chunks, queries, key, query_key, text, phrase).filter("_held").select(query_key, key, (F.col("score") + 8.0).alias("score"))
    both = found.filter("not _near").select(query_key, key, "score").unionByName(bonus).groupBy(query_key, key).agg(F.max("score").alias("score"))
    return top_k(both, k, query_key, key)


def lexical_candidates(chunks: DataFrame, queries: DataFrame, mode: str = "bm25", k: int = 200, key: str = "chunk_id", query_key: str = "query_id", text: str = "text", block: int = 10_000) -> DataFrame:
    """Top k by BM25; queries that it finds nothing for fall back to the simple score, one by one.

    BM25 finds nothing only if no chunk has any of a query's terms, and then the simple score is that of the phrase
    within longer words: those queries are looked for in every text, the others aren't. The queries are a stated set,
    counted and dealt into blocks, of which each sends its lost ones to the texts; a block without any reads none."""
    if mode != "bm25":
        return simple_top(chunks, queries, k, key, query_key, text)
    wanted = query_terms(queries, query_key)
    post = postings(tokenized(chunks), wanted, key)
    best = by_terms(_parts(post, key), wanted, k, key, query_key)
    if "phrase" not in queries.columns:
        return top_k(best, k, query_key, key)
    known = wanted.join(term_statistics(post), "term", "left_semi").select(query_key).distinct()
    lost = queries.select(query_key, F.lower(F.trim("phrase")).alias("_phrase")).filter("_phrase <> ''").join(known, query_key, "left_anti")
    texts, blocks = chunks.select(key, F.lower(F.col(text)).alias("_low")), max(1, -(-queries.count() // block))
    for i in range(blocks):
        part = lost if blocks == 1 else lost.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i)
        best = best.unionByName(texts.join(F.broadcast(part), F.contains("_low", F.col("_phrase"))).select(query_key, key, F.lit(8.0).alias("score")))
    return top_k(best, k, query_key, key)


def all_lexical_scores(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """BM25 where there is one, else the simple score. Whatever has a simple score shares a term of its text with the query,
    and then BM25 is above 0, so where text is one of BM25's fields, BM25 gives all."""
    best = bm25(chunks, queries, key, query_key)
    if text in BOOSTS:
        return best
    simple = simple_scores(chunks, queries, key, query_key, text).withColumnRenamed("score", "_simple")
    return best.withColumnRenamed("score", "_bm25").join(simple, [query_key, key], "full").select(query_key, key, F.coalesce("_bm25", "_simple").alias("score"))


def all_lexical_top(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """The k best of all_lexical_scores, with their rank."""
    if text in BOOSTS:
        return bm25_top(chunks, queries, k, key, query_key)
    return top_k(all_lexical_scores(chunks, queries, key, query_key, text), k, query_key, key)


def top_k(scored: DataFrame, k: int, query_key: str = "query_id", key: str = "chunk_id", score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each query with their rank; scores count to `digits` decimals, ties go by key."""
    rounded = scored.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(key)))
    return rounded.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def in_scope(chunks: DataFrame, source_id: str | None = None, source_ids: list[str] | None = None, column: str = "source_id") -> DataFrame:
    """Chunks of the listed sources; without a list, of the one source; without either, all."""
    ids = [i.strip() for i in source_ids or [] if i and i.strip()] or ([source_id] if source_id else [])
    return chunks.filter(F.col(column).isin(ids)) if ids else chunks
