"""Queries on lexical and vector retrieval, fusion, citations and context, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions import citations
from docsift.functions.text import SYNONYMS, expand_synonyms, snippet, tokens
from docsift.functions.vectors import norm, unit
from docsift.operators import chunking, lexical, retrieval
from docsift.session import checkpointed
from docsift.plans.common import BM25_SQL, EVERY, VECTOR_SQL, benchmark_queries, documents_as_chunks, normalized_sql, table, tokens_sql

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    q = benchmark_queries(spark, d)
    return q.withColumn("terms", tokens(F.col("query_text"))).withColumn("phrase", F.lower(F.trim("query_text")))


@query
def tokenize_counts(spark, d):
    """F1."""
    t = tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.sha1(F.array_join(t, " ")).alias("digest"))


SQL["tokenize_counts"] = f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, sha1(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)"


@query
def term_df(spark, d):
    """A2: in how many documents each term occurs."""
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


SQL["term_df"] = f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens_sql('text')})) AS term FROM documents) GROUP BY term"


@query
def idf_terms(spark, d):
    """A3, A4, M4: idf of the queries' terms, and the corpus's size and mean length."""
    docs = lexical.tokenized(documents_as_chunks(spark, d))
    post = lexical.postings(docs, lexical.query_terms(_prepared(spark, d)))
    out = lexical.term_statistics(post).filter("term <> ''")
    return out.select("term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"), F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


SQL["idf_terms"] = f"WITH {BM25_SQL} SELECT term, df, n_docs, round(avg_len, 6) AS avg_len, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats"


@query
def bm25_topk(spark, d):
    """The ten best documents of each benchmark item."""
    return lexical.bm25_top(documents_as_chunks(spark, d), _prepared(spark, d), 10).select("query_id", "chunk_id", "score", "rank")


SQL["bm25_topk"] = f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10"

_SIMPLE = f"""
d AS (SELECT doc_id, lower(text) AS low, unnest({tokens_sql('text')}) AS term FROM documents),
q AS (SELECT item_id AS query_id, lower(trim(text)) AS phrase, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark),
c AS (SELECT doc_id, term, count(*) AS n FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT query_id, doc_id, any_value(phrase) AS phrase, sum(2 + ln(1 + n)) AS base FROM c JOIN q USING (term) GROUP BY ALL),
scored AS (SELECT query_id, doc_id AS chunk_id, round(base + CASE WHEN contains(lower(text), phrase) THEN 8 ELSE 0 END, 6) AS score FROM s JOIN documents USING (doc_id))"""


@query
def simple_lexical_topk(spark, d):
    """The ten best by the simple score."""
    return lexical.simple_top(documents_as_chunks(spark, d), _prepared(spark, d), 10).select("query_id", "chunk_id", "score", "rank")


SQL["simple_lexical_topk"] = f"WITH {_SIMPLE} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10"


@query
def lexical_fallback(spark, d):
    """BM25 candidates, and simple ones for queries that it finds nothing for (here: none)."""
    return lexical.lexical_candidates(documents_as_chunks(spark, d), _prepared(spark, d), "bm25", 5).select("query_id", "chunk_id", "score", "rank")


SQL["lexical_fallback"] = f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 5"


@query
def scoped_bm25(spark, d):
    """BM25 within two sources; its statistics are the scope's."""
    scope = lexical.in_scope(documents_as_chunks(spark, d), source_ids=["src1", "src2"])
    return lexical.bm25_top(scope, _prepared(spark, d), 3).select("query_id", "chunk_id", "score", "rank")


SQL["scoped_bm25"] = f"WITH documents AS (SELECT * FROM main.documents WHERE source IN ('src1', 'src2')), {BM25_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 3"


@query
def chunk_windows(spark, d):
    """the chunks of each document."""
    c = chunking.chunk_frame(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk_text").cast("long").alias("n_chars"), F.sha1("chunk_text").alias("digest"))


SQL["chunk_windows"] = f"""
WITH t AS (SELECT doc_id, {normalized_sql('text')} AS t FROM documents),
w AS (SELECT doc_id, CASE WHEN length(t) <= 1800 THEN [t] ELSE list_transform(range(0, length(t), 1580), lambda s: t[s + 1:s + 1800]) END AS ws FROM t WHERE t <> ''),
n AS (SELECT doc_id, list_filter(list_transform(ws, lambda x: {normalized_sql('x')}), lambda x: x <> '') AS ws FROM w)
SELECT doc_id, i::BIGINT AS chunk_index, length(ws[i + 1])::BIGINT AS n_chars, sha1(ws[i + 1]) AS digest FROM n, LATERAL (SELECT unnest(range(len(ws))) AS i)"""


@query
def snippets(spark, d):
    """each document around the first term of a query."""
    s = snippet(F.col("text"), F.lit("token about tion the"))
    return table(spark, d, "documents").select("doc_id", F.length(s).cast("long").alias("n_chars"), F.sha1(s).alias("digest"))


SQL["snippets"] = f"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(['token', 'about', 'tion', 'the'], lambda t: instr(lower(text), t)), lambda x: x > 0)[1] - 1 AS pos FROM documents),
r AS (SELECT doc_id, text, pos, greatest(0, pos - 260) AS s, least(length(text), pos + 260) AS e FROM p),
o AS (SELECT doc_id, CASE WHEN pos IS NULL THEN ({normalized_sql('text')})[1:520]
  ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || {normalized_sql('text[s + 1:e]')} || (CASE WHEN e < length(text) THEN '...' ELSE '' END) END AS x FROM r)
SELECT doc_id, length(x)::BIGINT AS n_chars, sha1(x) AS digest FROM o"""


@query
def vector_topk(spark, d):
    """The ten nearest vectors, by dot product, of each vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = v.filter(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return retrieval.nearest(v, q, 10).select("query_id", "chunk_id", "score", "rank")


SQL["vector_topk"] = f"WITH {VECTOR_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 10"


@query
def l2_norm(spark, d):
    """M2."""
    v = table(spark, d, "embeddings")
    u = unit(F.col("embedding"))
    return v.select("vec_id", F.round(norm(F.col("embedding")), 9).alias("norm"), F.round(F.get(u, F.lit(0)), 9).alias("first"), F.size(u).cast("long").alias("dimensions"))


SQL["l2_norm"] = "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 9) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 9) AS first, len(e)::BIGINT AS dimensions FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _doc_queries(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vector whose id is divisible by 50, each asking for its first eight terms."""
    docs = table(spark, d, "documents").filter(F.col("doc_id") % EVERY == 0)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("query_vector"))
    return docs.join(v, "doc_id").select(F.col("doc_id").alias("query_id"), F.slice(tokens(F.col("text")), 1, 8).alias("terms"), "query_vector")


_HYBRID = f"""
q0 AS (SELECT doc_id AS query_id, ({tokens_sql('text')})[1:8] AS terms, embedding::DOUBLE[] AS qe FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % {EVERY} = 0),
""" + BM25_SQL.replace(f"SELECT item_id AS query_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark", "SELECT query_id, unnest(list_distinct(terms)) AS term FROM q0") + """,
lx AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored QUALIFY r <= 200),
vv AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(qe, embedding::DOUBLE[]), 6) AS score FROM q0, embeddings WHERE list_dot_product(qe, embedding::DOUBLE[]) > 0 AND vec_id IN (SELECT doc_id FROM main.documents)),
vx AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM vv QUALIFY r <= 200),
u AS (SELECT query_id, chunk_id, vx.r AS vector_rank, lx.r AS lexical_rank, coalesce(vx.score, 0) AS vector_score, coalesce(lx.score, 0) AS lexical_score,
  round(coalesce(1.0 / (60 + vx.r), 0) + coalesce(1.0 / (60 + lx.r), 0), 12) AS rrf_score FROM vx FULL JOIN lx USING (query_id, chunk_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, round(vector_score + lexical_score, 9) DESC, vector_rank NULLS LAST, chunk_id) AS rank FROM u QUALIFY rank <= 60)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    q = _doc_queries(spark, d)
    chunks = documents_as_chunks(spark, d)
    lex = lexical.bm25_top(chunks, q, 200)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    vec = retrieval.nearest(v, q.select("query_id", "query_vector"), 200)
    return retrieval.rrf(vec, lex)


@query
def rrf_fusion(spark, d):
    """200 by vector and 200 by BM25 fused to 60."""
    return _fused(spark, d).select("query_id", "chunk_id", "vector_rank", "lexical_rank", "rrf_score", "rank")


SQL["rrf_fusion"] = f"WITH {_HYBRID} SELECT query_id, chunk_id, vector_rank, lexical_rank, rrf_score, rank FROM fused"


@query
def hybrid_score(spark, d):
    """The thirty best of the fused rows by hybrid score."""
    scored = retrieval.hybrid(_fused(spark, d).drop("rank")).filter("score > 0")
    return lexical.top_k(scored, 30).select("query_id", "chunk_id", "score", F.round("lexical_normalized", 6).alias("lexical_normalized"), F.round("vector_normalized", 6).alias("vector_normalized"), "rank")


SQL["hybrid_score"] = f"""WITH {_HYBRID},
n AS (SELECT query_id, chunk_id, CASE WHEN max(lexical_score) OVER (PARTITION BY query_id) > 0 THEN lexical_score / max(lexical_score) OVER (PARTITION BY query_id) ELSE 0.0 END AS ln, greatest(0.0, least(1.0, vector_score)) AS vn FROM fused),
h AS (SELECT query_id, chunk_id, round(vn * 0.82 + ln * 0.18, 6) AS score, round(ln, 6) AS lexical_normalized, round(vn, 6) AS vector_normalized FROM n WHERE vn * 0.82 + ln * 0.18 > 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h QUALIFY rank <= 30"""


@query
def rerank_tail_append(spark, d):
    """The first thirty fused rows reordered by a score that half of them have, the rest behind."""
    ranked = _fused(spark, d).select("query_id", "chunk_id", "rank")
    scores = ranked.filter("chunk_id % 2 = 0").select("query_id", "chunk_id", (F.col("chunk_id") * 7919 % 1009).cast("double").alias("rerank_score"))
    # Equal scores keep their order, which a score that repeats within a query shows.
    return retrieval.rerank(ranked, scores).select("query_id", "chunk_id", "rerank_score", "rank")


SQL["rerank_tail_append"] = f"""WITH {_HYBRID},
s AS (SELECT query_id, chunk_id, rank AS r, CASE WHEN rank <= 30 AND chunk_id % 2 = 0 THEN (chunk_id * 7919 % 1009)::DOUBLE END AS rerank_score FROM fused)
SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, r) AS rank FROM s"""


@query
def hybrid_search(spark, d):
    """B1: the whole search, over chunks of the documents, with vectors of whole documents on their first chunk."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    # Chunks are an index that every part of the search reads: cut once, then stored.
    chunks = checkpointed(chunking.chunk_frame(docs).select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), F.col("chunk_text").alias("text"), F.col("source").alias("source_id"), F.col("source").alias("source_title"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("title"), F.concat_ws("/", F.lit("corpus"), "source", "doc_id").alias("path")
    ))
    v = table(spark, d, "embeddings")
    vectors = v.select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("embedding").alias("vector"))
    q = table(spark, d, "benchmark").join(v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")), "item_id", "left")
    return retrieval.search(chunks, q.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vector"), vectors)


@query
def recall_mrr(spark, d):
    """For each benchmark item that a document holds, the rank of the first such document by BM25."""
    chunks, q = documents_as_chunks(spark, d), _prepared(spark, d)
    best = lexical.bm25_top(chunks, q, 10)
    held = best.join(chunks.select("chunk_id", "text"), "chunk_id").join(q.select("query_id", "query_text"), "query_id")
    first = held.filter(F.contains("text", F.col("query_text"))).groupBy("query_id").agg(F.min("rank").alias("rank"))
    m = retrieval.metrics(q.select("query_id").join(first, "query_id", "left"))
    return m.select("n_cases", *(F.round(c, 6).alias(c) for c in m.columns if c != "n_cases"))


SQL["recall_mrr"] = f"""WITH {BM25_SQL},
best AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10),
hit AS (SELECT query_id, min(rank) AS rank FROM best JOIN documents ON doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE contains(documents.text, b.text) GROUP BY query_id),
r AS (SELECT item_id, rank FROM benchmark LEFT JOIN hit ON query_id = item_id)
SELECT count(*) AS n_cases, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr FROM r"""


@query
def synonym_expand(spark, d):
    """Terms of each conversation turn, with synonyms."""
    t = table(spark, d, "conversations")
    own = F.concat(F.array_distinct(tokens(F.col("text"))), F.when(F.col("turn") % 3 == 0, F.array(F.lit("цена"), F.lit("договор"))).otherwise(F.array().cast("array<string>")))
    return t.select("conv_id", "turn", F.size(own).cast("long").alias("n_terms"), F.array_join(F.array_sort(expand_synonyms(own)), " ").alias("terms"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_GROUPS = "".join(f", CASE WHEN list_has_any(own, {_list(g)}) THEN {_list(g)} ELSE [] END" for g in SYNONYMS)
_FLAT = "own" + "".join(f" || CASE WHEN list_has_any(own, {_list(g)}) THEN {_list(g)} ELSE [] END" for g in SYNONYMS)
SQL["synonym_expand"] = f"""
WITH t AS (SELECT conv_id, turn, list_distinct({tokens_sql('text')}) || CASE WHEN turn % 3 = 0 THEN ['цена', 'договор'] ELSE [] END AS own FROM conversations)
SELECT conv_id, turn, len(own)::BIGINT AS n_terms, array_to_string(list_sort(list_distinct({_FLAT})), ' ') AS terms FROM t"""


@query
def citation_numbers(spark, d):
    """The numbers that a turn cites, from 1 to 5, and whether a line of sources is added."""
    answer = F.concat("text", F.lit(" ["), (F.col("turn") % 7).cast("string"), F.lit("] and ["), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("]"))
    n = citations.numbers(answer, F.lit(5))
    full = citations.with_sources(answer, F.lit(5))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias("cited"), F.substring_index(full, "\n", -1).alias("sources"))


SQL["citation_numbers"] = r"""
WITH a AS (SELECT conv_id, turn, text || ' [' || (turn % 7) || '] and [' || (conv_id % 4 + 1) || ']' AS t FROM conversations),
m AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(t, '\[(\d{1,9})\]', 1), lambda x: x::INT), lambda x: x > 0 AND x <= 5) AS l FROM a),
n AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM m)
SELECT conv_id, turn, array_to_string(l, ',') AS cited, 'Источники: ' || array_to_string(list_transform(l[1:12], lambda x: '[' || x || ']'), ', ') || '.' AS sources FROM n"""


@query
def context_assembly(spark, d):
    """The context text of each benchmark item, from its eight best documents."""
    best = lexical.bm25_top(documents_as_chunks(spark, d), _prepared(spark, d), 8)
    full = best.join(documents_as_chunks(spark, d).select("chunk_id", "text"), "chunk_id").withColumn("label", F.concat(F.lit("doc "), F.col("chunk_id").cast("string")))
    c = citations.context_text(full)
    return c.select("query_id", F.length("context").cast("long").alias("n_chars"), F.sha1("context").alias("digest"))


SQL["context_assembly"] = f"""WITH {BM25_SQL},
best AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 8),
c AS (SELECT query_id, string_agg('[' || rank || '] doc ' || chunk_id || chr(10) || text[1:1400], chr(10) || chr(10) ORDER BY rank) AS x FROM best JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT query_id, length(x)::BIGINT AS n_chars, sha1(x) AS digest FROM c"""


@query
def excerpt_top4_reorder(spark, d):
    """The four best lines of each document for a question, in their order."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    e = citations.excerpt(text, F.array(*map(F.lit, ("then", "tion", "der", "que"))))
    return table(spark, d, "documents").select("doc_id", F.length(e).cast("long").alias("n_chars"), F.sha1(e).alias("digest"))


SQL["excerpt_top4_reorder"] = r"""
WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\n{2,}'), lambda x: trim(x)), lambda x: length(x) >= 30) AS l FROM t),
s AS (SELECT doc_id, i, l[i] AS x, len(list_filter(['then', 'tion', 'der', 'que'], lambda w: contains(lower(l[i]), w))) + CASE WHEN regexp_matches(l[i], '\d{2}\.\d{2}\.\d{4}') THEN 0.5 ELSE 0 END AS sc FROM p, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
b AS (SELECT doc_id, i, x FROM s WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, i) <= 4),
j AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS x FROM b GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(x, t[1:900]) AS x FROM t LEFT JOIN j USING (doc_id)),
e AS (SELECT doc_id, CASE WHEN length(x) > 1200 THEN trim(x[1:1200]) || '...' ELSE x END AS x FROM o)
SELECT doc_id, length(x)::BIGINT AS n_chars, sha1(x) AS digest FROM e"""


@query
def evidence_tokens(spark, d):
    """e-mails, addresses, numbers and words of each turn, and their weight."""
    t = citations.evidence_tokens(F.col("text"))
    weight = F.aggregate(t, F.lit(0), lambda a, x: a + citations.token_weight(x))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), weight.cast("long").alias("weight"))


_FOUND = " || ".join(f"regexp_extract_all(t, '{p.replace('(?iu)', '(?i)')}', 1)" for p in (citations._EMAIL, citations._URL, citations._NUMBER))
SQL["evidence_tokens"] = rf"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\[(\d+)\]', ' ', 'g'), '\s+', ' ', 'g'))[1:900] AS t FROM conversations),
f AS (SELECT conv_id, turn, list_filter(list_transform({_FOUND} || list_filter(regexp_extract_all(t, '{citations._WORD}', 1), lambda x: NOT regexp_matches(x, '^\d+$')), lambda x: trim(x)), lambda x: x <> '') AS f FROM c),
o AS (SELECT conv_id, turn, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i)[1:32] AS l FROM f)
SELECT conv_id, turn, len(l)::BIGINT AS n_tokens, coalesce(list_sum(list_transform(l, lambda x: CASE WHEN contains(x, '@') OR regexp_matches(x, '(?i)^https?://') THEN 8 WHEN regexp_matches(x, '\d') THEN 4 WHEN length(x) >= 6 THEN 2 ELSE 1 END)), 0)::BIGINT AS weight FROM o"""


@query
def evidence_spans(spark, d):
    """The lines of a document that fit the benchmark item with its number best."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("focus"))
    rows = table(spark, d, "documents").select("doc_id", "text").join(b, "doc_id")
    s = citations.evidence_span(F.col("text"), F.col("focus"))
    return rows.withColumn("s", s).filter("s is not null").select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.score").alias("score"))


@query
def citation_labels(spark, d):
    """labels of pages by number, sheet or section, by turns."""
    p = table(spark, d, "pages")
    k = F.col("page_id") % 4
    lab = citations.label(F.concat(F.lit("file"), F.col("page_id").cast("string"), F.lit(".pdf")), F.col("url"), F.when(k == 0, F.col("page_id").cast("int")), F.when(k == 0, (F.col("page_id") + F.col("page_id") % 3).cast("int")), F.when(k == 1, 'Sheet "A"'), F.when(k == 2, "Part  one"))
    return p.select("page_id", lab.alias("label"))


SQL["citation_labels"] = """SELECT page_id, 'file' || page_id || '.pdf' || CASE page_id % 4
  WHEN 0 THEN ', стр. ' || page_id || CASE WHEN page_id % 3 > 0 THEN '-' || (page_id + page_id % 3) ELSE '' END
  WHEN 1 THEN ', лист "Sheet ''A''"' WHEN 2 THEN ', раздел "Part one"' ELSE '' END AS label FROM pages"""


@query
def answer_evidence(spark, d):
    """the line of a turn that cites source 1."""
    answer = F.concat(F.lit("- first ["), (F.col("turn") % 2 + 1).cast("string"), F.lit("] line\n2) "), "text", F.lit(" [1]\nИсточники: [1]"))
    return table(spark, d, "conversations").select("conv_id", "turn", citations.evidence_line(answer, F.lit(1)).alias("evidence"))


SQL["answer_evidence"] = r"""WITH l AS (SELECT conv_id, turn, string_split('2) ' || text, chr(10))[-1] AS x FROM conversations),
c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x || '  ', '^[\s\-–—*•\d.)]+', ''), '\s+', ' ', 'g')) AS x FROM l)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'first line' WHEN length(x) > 700 THEN trim(x[1:700]) || '...' ELSE x END AS evidence FROM c"""


@query
def best_rank_window(spark, d):
    """Each event's rank by value among its user's, and the user's best."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id")
    r = F.row_number().over(w.orderBy(F.desc("value"), "event_id"))
    return e.select("event_id", "user_id", r.cast("long").alias("rank"), F.max("value").over(w).alias("best"))


SQL["best_rank_window"] = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, max(value) OVER (PARTITION BY user_id) AS best FROM events"
