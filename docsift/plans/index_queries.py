"""Queries on the vector index, snapshots, matrices and batches of requests, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docsift.functions.text import tokens
from docsift.operators import ann, scoped
from docsift.plans.common import EVERY, VECTOR_SQL, table, tokens_sql
from docsift.session import shared_root
from docsift.sources import matrices, snapshots

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _indexed(spark, d):
    path = f"{shared_root(spark)}/docsift/ann-{uuid.uuid4().hex}"
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    ann.build(vectors).save(path)
    queries = vectors.filter(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return ann.Index.load(spark, path), queries


@query
def ann_topk(spark, d):
    """T4: the ten nearest vectors of each vector whose id is divisible by 50, from the cells of an index over all rows, with
    a second round over the cells that may hold a better one."""
    index, queries = _indexed(spark, d)
    return ann.search(index, queries, 10, nprobe=8, exact=True).select("query_id", "chunk_id", "score", "rank")


SQL["ann_topk"] = f"WITH {VECTOR_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 10"


@query
def ann_recall(spark, d):
    """T4: for each query of ann_topk, how many neighbours there are, and whether the probed cells alone, as many as a
    measurement on a sample of the queries asks for, hold nine tenths of all queries' neighbours."""
    index, queries = _indexed(spark, d)
    exact = ann.search(index, queries, 10, nprobe=8, exact=True)
    found = ann.search(index, queries, 10, ann.probes_for(index, queries)).select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    each = exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("neighbours"), F.count("_hit").alias("hits"))
    total = each.agg((F.sum("hits") >= 0.9 * F.sum("neighbours")).alias("recall_ok"))
    return each.select("query_id", "neighbours").crossJoin(F.broadcast(total))  # one row


SQL["ann_recall"] = f"WITH {VECTOR_SQL} SELECT query_id, least(count(*), 10) AS neighbours, true AS recall_ok FROM vs GROUP BY query_id"


@query
def snapshot_versions(spark, d):
    """SK1, SK2, SK4, SK6: two tables written as one version after another: every source's documents; then one source's
    rows replaced and another's dropped, in both tables at once. Each version as its readers see it."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    store = snapshots.Snapshots(spark, f"{shared_root(spark)}/docsift/snapshots-{uuid.uuid4().hex}")
    files, chunks = docs.select("doc_id", "source"), docs.select("doc_id", "source", "chars")
    first = store.begin()
    first.replace("files", files)
    first.replace("chunks", chunks)
    first.commit()
    names = sorted(r[0] for r in docs.select("source").distinct().limit(1000).collect())
    second = store.begin()
    kept = docs.filter((F.col("source") != F.lit(names[-1] if names else "")) & ((F.col("source") != F.lit(names[0] if names else "")) | (F.col("doc_id") % 2 == 0)))
    second.replace("files", kept.select(*files.columns))
    second.replace("chunks", kept.select(*chunks.columns))
    second.commit()
    out = None
    for version in (1, 2):
        own = store.read("files", files.schema, version).join(store.read("chunks", chunks.schema, version).select("doc_id", "chars"), "doc_id")
        rows = own.groupBy("source").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars")).withColumn("version", F.lit(version).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


SQL["snapshot_versions"] = """WITH d AS (SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS chars FROM documents), e AS (SELECT min(source) AS low, max(source) AS high FROM d)
SELECT source, count(*) AS documents, sum(chars)::BIGINT AS chars, 1::BIGINT AS version FROM d GROUP BY source
UNION ALL SELECT source, count(*), sum(chars)::BIGINT, 2 FROM d, e WHERE source <> high AND (source <> low OR doc_id % 2 = 0) GROUP BY source"""


@query
def matrix_round_trip(spark, d):
    """SC27, SK12, SK13: all embeddings, in order of their id, written as one half-precision matrix by many tasks and read
    back by ranges: the dimensions of each row, and whether its numbers are the nearest half-precision ones but for rounding."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    path = f"{shared_root(spark)}/docsift/matrix-{uuid.uuid4().hex}.npy"
    facts = v.agg(F.max(F.size("embedding")), F.min("vec_id")).first()
    matrices.write_matrix(v, path, max(1, facts[0] or 1), "vec_id", "embedding")
    back = matrices.read_matrix(spark, path, range_bytes=1 << 20).withColumn("vec_id", F.col("row") + (facts[1] or 0))  # ids without gaps
    near = F.forall(F.zip_with("vector", "embedding", lambda a, b: F.abs(a - b) <= F.abs(b) / 1024 + 1e-6), lambda ok: F.coalesce(ok, F.lit(False)))
    return v.join(back, "vec_id", "left").select("vec_id", F.coalesce(F.size("vector"), F.lit(0)).cast("long").alias("dimensions"), near.alias("near"))


SQL["matrix_round_trip"] = "SELECT vec_id, len(embedding)::BIGINT AS dimensions, true AS near FROM embeddings"


def _requests(spark, d):
    """Benchmark items as requests: those whose id ends in an even digit or letter name a source, the one in that place."""
    names = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source_id")).distinct()
    sources = names.select("source_id", F.upper("source_id").alias("title"), F.lit("").alias("path"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query_text"), F.ascii(F.right(F.col("item_id").cast("string"), F.lit(1))).alias("_k"))
    pick = names.groupBy().agg(F.array_sort(F.collect_set("source_id")).alias("_all"))  # one row: the names of the sources
    items = items.crossJoin(F.broadcast(pick)).withColumn("source", F.when(F.col("_k") % 4 == 0, F.get("_all", F.col("_k") % F.size("_all"))).when(F.col("_k") % 4 == 2, F.upper(F.get("_all", F.col("_k") % F.size("_all")))).when(F.col("_k") % 8 == 1, F.lit("no such source")))
    return items.select("query_id", "query_text", "source", (F.col("_k") % 5 + 1).cast("long").alias("top_k")), sources


@query
def resolved_requests(spark, d):
    """The source that each of many requests names, by its id, else by its title, and the request's status."""
    requests, sources = _requests(spark, d)
    return scoped.resolved(requests, sources)[0].withColumn("status", F.col("status").cast("long"))


@query
def batch_retrieval(spark, d):
    """Every benchmark item as a request with a scope and a limit of its own, in one job: BM25 with the
    statistics of the scope."""
    requests, sources = _requests(spark, d)
    status, scopes = scoped.resolved(requests, sources)
    good = requests.join(status.filter("status = 200").select("query_id"), "query_id").withColumn("terms", tokens(F.col("query_text")))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source_id"))
    return scoped.search(chunks, good, scopes).select("query_id", "chunk_id", "score", "rank")


_REQUESTS_SQL = """
names AS (SELECT list(source ORDER BY source) AS names FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents)),
r AS (SELECT item_id AS query_id, coalesce(text, '') AS query_text, names, ascii(right(item_id::VARCHAR, 1)) AS k FROM benchmark, names),
req AS (SELECT query_id, query_text, k % 5 + 1 AS top_k, CASE WHEN trim(query_text) = '' THEN 400 WHEN k % 2 = 1 AND k % 8 = 1 THEN 404 ELSE 200 END AS status,
  CASE WHEN trim(query_text) <> '' AND k % 2 = 0 AND names[k % len(names) + 1] <> '' THEN names[k % len(names) + 1] END AS source_id FROM r)"""
SQL["resolved_requests"] = f"WITH {_REQUESTS_SQL} SELECT query_id, status::BIGINT AS status, source_id FROM req"
SQL["batch_retrieval"] = f"""WITH {_REQUESTS_SQL},
c AS (SELECT doc_id AS chunk_id, coalesce(source, '') AS source, {tokens_sql('text')} AS t FROM documents),
docs AS (SELECT chunk_id, source, t, greatest(1, len(t)) AS doc_len FROM c),
inside AS (SELECT query_id, chunk_id, doc_len FROM req, docs WHERE status = 200 AND (source_id IS NULL OR source_id = source)),
sizes AS (SELECT query_id, count(*) AS n_docs, avg(doc_len) AS avg_len FROM inside GROUP BY query_id),
q AS (SELECT query_id, unnest(list_distinct({tokens_sql('query_text')})) AS term FROM req WHERE status = 200),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM docs) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY ALL),
held AS (SELECT q.query_id, term, chunk_id, tf, doc_len FROM q JOIN p USING (term) JOIN inside i USING (query_id, chunk_id)),
df AS (SELECT query_id, term, count(*) AS df FROM held GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM held JOIN df USING (query_id, term) JOIN sizes USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) JOIN req USING (query_id) WHERE rank <= top_k"""
