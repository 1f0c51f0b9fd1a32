"""Queries on indexing, recognised pages, embedding and tenders, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import embedding, maintenance, scans
from docsift.plans import ingest
from docsift.plans.common import table, tokens_sql
from docsift.plans.text_queries import _FILES
from docsift.sources.tenders import TenderTables

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


@query
def ingest_actions(spark, d):
    """B16, P8, SK5: what a scan finds against a manifest: new, changed, unchanged and gone files."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("mtime_ms"), F.col("n_chars").alias("size"))
    scan = docs.filter("file_id % 11 <> 0").withColumn("size", F.when(F.col("file_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return maintenance.file_actions(scan, docs.filter("file_id % 5 <> 0"))


SQL["ingest_actions"] = """SELECT doc_id AS file_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS action
FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 5 <> 0"""


@query
def indexed_documents(spark, d):
    """Documents as converted texts, those of every thirteenth id as failed conversions: verdict and chunks."""
    failed = F.col("doc_id") % 13 == 0
    texts = table(spark, d, "documents").select("doc_id", F.when(~failed, F.col("text")).alias("markdown"), F.when(failed, "ValueError: x").alias("error"))
    q = ingest.judged(texts, "doc_id")
    return q.select("doc_id", "quality.status", "quality.score", F.array_join("quality.warnings", ",").alias("warnings"), F.size("pieces").alias("chunks"))


SQL["indexed_documents"] = f"""WITH {_FILES}, v AS (SELECT *, doc_id % 13 = 0 AS failed, chunks > 0 AND list_contains(warnings, 'ocr_text_noise') AS noisy FROM files)
SELECT doc_id, CASE WHEN failed THEN 'error' ELSE status END AS status, CASE WHEN failed THEN 0 ELSE score END::INT AS score,
  CASE WHEN failed THEN 'too_little_text,too_few_words,no_chunks,conversion_error' ELSE array_to_string(CASE WHEN noisy THEN list_append(warnings, 'chunks_skipped_for_quality') ELSE warnings END, ',') END AS warnings,
  CASE WHEN failed OR noisy THEN 0 ELSE chunks END::INT AS chunks FROM v"""


@query
def scanned_documents(spark, d):
    """SC11, M6, W12: ten documents in a row as the pages of a scan, some failed, some from the cache."""
    k = F.col("doc_id")
    failed = (k % 60 >= 20) & (k % 10 < k % 5 + 2)
    pages = table(spark, d, "documents").select(
        F.floor(k / 10).alias("file_id"), (k % 10).cast("int").alias("page"), F.when(~failed, F.col("text")).alias("text"), F.when(~failed, (k % 60).cast("double")).alias("confidence"), (k % 4 == 3).alias("cached"), F.when(failed, "OSError: x").alias("error")
    )
    s = scans.scanned_documents(pages)
    r = lambda c: F.col(f"recognition.ocr_{c}").alias(c)
    listed = lambda c: F.array_join(F.col(f"recognition.ocr_{c}"), ",").alias(c)
    parts = F.when(F.col("error").isNull(), F.regexp_count("markdown", F.lit(r"(?m)^## OCR page \d+$")))
    return s.select("file_id", parts.alias("parts"), F.regexp_extract("error", r"\d+$", 0).alias("stopped"), r("accepted_pages"), r("confidence"), r("confidence_p10"), r("chars"), *map(listed, ("rejected_pages", "failed_pages", "low_confidence_pages", "empty_pages", "salvaged_pages")))


_GATES = _FILES[: _FILES.index(",\nff AS")]
_LIST = "coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER ({}), '')"
SQL["scanned_documents"] = f"""WITH {_GATES},
pp AS (SELECT doc_id // 10 AS file_id, (doc_id % 10)::INT AS page, doc_id % 4 = 3 AS cached, doc_id % 60 >= 20 AND doc_id % 10 < doc_id % 5 + 2 AS failed, chars AS c, words, severe, br, lr, doc_id % 60 AS conf FROM qual),
gp AS (SELECT *, NOT failed AND c >= 20 AND words >= 3 AND NOT severe AND br <= 0.01 AND NOT (c >= 20 AND lr < 0.2) AND conf >= 25 AS usable, CASE WHEN failed THEN 0 ELSE c END AS chars FROM pp),
np AS (SELECT file_id, page, sum(failed::INT) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM gp WHERE NOT cached),
sp AS (SELECT file_id, min(page) AS page FROM np WHERE run = 3 GROUP BY file_id),
ap AS (SELECT file_id, count(*) FILTER (usable) AS accepted_pages, count(*) FILTER (NOT usable AND chars > 0) AS refused, round(avg(conf) FILTER (NOT failed))::INT AS confidence, list_sort(list(conf) FILTER (NOT failed)) AS cs,
  coalesce(sum(chars) FILTER (usable), 0)::BIGINT AS chars, {_LIST.format('NOT usable AND chars > 0')} AS rejected_pages, {_LIST.format('failed')} AS failed_pages, {_LIST.format('NOT failed AND conf < 50')} AS low_confidence_pages, {_LIST.format('chars < 20')} AS empty_pages FROM gp GROUP BY file_id)
SELECT file_id, CASE WHEN sp.page IS NULL THEN CASE WHEN accepted_pages > 0 THEN accepted_pages ELSE refused END END::INT AS parts, sp.page::VARCHAR AS stopped, accepted_pages, confidence, cs[floor((len(cs) - 1) * 0.1)::INT + 1]::INT AS confidence_p10, chars,
  rejected_pages, failed_pages, low_confidence_pages, empty_pages, CASE WHEN accepted_pages = 0 THEN rejected_pages ELSE '' END AS salvaged_pages FROM ap LEFT JOIN sp USING (file_id)"""


@query
def hashed_embeddings(spark, d):
    """Documents under the native stand-in for an embedding model, in ten-thousandths."""
    e = embedding.embedded(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), lambda t: F.transform(embedding.hashed_vector(t), lambda x: F.round(x * 10000)), "hash", native=True)
    return e.select("chunk_id", F.array_join(F.transform("vector", lambda x: x.cast("int")), ",").alias("vector"))


SQL["hashed_embeddings"] = f"""WITH t AS (SELECT doc_id AS chunk_id, {tokens_sql('text')} AS w FROM documents), b AS (SELECT chunk_id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 4))::INT % 16) AS bs FROM t WHERE len(w) > 0),
c AS (SELECT chunk_id, list_transform(range(16), lambda i: len(list_filter(bs, lambda y: y = i))) AS n FROM b), u AS (SELECT chunk_id, n, sqrt(list_sum(list_transform(n, lambda x: x * x))::DOUBLE) AS len FROM c)
SELECT chunk_id, array_to_string(list_transform(n, lambda x: round(x / len * 10000)::INT), ',') AS vector FROM u"""


@query
def embedding_plan(spark, d):
    """Chunks with a vector of the same model and text, and those that need one, per source."""
    docs = table(spark, d, "documents")
    changed = F.col("doc_id") % 6 == 4
    cached = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise("m").alias("model"), embedding.text_hash(F.when(changed, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))).alias("text_hash"), F.array(F.lit(1.0)).alias("vector"))
    return embedding.embedding_plan(docs.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_id")), cached, "m")


SQL["embedding_plan"] = """WITH c AS (SELECT source AS source_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 6 <> 4 AS have FROM documents)
SELECT source_id, count(*) AS chunks, count(*) FILTER (have) AS cached, count(*) FILTER (NOT have) AS pending FROM c GROUP BY source_id"""


@query
def tender_lookup(spark, d):
    """X5, SC25: customers as tenders and orders as price records, by id, by number and in a list."""
    tenders = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("tender_number"))
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("tender_id"))
    t = TenderTables(tenders, records)
    found = lambda how, df: df.select(F.lit(how).alias("how"), F.col("id").cast("long").alias("id"))
    rows = found("id", t.find_by_id(" 7 ")).unionByName(found("number", t.find_by_number("Customer#000000004"))).unionByName(found("list", t.list_for_audit(["1", "2", "x"])))
    return rows.unionByName(t.price_records("7").select(F.lit("records").alias("how"), F.col("record_id").cast("long").alias("id")))


SQL["tender_lookup"] = """SELECT 'id' AS how, c_custkey::BIGINT AS id FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'number', c_custkey FROM customer WHERE c_name = 'Customer#000000004'
UNION ALL SELECT 'list', c_custkey FROM customer WHERE c_custkey IN (1, 2) UNION ALL SELECT 'records', o_orderkey FROM orders WHERE o_custkey = 7"""
