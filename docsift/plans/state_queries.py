"""Queries on maintenance, jobs, matching, audit and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.money import LABELLED, NUMBER, SPACE, compare_money, money, money_text, price_mentions
from docsift.functions.text import tokens
from docsift.operators import audit, jobs, maintenance, matching
from docsift.plans.common import EVERY, table, tokens_sql
from docsift.streaming import jobs as streams

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


# Maintenance: documents as a manifest, embeddings as vectors


@query
def prune_unseen(spark, d):
    """SK5, U5: documents without a vector, by source."""
    _, gone = maintenance.prune_unseen(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return gone.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


SQL["prune_unseen"] = "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY source"


@query
def partition_replace(spark, d):
    """SK4, U1: sources src1 and src2 replaced by shorter rows."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    fresh = docs.filter(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 3 == 0)).withColumn("n_chars", F.lit(1).cast("long"))
    return maintenance.replace_partition(docs, fresh, "source")


SQL["partition_replace"] = "SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 1::BIGINT FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0"


@query
def upsert_latest(spark, d):
    """SK3: orders changed by customers of even id, later ones first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    current = o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderdate", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.o_orderdate", "r.o_totalprice")
    changes = o.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderdate", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.o_orderdate", "r.o_totalprice")
    return maintenance.upsert(current, changes, "o_custkey", "o_orderdate")


SQL["upsert_latest"] = """SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderdate) ELSE min(o_orderdate) END AS o_orderdate,
CASE WHEN o_custkey % 2 = 0 THEN arg_max(o_totalprice, (o_orderdate, o_orderkey)) ELSE arg_min(o_totalprice, (o_orderdate, o_orderkey)) END AS o_totalprice FROM orders GROUP BY o_custkey"""


@query
def cascade_delete(spark, d):
    """SK6: what is left of orders and lineitems when the customers of a segment go."""
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    kept = maintenance.cascade_delete(gone, "o_custkey", orders=orders)["orders"]
    lost = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    rest = maintenance.cascade_delete(lost, "l_orderkey", lines=lines)["lines"]
    return kept.agg(F.count("*").alias("n")).select(F.lit("orders").alias("kept"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("kept"), "n"))


SQL["cascade_delete"] = """WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g))
SELECT 'orders' AS kept, count(*) AS n FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))"""


@query
def retention_newest(spark, d):
    """SK10, T13, T18: the fifty newest events (a top-k)."""
    return maintenance.newest(table(spark, d, "events"), "ts", 50, "event_id").select("event_id", "user_id", "ts")


SQL["retention_newest"] = "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50"


@query
def retention_by_user(spark, d):
    """SK10: each user's three newest events."""
    return maintenance.newest(table(spark, d, "events"), "ts", 3, "event_id", "user_id").select("event_id", "user_id", "ts")


SQL["retention_by_user"] = "SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3"


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), (F.col("doc_id") % 3).alias("model"), F.sha1("text").alias("text_hash"))


@query
def embedding_pending_anti(spark, d):
    """Documents without a cached vector of their model and text."""
    c = _chunk_rows(spark, d)
    cached = c.filter("chunk_id % 4 <> 0").withColumn("model", F.when(F.col("chunk_id") % 5 == 0, 9).otherwise(F.col("model")))
    return maintenance.pending(c, cached).select("chunk_id", "source_id")


SQL["embedding_pending_anti"] = "SELECT doc_id AS chunk_id, source AS source_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0"


@query
def vector_reuse(spark, d):
    """Documents that share the text of a document with a vector."""
    c = _chunk_rows(spark, d)
    v = c.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), "chunk_id").select("text_hash", "vector")
    return maintenance.reused(c, v).select("chunk_id", F.col("vector").isNotNull().alias("reused"))


SQL["vector_reuse"] = "SELECT doc_id AS chunk_id, sha1(text) IN (SELECT sha1(text) FROM documents JOIN embeddings ON vec_id = doc_id) AS reused FROM documents"


@query
def incremental_skip(spark, d):
    """P8, ST1: files of a scan that the manifest lacks or has otherwise."""
    scan = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), (F.col("doc_id") * 1000).alias("mtime_ms"), F.col("n_chars").alias("size"))
    manifest = scan.filter("file_id % 10 <> 0").withColumn("size", F.when(F.col("file_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return maintenance.changed_files(scan, manifest).select("file_id", "size")


SQL["incremental_skip"] = "SELECT doc_id AS file_id, n_chars AS size FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0"


@query
def backfill_rows(spark, d):
    """Each source's documents, vectors and what is missing."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    v = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    sources = docs.select("source_id").distinct().unionByName(spark.createDataFrame([("none",)], "source_id string")).withColumn("title", F.upper("source_id"))
    service = v.filter("doc_id % 2 = 0").groupBy("source_id").agg(F.count("*").alias("service_vectors"))
    return maintenance.backfill_rows(sources, docs, v, service).select("source_id", "title", "chunks", "json_vectors", "service_vectors", "missing", "ready")


SQL["backfill_rows"] = """WITH s AS (SELECT DISTINCT source AS source_id FROM documents UNION ALL SELECT 'none'), v AS (SELECT doc_id, source FROM documents JOIN embeddings ON vec_id = doc_id),
c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), j AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS e FROM v GROUP BY 1),
r AS (SELECT source_id, upper(source_id) AS title, coalesce(c.n, 0) AS chunks, coalesce(j.n, 0) AS json_vectors, coalesce(j.e, 0) AS service_vectors FROM s LEFT JOIN c ON c.source = source_id LEFT JOIN j ON j.source = source_id)
SELECT *, greatest(0, chunks - json_vectors) AS missing, chunks > 0 AND json_vectors >= chunks AS ready FROM r"""


@query
def backfill_next(spark, d):
    """The incomplete source with the least to do."""
    return backfill_rows(spark, d).orderBy(*maintenance.backfill_order()).limit(1).select("source_id", "missing")


SQL["backfill_next"] = f"SELECT source_id, missing FROM ({SQL['backfill_rows']}) ORDER BY missing = 0, missing, title LIMIT 1"


@query
def union_distinct(spark, d):
    """Nations of customers and suppliers."""
    return maintenance.union_distinct(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


SQL["union_distinct"] = "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"


@query
def merged_models(spark, d):
    """Parts as model rows merged by brand."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("id"), (F.col("p_size") > 45).alias("loaded"), F.col("p_type").alias("origin"))
    return maintenance.merge_models(p)


SQL["merged_models"] = "SELECT p_brand AS id, max(p_size > 45) AS loaded, max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END || p_type)[2:] AS origin FROM part GROUP BY p_brand"

# Jobs


@query
def latest_job(spark, d):
    """W4, J24, ST2: each user's latest event."""
    e = table(spark, d, "events")
    users = e.select("user_id").distinct()
    return jobs.with_latest_job(users, e.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ("ts",), "event_id").select("user_id", "ts", "event_id", "event_type", "value")


SQL["latest_job"] = "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

_STATES = ("running", "failed", "completed", "cancelled", "")


@query
def job_health(spark, d):
    """ST3, D2: health of each user's latest event as a job, two minutes after the last event of all, or soon before."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    k = F.pmod(F.col("user_id"), F.lit(5)).cast("int")
    last = jobs.latest(e.select("user_id", "ts", "event_id"), "user_id", ("ts",), "event_id").crossJoin(F.broadcast(now))  # one row
    h = jobs.health(F.get(F.array(*map(F.lit, _STATES)), k), F.when(F.col("user_id") % 2 == 0, "interrupted").otherwise("x"), F.col("ts"), F.col("now"), F.col("user_id") % 3 > 0)
    return last.select("user_id", h.alias("h")).select("user_id", "h.health", "h.code", "h.stale", "h.age_ms")


SQL["job_health"] = """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id),
s AS (SELECT user_id, ['running', 'failed', 'completed', 'cancelled', ''][user_id % 5 + 1] AS st, user_id % 2 = 0 AS ph, user_id % 3 > 0 AS alive, greatest(0, epoch_us(now) // 1000 - epoch_us(ts) // 1000) AS age_ms FROM l, n),
f AS (SELECT *, (st = 'running' AND NOT alive) OR (st = 'failed' AND ph) AS gone, st = 'running' AND alive AND age_ms > 120000 AS silent FROM s)
SELECT user_id, CASE WHEN gone THEN 'interrupted' WHEN silent THEN 'stale' WHEN st = 'running' THEN 'active' WHEN st IN ('failed', 'cancelled', 'completed') THEN st ELSE 'idle' END AS health,
CASE WHEN gone THEN 'process_missing' WHEN silent THEN 'no_recent_progress' WHEN st = 'running' THEN 'progress_recent' WHEN st <> '' THEN st ELSE 'not_indexed' END AS code, gone OR silent AS stale, age_ms FROM f"""


@query
def failure_runs(spark, d):
    """Runs of events of small value, by user; from three on, an abort."""
    return jobs.failure_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50)


SQL["failure_runs"] = """WITH e AS (SELECT user_id, value < 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, value < 50 ORDER BY ts, event_id) AS j FROM events)
SELECT user_id, count(*) AS length, min(i) AS first, max(i) AS last, count(*) >= 3 AS aborted FROM e WHERE f GROUP BY user_id, i - j"""


@query
def history_groups(spark, d):
    """Events as history entries, seen from 20 January 2024."""
    g = jobs.history_group(F.to_date("ts"), F.lit("2024-01-20").cast("date"))
    return table(spark, d, "events").groupBy(g.alias("label"), "event_type").agg(F.count("*").alias("n"))


SQL["history_groups"] = """SELECT CASE WHEN DATE '2024-01-20' - ts::DATE <= 0 THEN 'today' WHEN DATE '2024-01-20' - ts::DATE = 1 THEN 'yesterday' WHEN DATE '2024-01-20' - ts::DATE < 7 THEN 'week' ELSE strftime(ts, '%Y-%m') END AS label, event_type, count(*) AS n FROM events GROUP BY ALL"""


@query
def run_totals(spark, d):
    """Sums of counters, nulls as zero."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey")).alias("files"), F.lit(1).alias("runs"))
    return jobs.run_totals(o, ["files", "runs"])


SQL["run_totals"] = "SELECT sum(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey ELSE 0 END)::BIGINT AS files, count(*) AS runs FROM orders"


@query
def event_windows(spark, d):
    """ST2: events by day and type, as a stream's tumbling window gives them."""
    w = streams.windowed(table(spark, d, "events"), "ts", ["event_type"], "1 day")
    return w.select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


SQL["event_windows"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


@query
def event_sessions(spark, d):
    """ST3: sessions of each user, by pauses of an hour."""
    return streams.sessions(table(spark, d, "events"), "ts", "user_id", "1 hour")


SQL["event_sessions"] = """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM b GROUP BY user_id, s"""


@query
def event_properties(spark, d):
    """JS1, JS2: fields of the events' JSON, by type."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_type", F.explode(F.map_keys("m")).alias("name")).groupBy("event_type", "name").agg(F.count("*").alias("n"))


SQL["event_properties"] = "SELECT event_type, name, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS name FROM events) GROUP BY ALL"

# Matching


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Nations as contracts, suppliers as tenders linked to them."""
    contracts = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.col("n_name").alias("title"), F.concat(F.lit("/c/"), "n_name").alias("path"), F.lit("contract").alias("source_type"), F.lit("").alias("linked_contract_id"))
    tenders = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.col("s_name").alias("title"), F.concat(F.lit("/t/"), "s_name").alias("path"), F.lit("tender").alias("source_type"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("linked_contract_id"))
    return contracts.unionByName(tenders)


@query
def scope_expand(spark, d):
    """Each contract with its tenders, each tender alone."""
    return matching.scope_expansion(_sources(spark, d))


SQL["scope_expand"] = """SELECT 'n' || n_nationkey AS source_id, 'n' || n_nationkey AS member_id FROM nation UNION SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier
UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)"""


@query
def contract_titles(spark, d):
    """Tenders with their contract's title."""
    return matching.with_contract_title(_sources(spark, d)).filter("source_type = 'tender'").select("source_id", "contract_title")


SQL["contract_titles"] = "SELECT 's' || s_suppkey AS source_id, n_name AS contract_title FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"


@query
def question_sources(spark, d):
    """Questions that name nations, matched to contracts."""
    n = table(spark, d, "nation")
    asked = n.select(F.col("n_nationkey").cast("long").alias("question_id"), F.concat(F.lit("какая цена по "), F.lower("n_name"), F.lit(" договору")).alias("question"))
    contracts = _sources(spark, d).filter("source_type = 'contract'")
    m = matching.match_sources(asked, contracts).filter("rank = 1")
    return m.select("question_id", "source_id", "score", F.array_join("matched_tokens", " ").alias("matched_tokens"), "confident")


SQL["question_sources"] = r"""WITH n AS (SELECT n_nationkey::BIGINT AS k, list_distinct(list_filter(string_split(trim(regexp_replace(lower(n_name), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) >= 2)) AS t FROM nation),
p AS (SELECT q.k AS question_id, 'n' || s.k AS source_id, list_sort(list_intersect(q.t, s.t)) AS m FROM n q, n s),
r AS (SELECT *, 6.5 * len(m)::DOUBLE AS score, row_number() OVER w AS r, lead(len(m)) OVER w AS next FROM p WHERE len(m) > 0 WINDOW w AS (PARTITION BY question_id ORDER BY len(m) DESC, source_id))
SELECT question_id, source_id, score, array_to_string(m, ' ') AS matched_tokens, next IS NULL OR len(m) > next AS confident FROM r WHERE r = 1"""


@query
def runner_up_margin(spark, d):
    """orders' best and second line by price, and whether the margin is 1.5 thousand or more."""
    from pyspark.sql import Window

    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    r = li.select("l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rank"), F.lead("l_extendedprice").over(w).alias("second"))
    return r.filter("rank = 1").select("l_orderkey", "l_linenumber", (F.col("second").isNull() | (F.col("l_extendedprice") >= F.col("second") + 1500)).alias("confident"))


SQL["runner_up_margin"] = """SELECT l_orderkey, l_linenumber, s IS NULL OR l_extendedprice >= s + 1500 AS confident FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER w AS r, lead(l_extendedprice) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)) WHERE r = 1"""


@query
def stale_owner(spark, d):
    """J15, J16, N18, ST10: files by owner; those of a source that is gone go to the source with their folder."""
    o = table(spark, d, "orders")
    k = F.col("o_custkey") % 30
    files = o.select(F.col("o_orderkey").cast("string").alias("file_id"), F.concat(F.lit("n"), k.cast("string")).alias("source_id"), F.concat(F.lit("/r"), (F.col("o_custkey") % 40).cast("string"), F.lit("/a/"), F.col("o_orderkey").cast("string")).alias("path"))
    sources = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("/r"), F.col("n_nationkey").cast("string")).alias("path"), F.array(F.concat(F.lit("/r"), F.col("n_nationkey").cast("string"), F.lit("/a/"))).alias("additional_paths"))
    return matching.owned_files(files, sources).groupBy("owner_id", "how").agg(F.count("*").alias("n"))


SQL["stale_owner"] = """WITH f AS (SELECT o_custkey % 30 AS k, o_custkey % 40 AS r FROM orders)
SELECT 'n' || k AS owner_id, 'id' AS how, count(*) AS n FROM f WHERE k < 25 GROUP BY k UNION ALL SELECT 'n' || r, 'path', count(*) FROM f WHERE k >= 25 AND r < 25 GROUP BY r"""


@query
def tender_matches(spark, d):
    """Suppliers as tenders matched to sources by contract link, number or likeness."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 4
    sources = s.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit("tender").alias("source_type"), F.when(k == 0, F.col("s_suppkey").cast("string")).otherwise("").alias("hub_tender_id"), F.when(k == 1, F.concat(F.lit("c"), F.col("s_suppkey").cast("string"))).otherwise("").alias("linked_contract_id"), F.when(k == 2, F.concat(F.lit("T"), F.col("s_suppkey").cast("string"), F.lit(". object"))).otherwise(F.concat(F.lit("z"), F.col("s_suppkey").cast("string"))).alias("title"), F.lit("").alias("object_address"))
    tenders = s.select(F.col("s_suppkey").cast("string").alias("tender_id"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("linked_contract_id"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("tender_number"), F.lit("none such").alias("title"), F.lit("").alias("object_address"))
    return matching.match_tenders(tenders, sources).select("tender_id", "source_id", "strategy", "score", "confidence")


SQL["tender_matches"] = """SELECT s_suppkey::VARCHAR AS tender_id, CASE WHEN s_suppkey % 4 < 3 THEN 'src' || s_suppkey END AS source_id, ['hub_tender_id', 'linked_contract_id', 'tender_number', 'unmatched'][s_suppkey % 4 + 1] AS strategy,
[1.0, 0.95, 0.85, 0.0][s_suppkey % 4 + 1]::DOUBLE AS score, ['exact', 'high', 'high', 'none'][s_suppkey % 4 + 1] AS confidence FROM supplier"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    folders = s.select(F.col("k").alias("tender_id"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("folder"), F.when(F.col("k") % 3 == 0, "a").otherwise("b").alias("category"), F.lit("").alias("path"), F.when(F.col("k") % 5 == 0, "n1").otherwise("").alias("linked_contract_id"))
    pick = lambda mod, target: s.filter(F.col("k") % mod == 0).select(F.col("k").alias("tender_id"), target.alias("contract_id"))
    contracts = _sources(spark, d).filter("source_type = 'contract'").select("source_id")
    gone = lambda a: F.when(F.col("k") % 2 == 0, F.lit(a)).otherwise("gone")
    return matching.resolve_links(folders, pick(7, gone("n2")), contracts, pick(4, F.when(F.col("k") % 8 == 0, "n3").otherwise("gone")), pick(3, F.lit("n4")), ["a"])


@query
def link_plan(spark, d):
    """The contract of each folder by precedence."""
    return _plan(spark, d).select("tender_id", "contract_id", "link_source")


SQL["link_plan"] = """WITH s AS (SELECT s_suppkey AS k FROM supplier), l AS (SELECT k, CASE WHEN k % 7 = 0 AND k % 2 = 0 THEN 'manual' WHEN k % 5 = 0 THEN 'existing' WHEN k % 7 = 0 THEN 'manual-missing' WHEN k % 3 <> 0 THEN 'none' WHEN k % 8 = 0 THEN 'selected' WHEN k % 4 = 0 THEN 'selected-missing' ELSE 'auto' END AS s FROM s)
SELECT k AS tender_id, CASE s WHEN 'manual' THEN 'n2' WHEN 'existing' THEN 'n1' WHEN 'selected' THEN 'n3' WHEN 'auto' THEN 'n4' ELSE '' END AS contract_id, s AS link_source FROM l"""


@query
def plan_totals(spark, d):
    """A28."""
    return matching.plan_totals(_plan(spark, d))


SQL["plan_totals"] = f"""SELECT count(*) AS folders, count(*) FILTER (link_source = 'manual') AS manual, count(*) FILTER (link_source = 'existing') AS existing, count(*) FILTER (link_source = 'selected') AS selected, count(*) FILTER (link_source = 'auto') AS auto,
count(*) FILTER (link_source = 'none') AS none, count(*) FILTER (link_source = 'manual-missing') AS manual_missing, count(*) FILTER (link_source = 'selected-missing') AS selected_missing FROM ({SQL['link_plan']})"""


@query
def new_links(spark, d):
    """Page addresses of even id that no page of odd id has, without their fragment."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1).alias("source_id"), "url")
    key = F.regexp_replace("url", "#.*$", "")
    return matching.new_links(p.filter("page_id % 2 = 0").drop("page_id"), p.filter("page_id % 2 = 1").drop("page_id"), key)


SQL["new_links"] = r"""WITH p AS (SELECT page_id, regexp_extract(url, '//[^/]+/([a-z]{2})/', 1) AS source_id, url, regexp_replace(url, '#.*$', '') AS link_key FROM pages)
SELECT source_id, link_key, min(url) AS url FROM p WHERE page_id % 2 = 0 AND (source_id, link_key) NOT IN (SELECT (source_id, link_key) FROM p WHERE page_id % 2 = 1) GROUP BY ALL"""

# Audit: lineitems as items, parts as materials, suppliers as works, orders as positions


def _records(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cents = lambda c: F.round(F.col(c), 2).cast("decimal(18,2)")
    items = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), F.col("l_suppkey").cast("long").alias("tender_id"), F.col("l_orderkey").alias("position_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("material_id"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey")).alias("work_id"), F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("description"), F.when(F.col("l_linenumber") < 4, F.concat(F.lit("quotes/"), F.col("l_suppkey").cast("string"), F.lit(".pdf"))).alias("quote_link"), F.when(F.col("l_linenumber") != 7, cents("l_extendedprice")).alias("total_commercial_material_cost"), F.when(F.col("l_linenumber") % 2 == 0, cents("l_quantity")).alias("total_commercial_work_cost"))
    positions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("item_no"), F.when(F.col("o_orderkey") % 4 == 0, cents("o_totalprice")).alias("material_cost_per_unit"), F.lit(None).cast("string").alias("work_cost_per_unit"))
    return audit.price_records(items, positions, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


_RECORDS = """
r AS (SELECT l_orderkey || '-' || l_linenumber AS record_id, l_suppkey AS tender_id, coalesce(CASE WHEN l_partkey % 2 = 0 THEN p_name END, CASE WHEN l_partkey % 3 = 0 THEN s_name END, 'item ' || l_linenumber) AS position_name,
  CASE WHEN l_linenumber < 4 THEN 'quotes/' || l_suppkey || '.pdf' ELSE '' END AS quote_link, CASE WHEN l_linenumber < 4 THEN l_suppkey || '.pdf' ELSE '' END AS supplier,
  coalesce(CASE WHEN l_linenumber <> 7 THEN round(l_extendedprice, 2)::DECIMAL(18,2)::VARCHAR END, '0') AS total_commercial_material_cost, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity, 2)::DECIMAL(18,2)::VARCHAR END, '0') AS total_commercial_work_cost,
  coalesce(CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR END, '0') AS material_cost_per_unit, '0' AS work_cost_per_unit
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey)"""


@query
def boq_left_joins(spark, d):
    """J8, N44, SC24."""
    return _records(spark, d)


SQL["boq_left_joins"] = f"WITH {_RECORDS} SELECT * FROM r"


@query
def unpivot_prices(spark, d):
    """Price fields as rows, without empty ones and zeros."""
    return audit.comparable(_records(spark, d), ["record_id"]).groupBy("field").agg(F.count("*").alias("n"), F.sum(money(F.col("value"))).cast("decimal(38,6)").alias("total"))


SQL["unpivot_prices"] = f"""WITH {_RECORDS} SELECT field, count(*) AS n, sum(value::DECIMAL(38,6))::DECIMAL(38,6) AS total FROM (UNPIVOT (SELECT record_id, total_commercial_material_cost, total_commercial_work_cost, material_cost_per_unit, work_cost_per_unit FROM r) ON COLUMNS(* EXCLUDE record_id) INTO NAME field VALUE value) WHERE value <> '0' AND value <> '' GROUP BY field"""


@query
def tender_registry(spark, d):
    """J7, SC23: customers joined to a registry on two columns."""
    c = table(spark, d, "customer")
    tenders = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tender_number"), F.col("c_nationkey").cast("string").alias("title"))
    registry = table(spark, d, "nation").select(F.lit("BUILDING").alias("tender_number"), F.col("n_nationkey").cast("string").alias("title"), F.col("n_name").alias("object_address"))
    return audit.tenders_with_registry(tenders, registry).select("id", "object_address")


SQL["tender_registry"] = "SELECT c_custkey AS id, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN n_name END, '') AS object_address FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"


@query
def money_parse(spark, d):
    """Amounts written in several ways."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 5
    n = F.col("o_orderkey").cast("string")
    t = F.when(k == 0, F.concat(n, F.lit(",1234567 руб."))).when(k == 1, F.concat(F.lit(" -"), n, F.lit(" 000,5 ₽"))).when(k == 2, F.concat(n, F.lit(" рублей"))).when(k == 3, F.concat(n, F.lit(".1.2"))).otherwise("n/a")
    return o.select("o_orderkey", money_text(t).alias("amount"), money(t).alias("value"))


SQL["money_parse"] = """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '.123456' WHEN 1 THEN '-' || o_orderkey || '000.500000' WHEN 2 THEN o_orderkey || '.000000' END AS amount FROM orders) SELECT o_orderkey, amount, amount::DECIMAL(38,6) AS value FROM t"""


@query
def money_compare(spark, d):
    """M9: order totals against the sums of their lines."""
    dec = lambda c: F.round(F.col(c), 2).cast("decimal(38,6)")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(dec("l_extendedprice")).cast("decimal(38,6)").alias("lines"))
    o = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    c = compare_money(dec("o_totalprice"), F.col("lines"), 5.0)
    return o.select("o_orderkey", c.alias("c")).select("o_orderkey", "c.match", "c.delta", "c.delta_percent", "c.reason")


SQL["money_compare"] = """WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice, 2)::DECIMAL(38,6)) AS l FROM lineitem GROUP BY 1),
i AS (SELECT o_orderkey, (round(o_totalprice, 2)::DECIMAL(20,6) * 1000000)::HUGEINT AS a, (l::DECIMAL(20,6) * 1000000)::HUGEINT AS b FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, a, b, abs(a - b) AS ad, CASE WHEN b <> 0 THEN abs(b) WHEN a <> 0 THEN abs(a) ELSE 1 END AS base FROM i)
SELECT o_orderkey, coalesce(ad <= base * 50000 // 1000000, false) AS match, CASE WHEN b IS NOT NULL THEN ((a - b)::DECIMAL(38,0) / 1000000)::DECIMAL(38,6) END AS delta,
CASE WHEN b IS NOT NULL THEN ((ad * 100000000 // base) // 1000000)::DECIMAL(38,6) + ((ad * 100000000 // base) % 1000000)::DECIMAL(38,6) / 1000000 END::DECIMAL(38,6) AS delta_percent,
CASE WHEN b IS NULL THEN 'invalid_input' WHEN ad <= base * 50000 // 1000000 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS reason FROM c"""


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All records, and candidates from all parts as quotes, of the tenders 0 to 999 by the part's key."""
    p = table(spark, d, "part")
    chunks = p.select((F.col("p_partkey") % 1000).alias("tender_id"), F.col("p_partkey").cast("string").alias("chunk_id"), F.concat(F.lit("quotes/"), (F.col("p_partkey") % 50).cast("string"), F.lit(".pdf")).alias("path"), F.lit("").alias("title"), F.concat("p_name", F.lit(" цена: "), F.round("p_retailprice", 2).cast("decimal(18,2)").cast("string")).alias("text"))
    return _records(spark, d), audit.candidates(chunks)


#: The same in SQL: a labelled and a bare mention of each part's price, and the best of them for each record.
_BEST = (
    _RECORDS
    + """,
c0 AS (SELECT p_partkey % 1000 AS tender_id, p_partkey::VARCHAR AS chunk_id, 'quotes/' || (p_partkey % 50) || '.pdf' AS path, (p_partkey % 50) || '.pdf' AS c_supplier, p_name, round(p_retailprice, 2)::DECIMAL(18,2)::VARCHAR AS amount FROM part),
c AS (SELECT tender_id, chunk_id, path, c_supplier, amount, 0 AS ord, p_name AS label FROM c0 UNION ALL SELECT tender_id, chunk_id, path, c_supplier, amount, 1, p_name || ' цена:' FROM c0),
pairs AS (SELECT record_id, chunk_id, ord, amount, label, supplier, c_supplier,
  quote_link <> '' AND (contains(' ' || path || ' ' || c_supplier || ' ' || lower(trim(label)), lower(supplier)) OR contains(lower(quote_link), c_supplier)) AS q,
  contains(lower(trim(label)), lower(trim(position_name))) OR contains(lower(trim(position_name)), lower(trim(label))[1:24]) AS p FROM r JOIN c USING (tender_id)),
best AS (SELECT record_id, arg_min({'chunk_id': chunk_id, 'amount': amount, 'q': q, 'p': p}, (-(CASE WHEN q THEN 2 WHEN p THEN 1 ELSE 0 END), -(CASE WHEN q THEN 50 ELSE 0 END + CASE WHEN p THEN 30 ELSE 0 END + CASE WHEN supplier <> '' AND supplier = c_supplier THEN 20 ELSE 0 END), chunk_id, ord)) AS b FROM pairs GROUP BY record_id)"""
)


@query
def price_mentions_found(spark, d):
    """Price mentions in conversation turns with amounts put in."""
    t = F.concat("text", F.lit("\nИтого по смете: 1\u00a0250\u00a0000,50 ₽ и цена 45 00, цена: 7\u202f000.5 руб. "), F.col("conv_id").cast("string"), F.lit(" рублей"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(price_mentions(t)).alias("m")).select("conv_id", "turn", "m.amount", "m.label", "m.pattern")


_MENTION = """list_transform(list_zip(a{k}, starts{k}), lambda x: {{'amount': replace(regexp_replace(x[1], '[{sp}]+', '', 'g'), ',', '.'), 'label': trim(string_split(t[greatest(x[2] - {reach}, 0) + 1:x[2]], chr(10))[-1]), 'pattern': '{name}'}})"""
SQL["price_mentions_found"] = (
    "WITH b AS (SELECT conv_id, turn, text || chr(10) || 'Итого по смете: 1' || chr(160) || '250' || chr(160) || '000,50 ₽ и цена 45 00, цена: 7' || chr(8239) || '000.5 руб. ' || conv_id || ' рублей' AS t FROM conversations),\n"
    + "m AS (SELECT *, "
    + ", ".join(f"regexp_extract_all(t, '{p}', 0) AS m{k}, regexp_extract_all(t, '{p}', 1) AS a{k}, regexp_split_to_array(t, '{p}') AS g{k}" for k, p in ((1, LABELLED.replace("(?iu)", "(?i)")), (2, NUMBER.replace("(?iu)", "(?i)"))))
    + " FROM b),\ns AS (SELECT *, "
    + ", ".join(f"list_transform(range(1, len(m{k}) + 1), lambda i: list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0)) AS starts{k}" for k in (1, 2))
    + " FROM m),\nf AS (SELECT conv_id, turn, unnest("
    + _MENTION.format(k=1, sp=SPACE, reach=80, name="labeled_price")
    + " || "
    + _MENTION.format(k=2, sp=SPACE, reach=100, name="currency_number")
    + ") AS x, generate_subscripts(a1 || a2, 1) AS i FROM s)\n"
    + r"SELECT conv_id, turn, x.amount AS amount, x.label AS label, x.pattern AS pattern FROM f WHERE regexp_matches(x.amount, '^\d+(\.\d+)?$') AND x.amount::DOUBLE > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, x.amount, lower(regexp_replace(x.label, '\s+', ' ', 'g')) ORDER BY i) = 1"
)


@query
def price_argmax(spark, d):
    """The candidate chosen for each record."""
    records, found = _found(spark, d)
    b = audit.best_candidates(records, found)
    return b.select("record_id", F.col("best.chunk_id").alias("chunk_id"), F.col("best.amount").alias("amount"), F.col("best.by_quote").alias("by_quote"), F.col("best.by_position").alias("by_position")).distinct()


SQL["price_argmax"] = f"WITH {_BEST} SELECT DISTINCT record_id, b.chunk_id AS chunk_id, b.amount AS amount, b.q AS by_quote, b.p AS by_position FROM r LEFT JOIN best USING (record_id)"


@query
def finding_totals(spark, d):
    """Findings of all tenders, by severity, and the overall status."""
    records, found = _found(spark, d)
    f = audit.findings(records, found)
    reports = records.select("tender_id").distinct().withColumn("needs_review", F.lit(False))
    return audit.global_totals(f, reports)


_FINDINGS = (
    _BEST
    + """,
lines AS (SELECT record_id, tender_id, unnest([total_commercial_material_cost, total_commercial_work_cost, material_cost_per_unit, work_cost_per_unit]) AS v FROM r),
z AS (SELECT record_id, tender_id, b, (v::DECIMAL(20,6) * 1000000)::HUGEINT AS x, (b.amount::DECIMAL(20,6) * 1000000)::HUGEINT AS y FROM lines LEFT JOIN best USING (record_id) WHERE v <> '0' AND v <> ''),
f AS (SELECT tender_id, CASE WHEN b.q THEN 'error' ELSE 'warning' END AS severity FROM z WHERE b IS NOT NULL AND abs(x - y) > (CASE WHEN y <> 0 THEN abs(y) WHEN x <> 0 THEN abs(x) ELSE 1 END) * 10000 // 1000000
  UNION ALL SELECT tender_id, 'needs_review' FROM r LEFT JOIN best USING (record_id) WHERE b IS NULL OR len(list_filter([total_commercial_material_cost, total_commercial_work_cost, material_cost_per_unit, work_cost_per_unit], lambda v: v <> '0' AND v <> '')) = 0)"""
)
SQL["finding_totals"] = f"""WITH {_FINDINGS}, t AS (SELECT count(*) AS findings, count(*) FILTER (severity = 'error') AS high, count(*) FILTER (severity = 'warning') AS medium, count(*) FILTER (severity = 'needs_review') AS low FROM f)
SELECT (SELECT count(DISTINCT tender_id) FROM r) AS tenders_checked, findings, high, medium, low, low AS needs_review, CASE WHEN high > 0 THEN 'error' WHEN medium > 0 OR low > 0 THEN 'warning' ELSE 'ok' END AS status FROM t"""


@query
def tender_statuses(spark, d):
    """Each tender's worst finding."""
    records, found = _found(spark, d)
    tenders = records.select("tender_id").distinct()
    return audit.tender_status(audit.findings(records, found), tenders, F.lit(True), F.col("tender_id") != 3)


SQL["tender_statuses"] = f"""WITH {_FINDINGS}, w AS (SELECT tender_id, max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS w FROM f GROUP BY tender_id)
SELECT DISTINCT r.tender_id, CASE WHEN r.tender_id = 3 THEN 'needs_review' WHEN w = 3 THEN 'error' WHEN w = 2 THEN 'warning' WHEN w = 1 THEN 'needs_review' ELSE 'ok' END AS status FROM r LEFT JOIN w ON w.tender_id = r.tender_id"""


@query
def record_summary(spark, d):
    """A26."""
    r = audit.record_summary(_records(spark, d))
    return r.select("tender_id", "records", "suppliers", "quotes", F.array_join("positions", "|").alias("positions"))


SQL["record_summary"] = f"""WITH {_RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY record_id, position_name) AS i FROM r)
SELECT tender_id, count(*) AS records, count(DISTINCT nullif(supplier, '')) AS suppliers, count(DISTINCT nullif(quote_link, '')) AS quotes, string_agg(position_name, '|' ORDER BY i) FILTER (i <= 20) AS positions FROM n GROUP BY tender_id"""


@query
def history_search(spark, d):
    """Turns that hold a term, by role."""
    return table(spark, d, "conversations").filter(F.contains(F.lower("text"), F.lit("tion"))).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("n_tokens"))


SQL["history_search"] = f"SELECT role, count(*) AS n, sum(len({tokens_sql('text')}))::BIGINT AS n_tokens FROM conversations WHERE contains(lower(text), 'tion') GROUP BY role"
