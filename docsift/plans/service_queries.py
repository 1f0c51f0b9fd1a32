"""Queries on positions of chunks, previews, gates, labels, redaction of values, state and small text forms, each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsift.functions import citations, links, paths, payloads, privacy
from docsift.functions.text import chat_title, human_size, match_text, match_tokens, phrase_boost
from docsift.operators import audit, chunking, jobs, lexical, maintenance, paged, quality
from docsift.plans import service
from docsift.plans.common import BM25_SQL, documents_as_chunks, table
from docsift.plans.retrieval_queries import _prepared
from docsift.plans.state_queries import _sources
from docsift.plans.text_queries import _FILES, _files
from docsift.sources import sinks

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query
def chunk_places(spark, d):
    """Suppliers as documents of four paragraphs with pages, a sheet, rows and a section, one chunk each."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    fill = F.lit("\n" + "слово " * 200 + "\n\n")
    head = [F.concat(F.lit("## Page "), _s(k)), F.concat(F.lit("## Sheet: T"), _s(k)), F.concat(F.lit("## Page "), _s(k + 2)), F.concat(F.lit("### Part "), _s(k))]
    text = F.concat(*(x for i, h in enumerate(head) for x in (h, F.lit(f"\n| {i + 1} | a |"), fill)))
    c = chunking.chunk_with_places(s.select(k.alias("doc_id"), text.alias("text")), "doc_id")
    return c.select("doc_id", "chunk_index", F.length("chunk_text").alias("n_chars"), "page_start", "page_end", "sheet_name", "row_start", "row_end", "section_title")


SQL["chunk_places"] = """WITH k AS (SELECT s_suppkey AS doc_id, unnest(range(4))::INT AS chunk_index FROM supplier)
SELECT doc_id, chunk_index, (length(['## Page ' || doc_id, '## Sheet: T' || doc_id, '## Page ' || (doc_id + 2), '### Part ' || doc_id][chunk_index + 1]) + 10 + 1200)::INT AS n_chars,
  CASE WHEN chunk_index < 3 THEN doc_id ELSE doc_id + 2 END::INT AS page_start, CASE WHEN chunk_index < 2 THEN doc_id ELSE doc_id + 2 END::INT AS page_end,
  CASE WHEN chunk_index > 0 THEN 'T' || doc_id END AS sheet_name, chunk_index + 1 AS row_start, chunk_index + 1 AS row_end, CASE WHEN chunk_index = 3 THEN 'Part ' || doc_id END AS section_title FROM k"""


@query
def phrase_boosts(spark, d):
    """the bonus of turns that state a contract's price, for questions that ask for it and others."""
    t, k = table(spark, d, "conversations"), F.col("conv_id") % 4
    text = F.concat("text", F.when(k == 0, " Цена договора составляет 1 250 000,50").when(k == 1, " цену работ по договору").when(k == 2, " стоимость подготовительных работ").otherwise(""))
    asked = F.when(F.col("turn") % 2 == 0, F.array(F.lit("цена"), F.lit("договора"))).otherwise(F.array(F.lit("цена")))
    return t.select("conv_id", "turn", F.round(phrase_boost(text, asked), 3).alias("boost"))


SQL["phrase_boosts"] = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [0.12, 0.04, -0.04, 0.0][conv_id % 4 + 1] ELSE 0.0 END::DOUBLE AS boost FROM conversations"


@query
def sanitized_values(spark, d):
    """Structs with secrets, addresses and paths, cleaned by key name and content."""
    e = table(spark, d, "events")
    k = _s("event_id")
    inner = F.struct(F.concat(F.lit("pw"), k).alias("password"), F.concat(F.lit("https://u:p@h/"), k).alias("url"), F.array(F.concat(F.lit("Bearer abc"), k)).alias("notes"))
    df = e.select("event_id", F.concat(F.lit("/home/x/"), k, F.lit(".txt")).alias("path"), inner.alias("inner"), F.create_map(F.lit("token"), k, F.lit("plain"), F.concat(F.lit("n"), k)).alias("props"))
    c = privacy.sanitize_frame(df, mask_paths=True)
    return c.select("event_id", "path", "inner.password", "inner.url", F.array_join("inner.notes", "|").alias("notes"), c["props"]["token"].alias("token"), c["props"]["plain"].alias("plain"))


SQL["sanitized_values"] = """SELECT event_id, event_id || '.txt#' || sha256('/home/x/' || event_id || '.txt')[1:8] AS path, '[redacted]' AS password, event_id || '#' || sha256('https://u:p@h/' || event_id)[1:8] AS url,
'Bearer [redacted]' AS notes, '[redacted]' AS token, 'n' || event_id AS plain FROM events"""


@query
def preview_files(spark, d):
    """The file that a preview shows, by chunk path, by id and by path; an escaped path shows none."""
    f = table(spark, d, "supplier").select(F.concat(F.lit("f"), _s("s_suppkey")).alias("file_id"), F.concat(F.lit("/p/"), _s(F.col("s_suppkey") % 7)).alias("path"))
    asked = (("chunk", {"chunk_path": "/p/3", "file_id": "f2"}), ("id", {"file_id": "f2", "path": "/p/3"}), ("path", {"path": "/p/4"}), ("escaped", {"path": "/p/%2e"}), ("none", {"file_id": "gone"}))
    out = None
    for how, key in asked:
        row = service.preview_target(f, **key).select(F.lit(how).alias("how"), "file_id", "path")
        out = row if out is None else out.unionByName(row)
    return out


SQL["preview_files"] = """WITH f AS (SELECT 'f' || s_suppkey AS file_id, '/p/' || (s_suppkey % 7) AS path FROM supplier)
SELECT 'chunk' AS how, min(file_id) AS file_id, '/p/3' AS path FROM f WHERE path = '/p/3' UNION ALL SELECT 'id', file_id, path FROM f WHERE file_id = 'f2' UNION ALL SELECT 'path', min(file_id), '/p/4' FROM f WHERE path = '/p/4'"""


@query
def all_lexical(spark, d):
    """The lexical score of every document that shares a term with an item, the three best."""
    return lexical.all_lexical_top(documents_as_chunks(spark, d), _prepared(spark, d), 3).select("query_id", "chunk_id", "score", "rank")


SQL["all_lexical"] = f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 3"


@query
def resolved_scope(spark, d):
    """Which contract a question is about, and the sources that go with it."""
    sources, rows = _sources(spark, d), []
    n = table(spark, d, "nation").orderBy("n_nationkey").first()
    for how, question, extra in (("ambiguous", f"какая цена по {n['n_name'].lower()} договору", {}), ("all", "сравни по всем проектам цены", {}), ("context", "а срок?", {"context": "n1"}), ("requested", "цена", {"requested": "n2"}), ("missing", "цена", {"requested": "gone"})):
        s = service.resolve_scope(question, sources, **extra)
        rows.append((how, s["source_id"], len(s["source_ids"]), s["all_sources"], s["context_used"], s["missing"]))
    return spark.createDataFrame(rows, "how string, source_id string, n_sources int, all_sources boolean, context_used boolean, missing boolean")


SQL["resolved_scope"] = """WITH c AS (SELECT 'n' || n_nationkey AS id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::INT + 1 AS n FROM nation)
SELECT 'ambiguous' AS how, '' AS source_id, 0 AS n_sources, true AS all_sources, false AS context_used, false AS missing UNION ALL SELECT 'all', '', 0, true, false, false
UNION ALL SELECT 'context', id, n, false, true, false FROM c WHERE id = 'n1' UNION ALL SELECT 'requested', id, n, false, false, false FROM c WHERE id = 'n2' UNION ALL SELECT 'missing', '', 0, false, false, true"""


@query
def merged_vectors(spark, d):
    """SK9, SK8, J4: stored vectors with fresh ones in place of those of the same chunk."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.get("embedding", F.lit(0)).alias("first"))
    fresh = v.filter("chunk_id % 3 = 0").select((F.col("chunk_id") * 2).alias("chunk_id"), F.lit(1.5).cast("float").alias("first"))
    return maintenance.merge_vectors(v, fresh, "chunk_id").select("chunk_id", F.round(F.col("first").cast("double"), 6).alias("first"))


SQL["merged_vectors"] = """WITH f AS (SELECT vec_id * 2 AS id FROM embeddings WHERE vec_id % 3 = 0)
SELECT vec_id AS chunk_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id NOT IN (SELECT id FROM f) UNION ALL SELECT id, 1.5 FROM f"""


@query
def text_gates(spark, d):
    """P14, SC13, F12, N15: whether a text layer or a scanned page is usable, and which of two texts is taken."""
    q = quality.with_text_quality(table(spark, d, "documents"), out="q")
    q = quality.with_text_quality(q, out="p", min_chars=20, min_words=3)
    conf = (F.col("doc_id") % 60).cast("int")
    return q.select("doc_id", quality.usable_text_layer(F.col("q")).alias("layer"), quality.usable_page(F.col("p"), conf).alias("page"), quality.choose_text(F.col("q"), F.struct((F.col("q.score") + F.col("doc_id") % 25).alias("score"))).alias("taken"))


_GATES = _FILES[: _FILES.index(",\nff AS")]
SQL["text_gates"] = f"""WITH {_GATES},
g2 AS (SELECT *, chars >= 120 AND words >= 10 AND score >= 70 AND NOT list_has_any(warnings, ['encoding_noise', 'ocr_text_noise']) AS layer,
  chars >= 20 AND words >= 3 AND NOT severe AND br <= 0.01 AND NOT (chars >= 20 AND lr < 0.2) AND doc_id % 60 >= 25 AS page FROM qual)
SELECT doc_id, layer, page, CASE WHEN NOT layer OR doc_id % 25 > 10 THEN 'ocr' ELSE 'text-layer' END AS taken FROM g2"""


@query
def ocr_cache(spark, d):
    """Cached scans with fewer pages than are wanted."""
    e = table(spark, d, "events")
    stale = maintenance.stale_ocr_cache(F.col("event_id") % 10, F.col("user_id") % 15, F.col("event_id") % 3 * 4)
    return e.groupBy(stale.alias("stale")).agg(F.count("*").alias("n"))


SQL["ocr_cache"] = "SELECT event_id % 10 < CASE WHEN event_id % 3 > 0 THEN least(event_id % 3 * 4, user_id % 15) ELSE user_id % 15 END AS stale, count(*) AS n FROM events GROUP BY 1"


@query
def file_lists(spark, d):
    """Files by the filters of a list: all, searchable, and each status."""
    return service.quality_counts(_files(spark, d))


SQL["file_lists"] = f"""WITH {_FILES} SELECT 'all' AS wanted, count(*) AS n FROM files UNION ALL SELECT 'searchable', count(*) FROM files WHERE chunks > 0 UNION ALL SELECT 'ok', count(*) FROM files WHERE status = 'ok'
UNION ALL SELECT 'warning', count(*) FROM files WHERE status = 'warning' UNION ALL SELECT 'error', count(*) FROM files WHERE status = 'error'"""


@query
def overview(spark, d):
    """One row of counts of files and jobs, and the overall status."""
    users = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    k = F.col("user_id") % 3
    latest = users.select(F.when(k == 0, "running").otherwise("completed").alias("status"), (F.col("user_id") % 2).alias("failed"), F.when((k == 0) & (F.col("user_id") % 2 == 0), "stale").otherwise("active").alias("health"))
    return service.index_overview(_files(spark, d), latest)


SQL["overview"] = f"""WITH {_FILES}, u AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT count(*) AS indexed, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'error') AS error, 0::BIGINT AS unchecked, count(*) FILTER (chunks > 0 AND status <> 'error') AS recognized, sum(chunks)::BIGINT AS chunks FROM files),
j AS (SELECT count(*) FILTER (user_id % 3 = 0) AS running, count(*) FILTER (user_id % 6 = 0) AS stale, 0::BIGINT AS interrupted, sum(user_id % 2)::BIGINT AS failed FROM u)
SELECT *, 'warning' AS overall FROM f, j"""


@query
def retry_reports(spark, d):
    """What second conversions brought, by source."""
    # A generator between the verdicts and what is told of them, so that the verdicts are worked out once for each file.
    f = _files(spark, d).select(F.inline(F.array(F.struct("file_id", "source_id", "status", "score", "warnings"))))
    after = F.struct(F.when(F.col("file_id") % 3 == 0, "ok").otherwise(F.col("status")).alias("status"), F.when(F.col("file_id") % 3 == 0, 100).otherwise(F.col("score")).alias("score"), F.when(F.col("file_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("warnings")).alias("warnings"))
    before = F.struct("status", "score", "warnings")
    r = quality.retry_report(before, after, F.col("file_id") % 7 == 0)
    reasons = quality.retry_reasons(before, F.lit(False))
    done = f.select("source_id", F.inline(F.array(F.struct(r.alias("r"), reasons.alias("why")))))
    done = done.withColumn("reindex", F.struct((F.size("why") > 0).alias("retried"), F.col("r.status").alias("status"), F.col("why").alias("reasons")))
    return quality.retry_summary(done)


SQL["retry_reports"] = f"""WITH {_FILES}, t AS (SELECT * FROM files WHERE status = 'error' OR score < 60 OR len(warnings) > 0)
SELECT source AS source_id, count(*) AS retried, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 = 0) AS resolved, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 <> 0) AS unresolved, count(*) FILTER (doc_id % 7 = 0) AS failed, 0::BIGINT AS recovered_errors FROM t GROUP BY source"""


@query
def match_words(spark, d):
    """turns as match text, and their distinct words that aren't stop words."""
    t = F.concat(F.lit("Какой Срок по проекту Ёлка-1: "), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha1(match_text(t)).alias("digest"), F.size(match_tokens(t)).cast("long").alias("n"))


SQL["match_words"] = r"""WITH m AS (SELECT conv_id, turn, trim(regexp_replace(translate(lower('Какой Срок по проекту Ёлка-1: ' || text), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')) AS m FROM conversations)
SELECT conv_id, turn, sha1(m) AS digest, len(list_distinct(list_filter(string_split(m, ' '), lambda x: length(x) >= 2 AND x NOT IN ('какой', 'срок', 'по', 'проекту', 'на', 'в', 'во', 'и', 'или', 'а', 'к', 'ко', 'о', 'об', 'от', 'для', 'из', 'с', 'со', 'ооо', 'зао', 'пао', 'ао', 'жк'))))::BIGINT AS n FROM m"""


@query
def citation_targets(spark, d):
    """where citations point, as structs."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("s"), _s(F.col("page_id") % 5)).alias("source_id"), _s("page_id").alias("chunk_id"), F.lit("").alias("title"), F.concat(F.lit("dir/p"), _s("page_id"), F.lit(".pdf")).alias("path"), F.col("page_id").cast("int").alias("page_start"), F.col("page_id").cast("int").alias("page_end"), F.col("html").alias("text"))
    t = p.select("page_id", citations.target(p, (F.col("page_id") % 9).cast("int")).alias("t"))
    return t.select("page_id", "t.citation_id", "t.index", "t.source_id", "t.chunk_id", "t.file_label", "t.label", F.sha1("t.snippet").alias("digest"))


SQL["citation_targets"] = """SELECT page_id, (page_id % 9 + 1)::INT AS citation_id, (page_id % 9)::INT AS "index", 's' || (page_id % 5) AS source_id, page_id::VARCHAR AS chunk_id, 'p' || page_id || '.pdf' AS file_label, 'p' || page_id || '.pdf, стр. ' || page_id AS label, sha1(html[1:1200]) AS digest FROM pages"""


@query
def preview_windows(spark, d):
    """The lines around a range of each document."""
    s = F.least(F.length("text"), (F.col("doc_id") * 37 % 5000).cast("int"))
    e = F.least(F.length("text"), s + 50)
    p = table(spark, d, "documents").select("doc_id", citations.preview(F.col("text"), s, e).alias("p"))
    return p.select("doc_id", F.sha1("p.text").alias("digest"), "p.focus_start", "p.focus_end", "p.cut_before", "p.cut_after")


SQL["preview_windows"] = """WITH a AS (SELECT doc_id, text AS t, length(text) AS n, least(length(text), doc_id * 37 % 5000) AS s FROM documents), b AS (SELECT *, least(n, s + 50) AS e FROM a),
c AS (SELECT *, t[1:greatest(0, s - 520)] AS head, t[least(n, e + 760) + 1:] AS tail FROM b),
w AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN length(head) - length(string_split(head, chr(10))[-1]) ELSE 0 END AS f, least(n, e + 760) + length(string_split(tail, chr(10))[1]) AS l FROM c)
SELECT doc_id, sha1(t[f + 1:l]) AS digest, (s - f)::INT AS focus_start, (e - f)::INT AS focus_end, f > 0 AS cut_before, l < n AS cut_after FROM w"""


@query
def path_facts(spark, d):
    """Names and extensions of paths, containment in a root, and temporary folders."""
    k = F.col("page_id")
    p = F.concat(F.when(k % 4 == 0, "/tmp/").when(k % 4 == 1, "/root/a/../").when(k % 4 == 2, "/root/a/").otherwise("/root/ab/"), F.lit("N"), _s(k), F.when(k % 2 == 0, ".PDF").otherwise(""))
    return table(spark, d, "pages").select("page_id", paths.base_name(p).alias("name"), paths.extension(p).alias("extension"), paths.inside(F.lit("/root/a"), p).alias("inside"), service.temporary_path(p).alias("temporary"))


SQL["path_facts"] = "SELECT page_id, 'N' || page_id || CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '' END AS name, CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '' END AS extension, page_id % 4 = 2 AS inside, page_id % 4 = 0 AS temporary FROM pages"


@query
def front_matters(spark, d):
    """F46, SK11: cached texts under a block of fields, and both read back."""
    t = sinks.with_front_matter(F.col("text"), file_id=F.col("doc_id"), source=F.col("source"), note=F.lit('a "b"\n'))
    back = sinks.front_matter(t)
    return table(spark, d, "documents").select("doc_id", back["file_id"].alias("file_id"), back["source"].alias("source"), back["note"].alias("note"), (sinks.without_front_matter(t) == F.col("text")).alias("same"))


SQL["front_matters"] = r"""SELECT doc_id, doc_id::VARCHAR AS file_id, '"' || source || '"' AS source, '"a \"b\"\n"' AS note, true AS same FROM documents"""


@query
def stream_events(spark, d):
    """turns as server-sent events, two in a text, and read back."""
    t = F.concat(sinks.event_text(F.lit("token"), F.col("text")), F.lit("data: plain\r\n\r\n"))
    e = table(spark, d, "conversations").select("conv_id", "turn", "text", F.posexplode(sinks.parsed_events(t)).alias("i", "e"))
    return e.select("conv_id", "turn", F.col("i").cast("long").alias("i"), "e.event", (F.col("e.data") == F.when(F.col("i") == 0, F.col("text")).otherwise("plain")).alias("same"))


SQL["stream_events"] = "SELECT conv_id, turn, i::BIGINT AS i, CASE i WHEN 0 THEN 'token' ELSE 'message' END AS event, true AS same FROM conversations, (SELECT unnest([0, 1]) AS i)"


@query
def titles_and_sizes(spark, d):
    """chat titles of turns, and sizes as people read them."""
    n = F.col("turn") * 700 + F.col("conv_id") * 1000
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha1(chat_title(F.concat(F.lit('<b>"'), "text", F.lit('"</b>')))).alias("digest"), human_size(n).alias("size"))


SQL["titles_and_sizes"] = r"""WITH t AS (SELECT conv_id, turn, turn * 700 + conv_id * 1000 AS n, trim(regexp_replace(regexp_replace('<b>"' || text || '"</b>', '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM conversations)
SELECT conv_id, turn, sha1(trim(regexp_replace(c, '^["''«»“”`]+|["''«»“”`.]+$', '', 'g'))[1:72]) AS digest, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size FROM t"""


@query
def file_names(spark, d):
    """names that file systems take, and those of download headers."""
    k = _s("p_partkey")
    head = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("attachment; filename=\"x\"; filename*=UTF-8''a%20"), k)).otherwise(F.concat(F.lit('attachment; filename="b '), k, F.lit('"')))
    return table(spark, d, "part").select("p_partkey", links.file_name(F.concat("p_name", F.lit("<a>/b:c?  "), k)).alias("name"), links.disposition_name(head).alias("header"))


SQL["file_names"] = "SELECT p_partkey, trim(regexp_replace(p_name || ' a b c ' || p_partkey, '\\s+', ' ', 'g'))[1:120] AS name, CASE WHEN p_partkey % 2 = 0 THEN 'a ' || p_partkey ELSE 'b ' || p_partkey END AS header FROM part"


@query
def job_progress(spark, d):
    """The progress of events as jobs, in per cent."""
    p = jobs.progress_percent(F.col("event_id") % 120, F.col("user_id") % 100, F.when(F.col("event_id") % 11 == 0, "completed").otherwise("running"))
    return table(spark, d, "events").groupBy(p.alias("percent")).agg(F.count("*").alias("n"))


SQL["job_progress"] = "SELECT CASE WHEN event_id % 11 = 0 THEN 100 WHEN user_id % 100 > 0 THEN least(99, floor(100.0 * (event_id % 120) / (user_id % 100))) ELSE 0 END::INT AS percent, count(*) AS n FROM events GROUP BY 1"


@query
def page_crops(spark, d):
    """Parts on pages of an index, the first with the text of its blocks within a budget."""
    p = table(spark, d, "part")
    chunks = p.select(F.lit("v").alias("file_path"), F.col("p_partkey").alias("page"), F.lit(0).alias("chunk_ord"), F.col("p_name").alias("text"), F.array(F.concat(F.lit("a"), _s("p_partkey")), F.concat(F.lit("b"), _s("p_partkey"))).alias("block_ids"))
    index = p.filter("p_partkey % 3 = 0").select(F.lit("v").alias("file_path"), F.col("p_partkey").alias("page"))
    crops = p.select(F.concat(F.lit("a"), _s("p_partkey")).alias("block_id"), F.repeat(F.lit("x"), 2999).alias("crop")).unionByName(p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("b"), _s("p_partkey")).alias("block_id"), F.lit("yyyy").alias("crop")))
    c = paged.with_crops(paged.on_index(chunks, index), crops, ["file_path", "page"])
    return c.select("page", "has_crop_text", F.length("text").cast("long").alias("n_chars"), "text_hash")


SQL["page_crops"] = """WITH t AS (SELECT p_partkey AS page, p_name || chr(10) || repeat('x', 2999) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'y' ELSE '' END AS t FROM part WHERE p_partkey % 3 = 0)
SELECT page, true AS has_crop_text, length(t)::BIGINT AS n_chars, sha256(t) AS text_hash FROM t"""


@query
def proposals(spark, d):
    """P6, W14, ST9: chunks of commercial proposals, and those that an interrupted audit has left."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "tender").otherwise("contract").alias("source_type"), (F.col("event_id") % 3 == 0).alias("tender_commercial_proposal"), F.when(F.col("event_id") % 5 == 0, "commercial_proposal").otherwise("tender_file").alias("tender_document_type"), F.when(F.col("event_id") % 7 > 0, True).alias("tender_has_price_signals"))
    kept = e.filter(audit.is_proposal(e))
    return audit.remaining(kept, 1000, "event_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


SQL["proposals"] = "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE user_id % 2 = 0 AND (event_id % 3 = 0 OR event_id % 5 = 0) AND event_id % 7 > 0 AND event_id > 1000"


@query
def chat_model_list(spark, d):
    """Parts as models, without those for embeddings."""
    p = table(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "text-Embedding-").otherwise("chat-"), _s("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 5 == 0, "embeddings").otherwise("llm").alias("type"))
    return service.chat_models(p)


SQL["chat_model_list"] = "SELECT 'chat-' || p_partkey AS id, 'llm' AS type FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0"


@query
def source_list(spark, d):
    """Sources with their counts and a masked path."""
    s = table(spark, d, "nation").select(F.concat(F.lit("src"), _s("n_nationkey")).alias("source_id"), F.col("n_name").alias("title"), F.concat(F.lit("/data/"), "n_name").alias("path"))
    return service.list_sources(s, _files(spark, d))


SQL["source_list"] = f"""WITH {_FILES}, c AS (SELECT source, count(*) AS files, sum(chunks)::BIGINT AS chunks FROM files GROUP BY source)
SELECT 'src' || n_nationkey AS source_id, n_name AS title, n_name || '#' || sha256('/data/' || n_name)[1:8] AS path, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks FROM nation LEFT JOIN c ON c.source = 'src' || n_nationkey"""


@query
def rerank_payloads(spark, d):
    """JS4, B4: answers of a reranker in several shapes, and the scores that they give."""
    k = F.col("event_id") % 4
    n = _s(F.col("event_id") % 100)
    row = lambda i, score: F.concat(F.lit("{"), F.lit(i), F.lit(", "), F.lit(score), n, F.lit("}"))
    good = F.concat(F.when(k == 0, '{"results": [').otherwise('{"data": ['), row('"index": 1', '"relevance_score": 0.'), F.lit(","), row('"document": {"index": 2}', '"score": 1'), F.lit(","), row('"id": "3"', '"relevanceScore": -'), F.lit(',{"index": 4},{"index": 1.5, "score": 2}]}'))
    r = payloads.rerank_rows(F.when(k < 2, good).when(k == 2, '{"error": "no"}').otherwise("not JSON"))
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(r, lambda x: x["index"].cast("string")), ",").alias("order"), F.round(F.get(r, F.lit(0))["score"], 6).alias("best"))


SQL["rerank_payloads"] = """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '2,1,3' ELSE '' END AS "order", CASE WHEN event_id % 4 < 2 THEN ('1' || (event_id % 100))::DOUBLE END AS best FROM events"""


@query
def model_payloads(spark, d):
    """JS5: lists of models in several shapes."""
    k, n = F.col("p_partkey") % 4, _s("p_partkey")
    item = F.concat(F.lit('[{"id": "m'), n, F.lit('", "type": "llm", "state": "loaded"}, {"modelKey": "k'), n, F.lit('", "object": "model", "loaded": false}, {"type": "x"}]'))
    text = F.when(k == 0, F.concat(F.lit('{"data": '), item, F.lit("}"))).when(k == 1, F.concat(F.lit('{"models": '), item, F.lit("}"))).when(k == 2, item).otherwise('{"x": 1}')
    r = payloads.model_rows(text)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(r, lambda m: F.concat_ws(":", m["id"], m["type"], m["state"], m["loaded"].cast("string"))), ",").alias("models"))


SQL["model_payloads"] = "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'm' || p_partkey || ':llm:loaded:true,k' || p_partkey || ':model:not-loaded:false' ELSE '' END AS models FROM part"


@query
def model_choices(spark, d):
    """The model that a setting means: exact, by case, by key, by the best variant, or none."""
    models = F.array(*map(F.lit, ("pub/Alpha-7b@q4", "pub/Alpha-7b@q8", "Beta", "gamma-1")))
    wanted = F.get(F.array(*map(F.lit, ("Beta", "beta", "GAMMA_1", "alpha-7B", "pub/alpha-7b@q4", "none", ""))), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, d, "part").select("p_partkey", payloads.matched_model(wanted, models).alias("model"))


SQL["model_choices"] = "SELECT p_partkey, ['Beta', 'Beta', 'gamma-1', 'pub/Alpha-7b@q8', 'pub/Alpha-7b@q4', '', ''][p_partkey % 7 + 1] AS model FROM part"


@query
def merged_maps(spark, d):
    """MP3, MP2: events' properties under others that win."""
    e = table(spark, d, "events")
    own = F.from_json("props", "map<string,string>")
    other = F.create_map(F.lit("k"), F.when(F.col("event_id") % 3 > 0, F.lit("new")), F.lit("z"), _s("event_id"))
    m = payloads.merged_map(own, F.when(F.col("event_id") % 2 == 0, other).otherwise(F.create_map(F.lit("z"), F.lit("1"))))
    return e.select("event_id", m["k"].alias("k"), m["z"].alias("z"), F.size(m).cast("long").alias("n"))


SQL["merged_maps"] = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 > 0 THEN 'new' END ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '1' END AS z, 2::BIGINT AS n FROM events"


@query
def natural_order(spark, d):
    """Names of volumes in the order in which people read their numbers."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Том ").otherwise("том "), _s(F.col("p_partkey") % 250), F.lit("-"), _s("p_partkey"))
    p = table(spark, d, "part").select("p_partkey", payloads.natural_key(name).alias("_key"))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy((F.col("p_partkey") % 5).alias("_g")).orderBy("_key")).cast("long").alias("place"))


SQL["natural_order"] = "SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey % 250, p_partkey) AS place FROM part"
