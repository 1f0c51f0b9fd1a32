"""Queries on text quality, rollups, links, privacy, paths and paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import links, paths, privacy
from docsift.functions.text import ENDINGS, collapse_html, fuzzy_score, noise_report, plural_ru, token_variants, truncate_text
from docsift.operators import chunking, paged, quality, recognition
from docsift.plans.common import normalized_sql, table

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


_QUALITY = f"""
n AS (SELECT doc_id, source, {normalized_sql('text')} AS t FROM documents),
m AS (SELECT doc_id, source, t, length(t) AS chars, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]{{2,}}') AS ws, len(regexp_extract_all(t, '\\x{{FFFD}}')) AS bad FROM n),
k AS (SELECT *, len(ws) AS words, list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}')) AS lw FROM m),
z AS (SELECT *, len(lw) AS letter_tokens, len(list_filter(lw, lambda w: regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}'))) AS mixed,
  len(list_filter(lw, lambda w: NOT (regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}')) AND length(w) >= 4 AND regexp_matches(w, '\\p{{N}}'))) AS digits FROM k),
r AS (SELECT *, CASE WHEN letter_tokens > 0 THEN (mixed + digits) / letter_tokens::DOUBLE ELSE 0.0 END AS noise, CASE WHEN chars > 0 THEN letters / chars::DOUBLE ELSE 0.0 END AS lr, CASE WHEN chars > 0 THEN bad / chars::DOUBLE ELSE 0.0 END AS br FROM z),
w AS (SELECT *, mixed + digits >= 3 AND noise >= 0.08 AS severe FROM r),
g AS (SELECT *, list_filter([CASE WHEN chars < 120 THEN 'too_little_text' END, CASE WHEN words < 25 THEN 'too_few_words' END, CASE WHEN chars >= 120 AND lr < 0.2 THEN 'low_text_density' END,
  CASE WHEN br > 0.01 THEN 'encoding_noise' END, CASE WHEN severe THEN 'ocr_text_noise' END], lambda x: x IS NOT NULL) AS warnings FROM w),
qq AS (SELECT *, 100 - CASE WHEN list_contains(warnings, 'too_little_text') THEN 30 ELSE 0 END - CASE WHEN list_contains(warnings, 'too_few_words') THEN 20 ELSE 0 END - CASE WHEN list_contains(warnings, 'low_text_density') THEN 20 ELSE 0 END
  - CASE WHEN list_contains(warnings, 'encoding_noise') THEN 25 ELSE 0 END - CASE WHEN list_contains(warnings, 'ocr_text_noise') THEN 35 ELSE 0 END AS raw FROM g),
qual AS (SELECT *, greatest(0, least(100, raw)) AS score FROM qq)"""


@query
def text_quality(spark, d):
    """F11."""
    q = quality.with_text_quality(table(spark, d, "documents"))
    c = F.col
    return q.select("doc_id", c("quality.score").alias("score"), F.array_join("quality.warnings", ",").alias("warnings"), c("quality.chars").alias("chars"), c("quality.words").alias("words"), c("quality.letter_ratio").alias("letter_ratio"), c("quality.noise_ratio").alias("noise_ratio"), c("quality.noisy_tokens").alias("noisy_tokens"))


SQL["text_quality"] = f"WITH {_QUALITY} SELECT doc_id, score::INT AS score, array_to_string(warnings, ',') AS warnings, chars::INT AS chars, words::INT AS words, round(lr, 3) AS letter_ratio, round(noise, 3) AS noise_ratio, (mixed + digits)::INT AS noisy_tokens FROM qual"


@query
def noise_tokens(spark, d):
    """F10."""
    n = noise_report(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", "n.letter_tokens", "n.mixed_script_tokens", "n.alpha_digit_tokens", "n.severe")


SQL["noise_tokens"] = f"WITH {_QUALITY} SELECT doc_id, letter_tokens::INT AS letter_tokens, mixed::INT AS mixed_script_tokens, digits::INT AS alpha_digit_tokens, severe FROM qual"

_CHUNKS = "CASE WHEN chars = 0 THEN 0 WHEN chars <= 1800 THEN 1 ELSE ceil(chars / 1580.0) END"
_FILES = (
    _QUALITY
    + f""",
ff AS (SELECT doc_id, source, ({_CHUNKS})::INT AS chunks, chars, words, CASE WHEN ({_CHUNKS}) = 0 THEN list_concat(warnings, ['no_chunks']) ELSE warnings END AS warnings, severe, CASE WHEN ({_CHUNKS}) = 0 THEN 0 ELSE score END AS score FROM qual),
files AS (SELECT doc_id, source, chunks, chars, words, warnings, score, CASE WHEN chunks = 0 OR chars < 80 OR severe THEN 'error' WHEN len(warnings) > 0 THEN 'warning' ELSE 'ok' END AS status FROM ff)"""
)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the role of indexed files."""
    docs = table(spark, d, "documents").withColumn("chunks", F.size(chunking.pack(quality.normalize_text(F.col("text")))))
    q = quality.verify(docs).withColumn("iq", F.col("index_quality"))
    return q.select(F.col("doc_id").alias("file_id"), F.col("source").alias("source_id"), "lang", "iq.status", "iq.score", "iq.warnings", "iq.chars", "iq.words", "iq.chunks")


@query
def index_quality(spark, d):
    """The verdict on each document as an indexed file."""
    return _files(spark, d).select(F.col("file_id").alias("doc_id"), "status", "score", F.array_join("warnings", ",").alias("warnings"), "chunks")


SQL["index_quality"] = f"WITH {_FILES} SELECT doc_id, status, score::INT AS score, array_to_string(warnings, ',') AS warnings, chunks FROM files"


@query
def quality_histogram(spark, d):
    """Files by source and status."""
    return _files(spark, d).groupBy("source_id", "status").agg(F.count("*").alias("n"))


SQL["quality_histogram"] = f"WITH {_FILES} SELECT source AS source_id, status, count(*) AS n FROM files GROUP BY ALL"


@query
def source_summary(spark, d):
    """Each source's rollup and its summary line."""
    roll = quality.source_rollup(_files(spark, d))
    text = quality.summary_text(F.col("files"), F.col("chunks"), F.col("warnings"))
    return roll.select("source_id", "files", "ok_files", "warning_files", "error_files", "searchable", "with_text", "chunks", "total_chars", "avg_chars", "avg_words", "score", "text_coverage", "status", text.alias("summary"))


SQL["source_summary"] = f"""WITH {_FILES},
s AS (SELECT source AS source_id, count(*) AS files, count(*) FILTER (status = 'ok') AS ok_files, count(*) FILTER (status = 'warning') AS warning_files, count(*) FILTER (status = 'error') AS error_files, count(*) FILTER (chunks > 0) AS searchable,
  count(*) FILTER (chunks > 0 OR chars >= 80) AS with_text, sum(chunks)::BIGINT AS chunks, sum(chars)::BIGINT AS total_chars, floor(avg(chars) + 0.5)::INT AS avg_chars, floor(avg(words) + 0.5)::INT AS avg_words, floor(avg(score) + 0.5)::INT AS score,
  sum(CASE WHEN len(warnings) > 0 THEN len(list_distinct(warnings)) WHEN status = 'error' THEN 1 ELSE 0 END)::BIGINT AS w FROM files GROUP BY source)
SELECT source_id, files, ok_files, warning_files, error_files, searchable, with_text, chunks, total_chars, avg_chars, avg_words, score, floor(100.0 * searchable / files + 0.5)::INT AS text_coverage,
  CASE WHEN error_files > 0 OR score < 60 THEN 'error' WHEN warning_files > 0 OR score < 85 THEN 'warning' ELSE 'ok' END AS status,
  files || ' file' || CASE WHEN files = 1 THEN '' ELSE 's' END || ', ' || chunks || ' chunk' || CASE WHEN chunks = 1 THEN '' ELSE 's' END || ', ' || CASE WHEN w > 0 THEN w || ' quality warning' || CASE WHEN w = 1 THEN '' ELSE 's' END ELSE 'no quality warnings' END || '.' AS summary FROM s"""


@query
def warning_histogram(spark, d):
    """A14, T10."""
    return quality.warning_histogram(_files(spark, d)).select("source_id", "warning", F.col("count").alias("n"))


SQL["warning_histogram"] = f"""WITH {_FILES}
SELECT source AS source_id, w AS warning, count(*) AS n FROM (SELECT source, unnest(CASE WHEN len(warnings) > 0 THEN list_distinct(warnings) WHEN status = 'error' THEN ['quality_error'] ELSE [] END) AS w FROM files) GROUP BY ALL"""


@query
def index_snapshot_rollup(spark, d):
    """Files, searchable and chunks by source, and in all under a null source."""
    files = _files(spark, d).withColumn("indexed_at", F.timestamp_seconds(F.lit(1700000000) + F.col("file_id")))
    return quality.snapshot(files)


SQL["index_snapshot_rollup"] = f"WITH {_FILES} SELECT source AS source_id, count(*) AS files, count(*) FILTER (chunks > 0) AS searchable, sum(chunks)::BIGINT AS chunks, make_timestamp((max(1700000000 + doc_id) * 1000000)::BIGINT) AS indexed_at FROM files GROUP BY ROLLUP (source)"


@query
def retry_decisions(spark, d):
    """F15, ST8: which documents a second conversion should get, and why."""
    files = _files(spark, d).withColumn("q", F.struct("status", "score", "warnings"))
    r = quality.retry_decision(F.col("q"), F.col("file_id") % 2 == 0, (F.col("file_id") % 5 == 0).cast("int"))
    return files.select(F.col("file_id").alias("doc_id"), r.alias("r")).select("doc_id", "r.queued", "r.reason", F.array_join("r.reasons", ",").alias("reasons"))


SQL["retry_decisions"] = f"""WITH {_FILES},
why AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_filter([CASE WHEN status = 'error' THEN 'quality_error' END, CASE WHEN score < 60 THEN 'low_quality_score' END], lambda x: x IS NOT NULL) || warnings || CASE WHEN doc_id % 2 = 0 AND len(warnings) > 0 THEN ['cached_quality_warning'] ELSE [] END END AS reasons FROM files)
SELECT doc_id, len(reasons) > 0 AS queued, CASE WHEN doc_id % 5 = 0 THEN 'max_attempts' WHEN len(reasons) > 0 THEN 'quality' ELSE 'not_needed' END AS reason, array_to_string(reasons, ',') AS reasons FROM why"""


@query
def p10_floor(spark, d):
    """Events as pages with a confidence: rollup by user with the floor-index tenth percentile."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("page"), F.pmod(F.col("event_id") * 37, F.lit(101)).cast("int").alias("confidence")).withColumn("usable", F.col("confidence") >= 25)
    r = quality.page_rollup(e, "user_id")
    return r.select("user_id", "pages", "accepted_pages", "confidence_p10", F.size("low_confidence_pages").cast("long").alias("n_low"), F.size("rejected_pages").cast("long").alias("n_rejected"))


SQL["p10_floor"] = """WITH e AS (SELECT user_id, (event_id * 37) % 101 AS c FROM events)
SELECT user_id, count(*) AS pages, count(*) FILTER (c >= 25) AS accepted_pages, list_sort(list(c))[((count(*) - 1) // 10) + 1]::INT AS confidence_p10, count(*) FILTER (c < 50) AS n_low, count(*) FILTER (c < 25) AS n_rejected FROM e GROUP BY user_id"""


@query
def top_file_types(spark, d):
    """The five commonest extensions of page paths, by language."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1).alias("source_id"), F.regexp_extract("url", r"//[^/]+/([^?#]*)", 1).alias("path"))
    return quality.top_types(p).select("source_id", "extension", F.col("count").alias("n"), "rank")


SQL["top_file_types"] = r"""WITH p AS (SELECT regexp_extract(url, '//[^/]+/([a-z]{2})/', 1) AS source_id, regexp_extract(url, '//[^/]+/([^?#]*)', 1) AS path FROM pages),
b AS (SELECT source_id, list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS name FROM p),
c AS (SELECT source_id, coalesce(nullif(lower(regexp_extract(name, '.(\.[^.]+)$', 1)), ''), '[no extension]') AS extension, count(*) AS n FROM b GROUP BY ALL)
SELECT source_id, extension, n, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, extension) AS rank FROM c QUALIFY rank <= 5"""


@query
def folder_tree_totals(spark, d):
    """Pages and bytes of HTML under each folder of their addresses."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"//([^?#]*)", 1).alias("path"), F.length("html").alias("chunks"))
    return quality.folder_totals(p)


SQL["folder_tree_totals"] = r"""WITH p AS (SELECT string_split(regexp_extract(url, '//([^?#]*)', 1), '/') AS parts, length(html) AS n FROM pages),
f AS (SELECT array_to_string(parts[1:i], '/') AS folder, n FROM p, LATERAL (SELECT unnest(range(0, len(parts))) AS i))
SELECT folder, count(*) AS files, sum(n)::BIGINT AS total FROM f GROUP BY folder"""


@query
def html_title(spark, d):
    """F37."""
    return table(spark, d, "pages").select("page_id", links.html_title(F.col("html")).alias("title"))


SQL["html_title"] = r"""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM t)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))[1:160] AS title FROM e"""


@query
def html_text(spark, d):
    """pages without tags."""
    t = collapse_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha1(t).alias("digest"))


SQL["html_text"] = "SELECT page_id, length(t)::BIGINT AS n_chars, sha1(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)"


@query
def url_dedupe_key(spark, d):
    """Page addresses as links, some as sheets, documents and files, and their keys."""
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.concat(F.lit("https://docs.google.com/spreadsheets/d/Ab"), F.col("page_id").cast("string"), F.lit("/edit?x=1#gid=7"))).when(k == 1, F.concat(F.lit("https://docs.google.com/document/d/d"), F.col("page_id").cast("string"), F.lit("/view"))).when(k == 2, F.concat(F.lit("https://drive.google.com/open?id=F"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", links.dedupe_key(url).alias("link_key"), links.drive_kind(url).alias("kind"), links.link_id(url).alias("link_id"))


SQL["url_dedupe_key"] = r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://docs.google.com/spreadsheets/d/Ab' || page_id || '/edit?x=1#gid=7' WHEN 1 THEN 'https://docs.google.com/document/d/d' || page_id || '/view' WHEN 2 THEN 'https://drive.google.com/open?id=F' || page_id ELSE url END AS u FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'sheet:ab' || page_id || ':7' WHEN 1 THEN 'doc:d' || page_id WHEN 2 THEN 'drive:f' || page_id ELSE 'url:' || regexp_replace(lower(u), '#.*$', '') END AS link_key,
CASE page_id % 5 WHEN 0 THEN 'spreadsheet' WHEN 1 THEN 'document' WHEN 2 THEN 'drive-file' ELSE 'unsupported' END AS kind, 'ctx-' || sha1(lower(u))[1:10] AS link_id FROM u"""


@query
def redact(spark, d):
    """conversation turns with planted credentials, redacted."""
    t = F.concat("text", F.lit(" Authorization: Bearer abc.DEF-"), F.col("conv_id").cast("string"), F.lit(" api_key=\"k1\" https://u:pw@host/p?token=z9&x=1 https://docs.google.com/document/d/abcdefgh12/edit"))
    r = privacy.redact(t)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha1(r).alias("digest"), F.length(r).cast("long").alias("n_chars"))


SQL["redact"] = r"""WITH t AS (SELECT conv_id, turn, text || ' Authorization: Bearer abc.DEF-' || conv_id || ' api_key="k1" https://u:pw@host/p?token=z9&x=1 https://docs.google.com/document/d/abcdefgh12/edit' AS t FROM conversations),
a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'gi'), 'api[_-]?key["''\s:=]+[^"'',\s]+', 'apiKey=[redacted]', 'gi'), '//[^/@\s:]+:[^/@\s]+@', '//[redacted]@', 'g') AS t FROM t),
r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '([?&](?:token|access_token|api_key|key|id)=)[^&\s#]+', '\1[redacted]', 'gi'), '(/d/)([a-zA-Z0-9_-]{8,})', '\1[redacted]', 'g') AS t FROM a)
SELECT conv_id, turn, sha1(t) AS digest, length(t)::BIGINT AS n_chars FROM r"""


@query
def masked_path(spark, d):
    """H1: page paths as file name and short hash."""
    p = F.regexp_extract("url", r"//[^/]+(/[^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", privacy.mask_path(p).alias("masked"))


SQL["masked_path"] = r"""WITH p AS (SELECT page_id, regexp_extract(url, '//[^/]+(/[^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN p = '' THEN '' ELSE string_split(regexp_replace(p, '/+$', ''), '/')[-1] || '#' || sha256(p)[1:8] END AS masked FROM p"""


@query
def truncated(spark, d):
    """F36."""
    t = truncate_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.sha1("t.text").alias("digest"), "t.truncated")


SQL["truncated"] = "SELECT doc_id, sha1(CASE WHEN length(text) > 400 THEN text[1:400] || '…' ELSE text END) AS digest, length(text) > 400 AS truncated FROM documents"


@query
def glob_filter(spark, d):
    """P3-P5, SC2: page paths by class under include and exclude patterns."""
    p = F.regexp_extract("url", r"//[^/]+(/[^?#]*)", 1)
    path = F.concat(F.when(F.col("page_id") % 9 == 0, "/tmp").when(F.col("page_id") % 9 == 1, "/docs/~$x").otherwise(""), p, F.when(F.col("page_id") % 2 == 0, ".md").otherwise(""))
    return table(spark, d, "pages").select("page_id", paths.file_class(path, ["**/*.md", "en/", "fr/?5*"], ["**/*99*", "de/1"]).alias("reason"))


SQL["glob_filter"] = r"""WITH a AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN '/tmp' WHEN 1 THEN '/docs/~$x' ELSE '' END || regexp_extract(url, '//[^/]+(/[^?#]*)', 1) || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '' END AS raw FROM pages),
p AS (SELECT page_id, list_filter(string_split(raw, '/'), lambda x: x <> '')[-1] AS name, lower(regexp_replace(regexp_replace(raw, '^/+', ''), '/+', '/', 'g')) AS p FROM a)
SELECT page_id, CASE WHEN starts_with(name, '~$') OR starts_with(name, '._') OR ends_with(lower(name), '.tmp') THEN 'temporary'
  WHEN list_has_any(string_split(p, '/'), ['.git','node_modules','data','dist','build','.cache','.venv','__pycache__','tmp','temp']) OR regexp_matches(p, '^(?:.*/)?[^/]*99[^/]*$') OR contains(p, 'de/1')
    OR NOT (regexp_matches(p, '^(?:.*/)?[^/]*\.md$') OR contains(p, 'en/') OR regexp_matches(p, '^fr/[^/]5[^/]*$')) THEN 'excluded'
  WHEN NOT list_contains(['.txt','.md','.markdown','.csv','.log','.docx','.xlsx','.xlsm','.xls','.pdf'], lower(regexp_extract(name, '.(\.[^.]+)$', 1))) THEN 'unsupported' ELSE 'eligible' END AS reason FROM p"""


@query
def file_ids(spark, d):
    """Ids of files, sources and points."""
    p = table(spark, d, "pages")
    return p.select("page_id", paths.file_id(F.lit("s1"), F.col("url")).alias("file_id"), paths.short_id("source-", F.col("url")).alias("source_id"), paths.point_id(F.col("url")).alias("point_id"))


SQL["file_ids"] = """SELECT page_id, sha1('s1:' || lower(url)) AS file_id, 'source-' || sha1(lower(url))[1:10] AS source_id,
h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(printf('%02x', (('0x' || h[17:18])::INT & 63) | 128)) || h[19:20] || '-' || h[21:32] AS point_id FROM (SELECT page_id, url, sha256(url) AS h FROM pages)"""


@query
def fuzzy_jaccard(spark, d):
    """Each part's name against that of the part before."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(before, "p_partkey").select("p_partkey", F.round(fuzzy_score(F.col("p_name"), F.col("other")), 9).alias("score"))


SQL["fuzzy_jaccard"] = r"""WITH j AS (SELECT a.p_partkey, lower(trim(a.p_name)) AS a, lower(trim(b.p_name)) AS b FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(a, '[\s,./-]+'), lambda x: length(x) > 2)) AS x, list_distinct(list_filter(regexp_split_to_array(b, '[\s,./-]+'), lambda x: length(x) > 2)) AS y FROM j)
SELECT p_partkey, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.7 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y))::DOUBLE END, 9) AS score FROM t"""


@query
def suffix_variants(spark, d):
    """stems of words with Russian endings put on part brands' letters."""
    words = F.array(F.lit("договорами"), F.lit("садовническая"), F.lit("проектному"), F.lit("улица"))
    w = F.get(words, (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.filter(token_variants(w), lambda v: v.rlike("[а-я]"))), " ").alias("variants"))


_CASES = ", ".join(f"CASE WHEN length(w) - {len(e)} >= 4 AND ends_with(w, '{e}') THEN w[1:length(w) - {len(e)}] END" for e in ENDINGS)
SQL["suffix_variants"] = f"""WITH t AS (SELECT p_partkey, ['договорами', 'садовническая', 'проектному', 'улица'][p_partkey % 4 + 1] AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([w, {_CASES}], lambda x: x IS NOT NULL))), ' ') AS variants FROM t"""


@query
def csv_to_markdown(spark, d):
    """nations by region as one Markdown table each."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("ord"), F.array("n_name", F.concat(F.lit("a|"), F.col("n_nationkey").cast("string"))).alias("cells"))
    return paged.csv_markdown(n, "region", "ord", "cells")


SQL["csv_to_markdown"] = r"""SELECT n_regionkey AS region, '| Row | A | B |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || trim(regexp_replace(n_name, '\s+', ' ', 'g')) || ' | a\|' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey"""


@query
def pd_fields(spark, d):
    """fields of a stamp line made from each part."""
    line = F.concat(F.lit("Code: "), "p_brand", F.lit(" | Stage : "), "p_type", F.lit(" | bare | Sheet: a:b | CODE: last"))
    m = paged.fields(line)
    return table(spark, d, "part").select("p_partkey", m["code"].alias("code"), m["stage"].alias("stage"), m["sheet"].alias("sheet"), F.size(m).cast("long").alias("n"))


SQL["pd_fields"] = "SELECT p_partkey, 'last' AS code, trim(p_type) AS stage, 'a:b' AS sheet, 3::BIGINT AS n FROM part"


@query
def paged_chunks(spark, d):
    """F44, F45, SC17: parts as pages of a volume, cut into chunks under a header."""
    p = table(spark, d, "part").withColumn("vol", F.floor(F.col("p_partkey") / 20).cast("long"))
    page = F.concat(F.lit("## Page "), F.col("p_partkey").cast("string"), F.lit("\n> **Stamp:** Code: "), "p_brand", F.lit(" | Sheet: "), F.col("p_size").cast("string"), F.lit("\n### BLOCK #1 [IMAGE]: b"), F.col("p_partkey").cast("string"), F.lit("\n**[IMAGE]** | Type: план | Level: -9,300, -5,700\n"), F.repeat("p_name", 40), F.lit("\n"))
    vol = p.groupBy("vol").agg(F.sort_array(F.collect_list(F.struct("p_partkey", page.alias("t")))).alias("r")).select("vol", F.concat(F.lit("# Document: v\n"), F.array_join(F.transform("r", lambda r: r["t"]), "")).alias("text"))
    c = paged.page_chunks(paged.pages(vol, "vol"), max_chars=600)
    return c.select("vol", "page", "chunk_ord", "document_code", "sheet", "sheet_type", "levels", "page_kind", F.length("text").cast("long").alias("n_chars"))


SQL["paged_chunks"] = """WITH p AS (SELECT (p_partkey // 20)::BIGINT AS vol, p_partkey::INT AS page, p_brand AS code, p_size::VARCHAR AS sheet, repeat(p_name, 40) AS b, p_brand || ' | лист ' || p_size || ' | plan | отметки -9,300|-5,700' AS h FROM part),
w AS (SELECT *, greatest(200, 600 - length(h) - 1) AS n FROM p)
SELECT vol, page, i::INT AS chunk_ord, code AS document_code, sheet, 'plan' AS sheet_type, '-9,300|-5,700' AS levels, 'drawing' AS page_kind, length(h) + 1 + length(b[i * n + 1:(i + 1) * n]) AS n_chars
FROM w, LATERAL (SELECT unnest(range(0, greatest(1, ceil(length(b) / n::DOUBLE)::INT))) AS i)"""


@query
def tender_types(spark, d):
    """Conversation turns as tender papers, by document type."""
    t = table(spark, d, "conversations")
    k = F.col("conv_id") % 5
    add = F.when(k == 0, " КП от поставщика, цена 100 руб.").when(k == 1, " Локальная смета КС-2").when(k == 2, " Техническое задание").when(k == 3, " Итого 5 000 ₽").otherwise(" ничего")
    r = recognition.recognize(t.withColumn("text", F.concat(F.regexp_replace("text", r"(?i)\b(?:quote|quotation|proposal|offer)\b", "x"), add)), F.lit("tender"))
    return recognition.type_summary(r.withColumn("source_id", F.col("role")))


SQL["tender_types"] = """SELECT role AS source_id, CASE conv_id % 5 WHEN 0 THEN 'commercial_proposal' WHEN 1 THEN 'cost_estimate' WHEN 2 THEN 'tender_document' WHEN 3 THEN 'price_table' ELSE 'tender_file' END AS document_type, count(*) AS files,
count(*) FILTER (conv_id % 5 = 0) AS commercial, count(*) FILTER (conv_id % 5 IN (0, 3)) AS with_prices FROM conversations GROUP BY ALL"""


@query
def chat_intents(spark, d):
    """What each turn asks for, and the limit that follows."""
    q = F.concat("text", F.when(F.col("turn") % 4 == 1, " по всем проектам").when(F.col("turn") % 4 == 2, " основные условия").when(F.col("turn") % 4 == 3, " обзор: все источники").otherwise(""))
    more = F.length(recognition.expanded_question(q)) - F.length(q)
    return table(spark, d, "conversations").select("conv_id", "turn", recognition.intent(q).alias("i"), more.cast("long").alias("added")).select("conv_id", "turn", "i.all_sources", "i.broad", "i.limit", "added")


_ADDED = len("\n" + " ".join(recognition.CONTRACT_TERMS))
SQL["chat_intents"] = f"""WITH q AS (SELECT conv_id, turn, turn % 4 IN (1, 3) AS e, turn % 4 IN (2, 3) AS b FROM conversations)
SELECT conv_id, turn, e AS all_sources, b AS broad, CASE WHEN e AND b THEN 36 WHEN e THEN 24 WHEN b THEN 20 ELSE 12 END AS "limit", CASE WHEN turn % 4 = 2 THEN {_ADDED} ELSE 0 END::BIGINT AS added FROM q"""


@query
def plural_forms(spark, d):
    """F49."""
    return table(spark, d, "part").select("p_partkey", plural_ru(F.col("p_partkey"), "файл", "файла", "файлов").alias("form"))


SQL["plural_forms"] = "SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 AND p_partkey % 100 <> 11 THEN 'файл' WHEN p_partkey % 10 BETWEEN 2 AND 4 AND p_partkey % 100 NOT BETWEEN 12 AND 14 THEN 'файла' ELSE 'файлов' END AS form FROM part"
