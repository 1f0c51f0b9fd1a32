"""Queries on sources: the given tables written as files of a form, walked or read back, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docsift.operators import likeness
from docsift.operators import page_links as anchors
from docsift.plans.common import EVERY, table
from docsift.session import shared_root
from docsift.sources import folders, json_objects
from docsift.sources.conversions import Conversions

Q = {}
SQL = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


@query
def json_arrays(spark, d):
    """SC20, SC21: all documents written as JSON arrays and read back by ranges of bytes: id, source and the text's digest."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    folder = f"{shared_root(spark)}/docsift/arrays-{uuid.uuid4().hex}"
    json_objects.write_arrays(docs, folder)
    back = json_objects.read_objects(spark, folder, "doc_id long, source string, text string", range_bytes=4 << 20)
    return back.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


SQL["json_arrays"] = "SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5 FROM documents"


@query
def folder_walk(spark, d):
    """SC1, SC3, SC4, P4: documents in folders by language and source, walked without those of sources whose names end with
    3: by language, folders that were listed and pruned, and data files."""
    root = f"{shared_root(spark)}/docsift/tree-{uuid.uuid4().hex}"
    names = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    names.repartition("lang", "source").write.partitionBy("lang", "source").parquet(root)
    entries = folders.walk(spark, [root], ["*/source=*3"])
    parts = F.split("relative_path", "/")
    of = lambda c: F.count_if(c).alias
    inner = entries.withColumn("lang", F.regexp_extract("relative_path", "^lang=([^/]*)/", 1)).filter("lang <> ''")
    data = (F.col("kind") == "file") & F.get(parts, F.lit(2)).endswith(".parquet")
    return inner.groupBy("lang").agg(of(F.col("kind") == "folder")("folders"), of(F.col("kind") == "pruned")("pruned"), of(data)("files"))


SQL["folder_walk"] = """WITH g AS (SELECT DISTINCT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents)
SELECT lang, count(*) FILTER (source NOT LIKE '%3') AS folders, count(*) FILTER (source LIKE '%3') AS pruned, count(*) FILTER (source NOT LIKE '%3') AS files FROM g GROUP BY lang"""


@query
def like_titles(spark, d):
    """Names of parts whose key is divisible by 50 as titles, against all names: equal, one in the other, or an
    overlap of words of 0.55 and more."""
    parts = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("value"))
    return likeness.alike(parts.filter(F.col("p_partkey") % EVERY == 0), parts, 0.55).select("a", "b", F.round("score", 6).alias("score"))


SQL["like_titles"] = f"""WITH n AS (SELECT DISTINCT lower(p_name) AS v FROM part), q AS (SELECT DISTINCT lower(p_name) AS v FROM part WHERE p_partkey % {EVERY} = 0),
w AS (SELECT v, list_distinct(list_filter(string_split_regex(v, '[\\s,./-]+'), lambda t: length(t) > 2)) AS s FROM n),
p AS (SELECT q.v AS a, y.v AS b, x.s AS xs, y.s AS ys, len(list_intersect(x.s, y.s)) AS shared FROM q JOIN w x USING (v), w y WHERE q.v <> '' AND y.v <> ''),
c AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.7 WHEN len(xs) = 0 OR len(ys) = 0 THEN 0 ELSE shared::DOUBLE / (len(xs) + len(ys) - shared) END AS score FROM p)
SELECT a, b, round(score, 6) AS score FROM c WHERE score >= 0.55"""


@query
def page_links(spark, d):
    """SC31, N30: anchors of all pages with resolved addresses and labels, each address of a page once."""
    return anchors.page_links(table(spark, d, "pages"))


SQL["page_links"] = """WITH a AS (SELECT page_id, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS told, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS position FROM pages),
b AS (SELECT page_id, position::INT AS position, trim(replace(href, '&amp;', '&')) AS href, origin || trim(replace(href, '&amp;', '&')) AS url, trim(replace(told, '&amp;', '&')) AS label FROM a)
SELECT page_id, position, href, url, label, 'link' AS kind, 'url:' || lower(regexp_replace(url, '#.*$', '')) AS link_key FROM b WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1"""


@query
def kept_conversions(spark, d):
    """SC12: all documents as files of two sources, even ids first: text, and whether the file's own content was converted;
    equal contents are converted once, by the first source that has them."""
    files = table(spark, d, "documents").select("doc_id", F.lit(".txt").alias("extension"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    kept = Conversions(spark, f"{shared_root(spark)}/docsift/kept-{uuid.uuid4().hex}")
    sources = [files.filter(F.col("doc_id") % 2 == i) for i in range(2)]
    rows = [kept.convert(f, lambda ext, content: content.decode("utf-8"), "plain-1", "doc_id") for f in sources]
    return rows[0].unionByName(rows[1]).select("doc_id", F.md5("markdown").alias("markdown_md5"), "fresh")


SQL["kept_conversions"] = """SELECT doc_id, md5(coalesce(text, '')) AS markdown_md5, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id % 2, doc_id) = 1 AS fresh FROM documents"""
