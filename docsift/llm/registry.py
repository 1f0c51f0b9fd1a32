"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsift.llm.bpe import op6_bpe
from docsift.llm.common import read_table
from docsift.llm.conversation_sql import REPAIR_SQL, TRIE_SQL
from docsift.llm.conversations import op11_conversation_repair
from docsift.llm.decontam import op3_decontam
from docsift.llm.langid import op7_langid
from docsift.llm.license_scan import op9_license
from docsift.llm.lm_scoring import op13_lm_scoring
from docsift.llm.mpeg_media import op10_mpeg_media
from docsift.llm.pii import op1_pii
from docsift.llm.prefix_trie import op12_prefix_trie
from docsift.llm.secrets import op5_secrets
from docsift.llm.sharding import op4_sharding
from docsift.llm.simhash import op8_simhash
from docsift.llm.url_filter import PREFIX_RULES, op2_url_filter


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, table))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_pii": _over("documents", op1_pii),
        "op2_url_filter": _over("pages", op2_url_filter),
        "op3_decontam": lambda spark, d: op3_decontam(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")),
        "op4_sharding": _over("documents", op4_sharding),
        "op5_secrets": _over("documents", op5_secrets),
        "op6_bpe": _over("documents", op6_bpe),
        "op7_langid": _over("documents", op7_langid),
        "op8_simhash": _over("documents", op8_simhash),
        "op9_license": _over("documents", op9_license),
        "op10_mpeg_media": _over("documents", op10_mpeg_media),
        "op11_conversation_repair": _over("conversations", op11_conversation_repair),
        "op12_prefix_trie": _over("conversations", op12_prefix_trie),
        "op13_lm_scoring": _over("documents", op13_lm_scoring),
        "pipeline": corpus_pipeline.run,
    }


def _url_sql() -> str:
    rules = ", ".join(f"('{r.name.split('/', 1)[0]}', '/{r.name.split('/', 1)[1]}', '{r.name}', '{r.action}')" for r in PREFIX_RULES)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rule_host, rule_path, rule, verdict) AS (VALUES {rules}),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), pattern AS (
  SELECT page_id, CASE
      WHEN regexp_matches(host || path, '^([^/]*\\.)?spam-farm([^A-Za-z0-9_-]|$)') THEN '||spam-farm^'
      WHEN regexp_matches(host || path, '/tracking/.*\\.gif') THEN '/tracking/*.gif'
      WHEN contains(host || path, '/doubleclick/') THEN '/doubleclick/'
      WHEN contains(host || path, 'spam-farm.') THEN 'spam-farm.'
      WHEN contains(host || path, '/casino/') THEN '/casino/'
      WHEN contains(host || path, '/ads/') THEN '/ads/' END AS pattern_rule FROM cut
)
SELECT cut.page_id, host, path, best.rule, coalesce(best.verdict, CASE WHEN pattern_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN best.rule IS NULL THEN pattern_rule END AS pattern_rule
FROM cut LEFT JOIN best USING (page_id) LEFT JOIN pattern USING (page_id)"""


def _decontam_sql() -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _url_sql(), "op3_decontam": _decontam_sql(), "op11_conversation_repair": REPAIR_SQL, "op12_prefix_trie": TRIE_SQL}
