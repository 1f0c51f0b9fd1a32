from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsift.functions import citations
from docsift.functions.text import expand_synonyms, normalize_text, phrase_boost, snippet, tokens
from docsift.functions.vectors import dot, padded, unit
from docsift.operators import chunking, lexical, retrieval


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tokens(F.col("t")), t="Привет, RAG-UI x 42 _id qwen3.6") == ["привет", "rag-ui", "42", "_id", "qwen3"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_normalize(spark):
    assert one(spark, normalize_text(F.col("t")), t=" a  \r\nb\r\n\r\n\r\n\r\n\r\nc ") == "a\nb\n\n\nc"


def test_pack(spark):
    assert one(spark, chunking.pack(F.col("t"), 12, 3), t="Alpha\n\nBeta\n\nGamma") == ["Alpha\n\nBeta", "Gamma"]
    long = "x" * 25
    assert one(spark, chunking.pack(F.col("t"), 10, 3), t=f"ab\n\n{long}\n\ncd") == ["ab", "x" * 10, "x" * 10, "x" * 10, "x" * 4, "cd"]
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b" * 4000)], "id long, text string")
    rows = [(r["id"], r["chunk_index"], len(r["chunk_text"])) for r in chunking.chunk_frame(docs).collect()]
    assert rows == [(1, 0, 1), (4, 0, 1800), (4, 1, 1800), (4, 2, 840)]


def test_places(spark):
    text = "## OCR page 12\n\ntext\n\n" + "w" * 30 + "\n\n## Page 13\n\n# Лист: Смета\n| 4 | a |\n| 8 | b |\n\n## Итоги #\n\nend"
    rows = chunking.chunk_with_places(spark.createDataFrame([("d", text)], "id string, text string"), "id", "text", 40, 5).orderBy("chunk_index").collect()
    assert (rows[0]["page_start"], rows[0]["page_end"]) == (12, 12)
    assert rows[-1]["section_title"] == "Итоги" and rows[-1]["sheet_name"] == "Смета"
    sheet = [r for r in rows if r["row_start"] is not None][0]
    assert (sheet["row_start"], sheet["row_end"], sheet["page_end"]) == (4, 8, 13)


def test_snippet(spark):
    text = "alpha " * 10 + "beta gamma " + "delta " * 10
    got = one(spark, snippet(F.col("t"), F.lit("zz beta"), 10), t=text)
    assert got.startswith("...") and got.endswith("...") and "beta" in got
    assert one(spark, snippet(F.col("t"), F.lit("nothing"), 4), t="Alpha\n\nBeta gamma") == "Alpha\n\nB"


CHUNKS = [
    ("common-heavy", "common common common common", "", "", ""),
    ("rare-hit", "rare", "", "", ""),
    ("one", "common", "", "", ""),
    ("title", "other words", "zoning plan", "", ""),
    ("text", "zoning other words", "", "", ""),
]


def frames(spark, terms):
    c = spark.createDataFrame(CHUNKS, "chunk_id string, text string, title string, path string, source_title string")
    q = spark.createDataFrame([(1, terms, " ".join(terms))], "query_id int, terms array<string>, phrase string")
    return c, q


def plain_bm25(terms):
    boost = (1.0, 2.2, 1.2, 1.7)
    docs = {i: [([w for w in f.split() if len(w) > 1], b) for f, b in zip(fields, boost)] for i, *fields in CHUNKS}
    n, length = len(docs), {i: max(1, sum(len(t) for t, _ in d)) for i, d in docs.items()}
    mean = sum(length.values()) / n
    tf = {i: {w: sum(t.count(w) * b for t, b in d) for w in terms} for i, d in docs.items()}
    df = {w: sum(tf[i][w] > 0 for i in docs) for w in terms}
    score = lambda i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w in terms if tf[i][w])
    return {i: score(i) for i in docs if score(i) > 0}


@pytest.mark.parametrize("terms", [["common", "rare"], ["zoning"], ["nothing"], ["zoning", "zoning", "words"]])
def test_bm25(spark, terms):
    got = {r["chunk_id"]: r["score"] for r in lexical.bm25(*frames(spark, terms)).collect()}
    assert got == pytest.approx(plain_bm25(list(dict.fromkeys(terms))))
    if terms == ["common", "rare"]:
        assert max(got, key=got.get) == "rare-hit"
    if terms == ["zoning"]:
        assert got["title"] > got["text"]


def test_simple_score(spark):
    c = spark.createDataFrame([("a", "alpha beta alpha")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, ["alpha", "beta"], "alpha beta")], "query_id int, terms array<string>, phrase string")
    assert lexical.simple_scores(c, q).first()["score"] == pytest.approx(8 + (2 + math.log(3)) + (2 + math.log(2)))
    c, q = frames(spark, ["common", "rare"])
    assert lexical.top_k(lexical.simple_scores(c, q), 1).first()["chunk_id"] == "common-heavy"


def test_lexical_fallback(spark):
    c = spark.createDataFrame([("a", "subcontracts here"), ("b", "plain")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, ["contract"], "contract"), (2, ["plain"], "plain")], "query_id int, terms array<string>, phrase string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.lexical_candidates(c, q).collect()}
    assert got[1, "a"] == 8.0 and set(got) == {(1, "a"), (2, "b")}


def test_vectors(spark):
    assert one(spark, dot(F.array(F.lit(1.0), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5)))) == 0.75
    assert one(spark, dot(F.array(F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.5)))) == 0.5
    assert one(spark, unit(F.array(F.lit(0.0)))) == [] and one(spark, unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, padded(F.array(F.lit(1.0).cast("float")), 3)) == [1.0, 0.0, 0.0]


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, s, r) for r, (i, s) in enumerate(rows, 1)], "query_id int, chunk_id string, score double, rank long")


def test_rrf(spark):
    out = {r["chunk_id"]: r for r in retrieval.rrf(ranked(spark, [("a", 0.9), ("b", 0.5)]), ranked(spark, [("a", 4.0), ("c", 3.0)])).collect()}
    assert len(out) == 3 and (out["a"]["vector_rank"], out["a"]["lexical_rank"], out["a"]["rank"]) == (1, 1, 1)
    assert out["a"]["rrf_score"] == pytest.approx(2 / 61) and out["c"]["rank"] == 2  # equal fusion scores: the higher raw score first


def test_hybrid(spark):
    fused = spark.createDataFrame([(1, "a", 0.75, 4.0), (1, "b", 0.0, 8.0)], "query_id int, chunk_id string, vector_score double, lexical_score double")
    a = retrieval.hybrid(fused).filter("chunk_id = 'a'").first()
    assert a["lexical_normalized"] == 0.5 and a["score"] == pytest.approx(0.75 * 0.82 + 0.5 * 0.18)
    assert retrieval.hybrid(fused, has_vector=F.lit(False)).filter("chunk_id = 'a'").first()["score"] == 0.5


def test_phrase_boost(spark):
    terms = F.array(F.lit("цена"), F.lit("договора"))
    assert one(spark, phrase_boost(F.col("t"), terms), t="Цена договора составляет 12 345 678,00 руб.") == pytest.approx(0.12)
    assert one(spark, phrase_boost(F.col("t"), F.array(F.lit("цена"))), t="Цена договора") == 0.0


def test_synonyms(spark):
    got = one(spark, expand_synonyms(F.array(F.lit("ндс"), F.lit("x"))))
    assert got == ["ндс", "x", "налог"]


def test_rerank(spark):
    r = ranked(spark, [("a", 3.0), ("b", 2.0), ("c", 1.0)]).withColumn("text", F.col("chunk_id")).withColumn("query_text", F.lit("q"))
    scores = retrieval.rerank_scores(r, lambda q, t: pd.Series([None if x == "a" else float(ord(x)) for x in t]))
    got = [x["chunk_id"] for x in retrieval.rerank(r, scores).orderBy("rank").collect()]
    assert got == ["c", "b", "a"]
    assert [x["chunk_id"] for x in retrieval.rerank(r, scores.limit(0)).orderBy("rank").collect()] == ["a", "b", "c"]


DEMO = {
    "budget.md": "# Бюджет\n\nИтоговая стоимость договора 4 500 000 руб., НДС 20 %.",
    "contacts.md": "# Контакты\n\nПочта: office@example.com, телефон 123",
    "schedule.md": "# График\n\nСрок сдачи 30 июня, этап два",
    "risks.md": "# Риски\n\nШтраф за просрочку 0,1 % в день",
    "contract.md": "# Договор\n\nОплата в течение 45 дней, аванс 10 %",
}


def test_search(spark):
    docs = spark.createDataFrame(list(DEMO.items()), "title string, text string")
    chunks = chunking.chunk_frame(docs).select(F.concat_ws(":", "title", "chunk_index").alias("chunk_id"), F.col("chunk_text").alias("text"), "title", F.concat(F.lit("/demo/"), "title").alias("path"), F.lit("demo").alias("source_id"))
    asked = [(1, "срок оплаты 45 дней"), (2, "почта office"), (3, "цена договора"), (4, "штраф"), (5, "этап сдачи"), (6, "?")]
    q = spark.createDataFrame(asked, "query_id int, query_text string")
    best = {r["query_id"]: r for r in retrieval.search(chunks, q).filter("rank = 1").collect()}
    assert {k: r["title"] for k, r in best.items()} == {1: "contract.md", 2: "contacts.md", 3: "budget.md", 4: "risks.md", 5: "schedule.md"}
    assert best[1]["search_mode"] == "keyword" and best[1]["vector_score"] == 0.0 and best[1]["citation_label"] == "contract.md"
    vectors = chunks.select("chunk_id", F.array(F.when(F.col("title") == "risks.md", 1.0).otherwise(0.0)).alias("vector"))
    qv = q.withColumn("query_vector", F.when(F.col("query_id") == 2, F.array(F.lit(1.0))))
    got = {(r["query_id"], r["rank"]): r for r in retrieval.search(chunks, qv, vectors).collect()}
    assert got[2, 1]["title"] == "risks.md" and got[2, 1]["search_mode"] == "hybrid" and got[1, 1]["search_mode"] == "keyword"
    assert retrieval.search(chunks, q, source_ids=["other"]).count() == 0


def test_metrics(spark):
    m = retrieval.metrics(spark.createDataFrame([(1,), (4,), (None,)], "rank int")).first()
    assert m["recall_at_3"] == pytest.approx(1 / 3) and m["recall_at_5"] == pytest.approx(2 / 3) and m["mrr"] == pytest.approx((1 + 0.25) / 3)


def test_citations(spark):
    lab = lambda *a: one(spark, citations.label(*(F.lit(x).cast(k) for x, k in zip(a, ("string", "string", "int", "int", "string", "string")))))
    assert lab(None, "/a/b/report.pdf", 3, 3, None, None) == "report.pdf, стр. 3"
    assert lab("r", None, 3, 5, "s", "t") == "r, стр. 3-5"
    assert lab("r.xlsx", None, None, None, 'A "x"', None) == "r.xlsx, лист \"A 'x'\""
    assert lab("", "", None, None, "", "Part  1") == 'source, раздел "Part 1"'
    assert one(spark, citations.with_sources(F.lit("x [2] y [9] [2]"), F.lit(5))) == "x [2] y [9] [2]\n\nИсточники: [2]."
    assert one(spark, citations.with_sources(F.lit("x"), F.lit(5))) == "x\n\nИсточники: [1], [2], [3]."
    assert one(spark, citations.with_sources(F.lit("x"), F.lit(0))) == "x"
    assert one(spark, citations.evidence_line(F.lit("- цена 5 [1].\nмного [2]"), F.lit(2))) == "много"


def test_evidence(spark):
    assert one(spark, citations.evidence_tokens(F.lit("Mail a@b.co, https://x.y/z 45 дней Mail [3] ok"))) == ["a@b.co", "https://x.y/z", "45 дней", "Mail", "https", "x.y", "дней"]
    text = "first line\nпочта office@example.com\nthird\nпочта other"
    s = one(spark, citations.evidence_span(F.lit(text), F.lit("какая почта: office@example.com?")))
    assert text[s["start"] : s["end"]] == "почта office@example.com"
    d = one(spark, citations.evidence_span(F.lit(text), F.lit("THIRD")))
    assert text[d["start"] : d["end"]] == "third"
    p = one(spark, citations.preview(F.lit(text), F.lit(s["start"]), F.lit(s["end"]), 2, 2))
    assert p["text"] == "first line\nпочта office@example.com\nthird" and p["cut_after"] and not p["cut_before"]
    assert p["text"][p["focus_start"] : p["focus_end"]] == "почта office@example.com"
