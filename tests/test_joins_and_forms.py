"""Audit candidates against all pairs, amounts with no-break spaces, forms, lost queries, blocks of a catalogue."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from docsift.functions.money import money_text, price_mentions
from docsift.functions.text import js_trim, noise_report, normalize_text
from docsift.operators import audit, lexical, matching, recognition, retrieval


def fold(x):
    return " ".join((x or "").lower().split())


def base(x):
    parts = [p for p in (x or "").replace("\\", "/").split("/") if p]
    return parts[-1] if parts else ""


def plain_best(record, candidates, guarded):
    best = None
    for c in candidates:
        if c["tender_id"] != record["tender_id"] or record["tender_id"] is None:
            continue
        link, name, label, sup = fold(record["quote_link"]), fold(record["position_name"]), fold(c["label"]), fold(c["supplier"])
        hay = " ".join(fold(c[n]) for n in ("title", "path", "supplier", "label"))
        needle = fold(base(record["quote_link"]))
        q = link != "" and ((needle in hay and (needle != "" or not guarded)) or (sup in link and (sup != "" or not guarded)))
        p = name != "" and label != "" and (name in label or label[:24] in name)
        s = fold(record["supplier"]) != "" and fold(record["supplier"]) == sup
        key = (-(2 if q else 1 if p else 0), -(50 * q + 30 * p + 20 * s), c["chunk_id"], c["ord"])
        if best is None or key < best[0]:
            best = (key, c["amount"], q, p)
    return best and best[1:]


def test_best_candidates_against_all_pairs(spark):
    rnd = random.Random(5)
    words = ["beam", "steel beam", "steel beam long type A", "x", "кирпич красный", "brick", ""]
    records = [dict(record_id=f"r{i}", tender_id=rnd.choice([1, 2, 3, None]), position_name=rnd.choice(words + [None]), quote_link=rnd.choice(["", None, "q/Acme Ltd.pdf", "q/b.pdf", "other/acme"]), supplier=rnd.choice(["", "acme", "Acme  Ltd.pdf", None])) for i in range(120)]
    found = [dict(tender_id=rnd.choice([1, 2, 3]), chunk_id=f"c{i:03d}", path=rnd.choice(["q/acme ltd.pdf", "z/b.pdf", ""]), title=rnd.choice(["", "Title"]), supplier=rnd.choice(["acme", "", "b.pdf"]), ord=i % 3, amount=str(i), label=rnd.choice(words) + rnd.choice(["", " цена", " a"])) for i in range(60)]
    r = spark.createDataFrame([tuple(x.values()) for x in records], "record_id string, tender_id long, position_name string, quote_link string, supplier string")
    f = spark.createDataFrame([tuple(x.values()) for x in found], "tender_id long, chunk_id string, path string, title string, supplier string, ord int, amount string, label string")
    for guarded in (True, False):
        got = {x["record_id"]: x["best"] and (x["best"]["amount"], x["best"]["by_quote"], x["best"]["by_position"]) for x in audit.best_candidates(r, f, guarded).collect()}
        assert got == {x["record_id"]: plain_best(x, found, guarded) for x in records}
    assert audit.best_candidates(r.limit(0), f).isEmpty() and audit.best_candidates(r, f.limit(0)).filter("best is not null").isEmpty()


def test_amounts_with_no_break_spaces(spark):
    rows = [(0, "Итого: 1 250 000,50 ₽"), (1, "цена 7 000.5"), (2, "12 руб."), (3, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r["k"]: [m["amount"] for m in r["m"]] for r in df.select("k", price_mentions(F.col("t")).alias("m")).collect()}
    assert got == {0: ["1250000.50", "1250000.50"], 1: ["7000.5", "7000.5"], 2: ["12"], 3: []}
    amounts = spark.createDataFrame([("1 250 000,50 ₽",), ("12.3456789",), ("-5",), ("x",), ("1.2.3",), (None,), ("007,1",)], "t string")
    assert [r[0] for r in amounts.select(money_text(F.col("t"))).collect()] == ["1250000.500000", "12.345678", "-5.000000", None, None, None, "007.100000"]


def test_forms_end_at_letters(spark):
    texts = ["такс 3", "КС-2", "акт КС 3.", "кс-25", "екс2"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["recognition"]["has_estimate_signals"] for r in recognition.recognize(df, F.lit("")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_lost_queries_are_looked_for_in_texts(spark):
    chunks = spark.createDataFrame([(1, "xalphax betaz"), (2, "gamma delta"), (3, "nothing")], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, ["alphax", "beta"], "alphax beta"), (2, ["gamma"], "gamma"), (3, ["absent"], "absent"), (4, [], "")], "query_id int, terms array<string>, phrase string")
    for block in (10_000, 1):
        got = {(r["query_id"], r["chunk_id"]) for r in lexical.lexical_candidates(chunks, queries, block=block).collect()}
        assert got == {(1, 1), (2, 2)}
    odd = spark.createDataFrame([(1, ["o'neil\\x", "gamma"], "")], queries.schema)
    assert lexical.bm25(chunks, odd).count() == 1 and lexical.bm25(chunks, queries.limit(0)).isEmpty()


def test_terms_beyond_the_bound_are_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = spark.createDataFrame([(1, ["the", "and"]), (2, ["der", "absent"])], "query_id int, terms array<string>")
    rows = lambda: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in lexical.bm25(docs, queries).collect())
    few = rows()
    monkeypatch.setattr(lexical, "MAX_TERMS", 1)
    assert few and rows() == few


def test_catalogue_in_blocks(spark):
    sources = spark.createDataFrame([(f"s{i}", f"Object {i} Lesnaya", f"/x/{i}") for i in range(30)], "source_id string, title string, path string")
    asked = spark.createDataFrame([(1, "Lesnaya 17")], "question_id int, question string")
    rows = lambda n: sorted(map(tuple, matching.match_sources(asked, sources, n).select("source_id", "score", "rank").collect()))
    assert rows(100_000) == rows(7) and len(rows(7)) == 30


def test_reranking_fails_open(spark):
    ranked = spark.createDataFrame([(1, 1, 1, "a", "q"), (1, 2, 2, "b", "q")], "query_id int, chunk_id int, rank long, text string, query_text string")

    def broken(queries: pd.Series, texts: pd.Series) -> pd.Series:
        raise RuntimeError("down")

    out = retrieval.rerank(ranked, retrieval.rerank_scores(ranked, broken))
    assert {(r["chunk_id"], r["rank"], r["rerank_score"]) for r in out.collect()} == {(1, 1, None), (2, 2, None)}


def test_text_measures(spark):
    t = "  ﻿ a \t\r\nb\r\r\r\r\r\rc "
    df = spark.createDataFrame([(t, "Договoр12 ab12 x1 12 слово word ⅧЖ жw")], "t string, n string")
    r = df.select(normalize_text(F.col("t")).alias("t"), js_trim(F.lit(" x　")).alias("j"), noise_report(F.col("n")).alias("n")).first()
    assert r["t"] == "a\nb\n\n\nc" and r["j"] == "x"
    assert (r["n"]["letter_tokens"], r["n"]["mixed_script_tokens"], r["n"]["alpha_digit_tokens"]) == (7, 3, 1)


def test_a_tender_of_many_short_names_under_one_quote(spark):
    """10,000 names of seven characters, a mention of each, one supplier and one link: pairs would be 10 ** 8."""
    n = 10_000
    records = spark.range(n).select(F.format_string("r%05d", "id").alias("record_id"), F.lit(1).alias("tender_id"), F.format_string("N%06d", "id").alias("position_name"), F.lit("q/Acme.pdf").alias("quote_link"), F.lit("acme.pdf").alias("supplier"))
    found = spark.range(n).select(F.lit(1).alias("tender_id"), F.format_string("c%05d", n - F.col("id")).alias("chunk_id"), F.lit("z/acme.pdf").alias("path"), F.lit("").alias("title"), F.lit("Acme.pdf").alias("supplier"), F.lit(0).alias("ord"), F.col("id").cast("string").alias("amount"), F.format_string("n%06d cost", "id").alias("label"))
    best = audit.best_candidates(records, found)
    own = (F.col("best.amount").cast("int") == F.substr("record_id", F.lit(2)).cast("int")) & F.col("best.by_quote") & F.col("best.by_position")
    assert best.count() == n and best.filter(own).count() == n
