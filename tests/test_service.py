from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsift.operators import chunking, recognition
from docsift.plans import service

SOURCES = [("c1", "Балчуг", "/p/balchug", "contract", "", []), ("c2", "Тверская", "/p/tver", "contract", "", []), ("t1", "Тендер 1", "/t/1", "tender", "c1", [])]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source_id string, title string, path string, source_type string, linked_contract_id string, additional_paths array<string>")


def test_settings():
    s = service.SearchSettings.of({"vector_candidates": 5000, "final_candidates": "x", "lexical_mode": "Simple"})
    assert (s.vector_candidates, s.final_candidates, s.lexical_mode, s.rerank_candidates) == (1000, 60, "simple", 30)
    r = service.Request.of({"q": " a ", "retrieval_setting": {"top_k": 99, "score_threshold": "0.5"}, "knowledge_id": "k", "privacy": {"allowRemoteContext": "yes"}})
    assert (r.query, r.top_k, r.threshold, r.source, r.remote) == ("a", 30, 0.5, "k", False)
    assert service.Request.of({}).top_k == 8 and service.clamp(float("nan"), 3, 0, 9) == 3


def test_scope(spark, sources):
    assert service.resolve_scope("срок по балчуг", sources)["source_ids"] == ["c1", "t1"]
    every = service.resolve_scope("обзор по всем проектам", sources, requested="c1")
    assert every["all_sources"] and not every["source_id"]
    assert service.resolve_scope("что там", sources, context="c2")["context_used"] and service.resolve_scope("что", sources, requested="no")["missing"]
    q = spark.createDataFrame([("основные условия договора",), ("цена",)], "q string").select(recognition.intent(F.col("q"))["limit"].alias("n"), recognition.expanded_question(F.col("q")).alias("x")).collect()
    assert [r["n"] for r in q] == [20, 12] and q[0]["x"].endswith("изменение цены") and q[1]["x"] == "цена"


def test_retrieval(spark, sources):
    docs = spark.createDataFrame([("c1", "оплата аванс 45 дней"), ("t1", "аванс тендера"), ("c2", "аванс другой"), ("old", "аванс устаревший")], "source_id string, text string")
    chunks = chunking.chunk_frame(docs).select(F.col("source_id").alias("chunk_id"), "source_id", F.col("chunk_text").alias("text"), F.col("source_id").alias("title"))
    files = spark.createDataFrame([("f", "old", "/p/balchug/x")], "file_id string, source_id string, path string")
    status, meta, hits = service.run_retrieval({"query": "аванс", "sourceId": "балчуг", "score_threshold": 0}, sources, chunks, files)
    assert status == 200 and {r["chunk_id"] for r in hits.collect()} == {"c1", "t1", "old"} and meta["source_id"] == "c1"
    status, meta, hits = service.run_retrieval({"query": "аванс", "score_threshold": 1.0}, sources, chunks)
    assert hits.count() == 1 and "not confident" in meta["warnings"][0]
    assert service.run_retrieval({}, sources, chunks)[0] == 400 and service.run_retrieval({"query": "x", "sourceId": "zz"}, sources, chunks)[0] == 404


def test_files_and_overview(spark, sources):
    files = spark.createDataFrame([("a", "c1", "/p/balchug/a", "ok", 2, "l1"), ("b", "c1", "/p/b", None, 0, None), ("c", "c2", "/p/c", None, 3, None)], "file_id string, source_id string, path string, status string, chunks int, link_id string")
    assert service.indexed_files(files, "c1", "error").columns == ["file_id", "source_id", "status", "chunks", "link_id"]
    assert [r["file_id"] for r in service.quality_filter(files, "error").collect()] == ["b"] and service.quality_filter(files, "searchable").count() == 2
    assert service.preview_target(files, chunk_path="/p/c", file_id="a").first()["file_id"] == "c" and service.preview_target(files, path="/p%2Fc").isEmpty()
    job = spark.createDataFrame([("c1", "completed", 0, "completed"), ("c2", "running", 0, "active")], "source_id string, status string, failed int, health string")
    o = service.index_overview(files, job).first()
    assert (o["overall"], o["recognized"], o["error"], o["unchecked"], o["chunks"]) == ("running", 2, 1, 1, 5)
    links = spark.createDataFrame([("l1", "c1"), ("l2", "c1"), ("l3", "c2")], "link_id string, source_id string")
    assert {r["link_id"]: r["link_status"] for r in service.link_status(links, files, job).collect()} == {"l1": "indexed", "l2": "not_indexed", "l3": "indexing"}
    assert {r["source_id"]: r["files"] for r in service.list_sources(sources, files).collect()} == {"c1": 2, "c2": 1, "t1": 0}
    assert {r["category"]: r["status"] for r in service.folder_report(spark.createDataFrame([("a", "x")], "category string, name string"), ["a", "b"]).collect()} == {"a": "readable", "b": "missing"}


def test_runs(spark):
    def index(s):
        if s == "bad":
            raise ValueError("no")
        return {"files": 2, "chunks": 5}

    run, rows = service.run_agent(["a", "bad", "b"], index, lambda: "t", "r1")
    assert run["totals"] == {"files": 4, "chunks": 10, "sources": 3, "failed_sources": 1} and rows[1]["error"] == "ValueError: no" and run["status"] == "completed"
    runs = spark.sql("select '1' as id, 'running' as status, '2024' as started_at, array(named_struct('id', 'x', 'status', 'running')) as sources")
    got = service.public_runs(runs, F.lit(False)).first()
    assert got["status"] == "interrupted" and got["sources"][0]["status"] == "interrupted"
