"""The engine's read-only entry points: settings, requests, scopes, previews, file lists, overviews, runs.

Small decisions (one request, a handful of settings) are plain Python; tables stay DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import privacy
from docsift.functions.paths import base_name
from docsift.functions.text import truncate_text
from docsift.operators import jobs, matching, quality, recognition, retrieval


def clamp(value: object, default: float, low: float, high: float) -> float:
    """A number within bounds; what isn't one becomes the default."""
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return default if number != number or number in (float("inf"), float("-inf")) else min(high, max(low, number))


@dataclass(frozen=True)
class SearchSettings:
    lexical_mode: str = "bm25"
    vector_candidates: int = 200
    lexical_candidates: int = 200
    final_candidates: int = 60
    rerank_candidates: int = 30

    @classmethod
    def of(cls, raw: dict) -> SearchSettings:
        n = lambda k, most: int(clamp(raw.get(k) or getattr(cls, k), getattr(cls, k), 1, most))
        mode = "simple" if str(raw.get("lexical_mode", "")).strip().lower() == "simple" else "bm25"
        return cls(mode, n("vector_candidates", 1000), n("lexical_candidates", 1000), n("final_candidates", 500), n("rerank_candidates", 200))


@dataclass(frozen=True)
class Request:
    """A retrieval request in any of the spellings that clients use."""

    query: str
    source: str = ""
    top_k: int = 8
    threshold: float = 0.15
    project: str = ""
    remote: bool = False
    fresh: bool = False
    condition: dict = field(default_factory=dict)

    @classmethod
    def of(cls, body: dict) -> Request:
        setting = body.get("retrieval_setting") or body.get("retrievalSetting") or {}
        hints, policy = body.get("hints") or {}, body.get("privacy") or {}
        first = lambda *vs: next((v for v in vs if v is not None), None)
        text = lambda *names: next((str(body[n]).strip() for n in names if str(body.get(n) or "").strip()), "")
        return cls(
            text("query", "q", "question"),
            text("sourceId", "source_id", "knowledge_id", "knowledgeId"),
            int(clamp(first(body.get("top_k"), body.get("topK"), body.get("limit"), setting.get("top_k"), setting.get("topK")), 8, 1, 30)),
            clamp(first(body.get("score_threshold"), body.get("scoreThreshold"), setting.get("score_threshold"), setting.get("scoreThreshold")), 0.15, 0, 1),
            str(hints.get("project") or "").strip(),
            policy.get("allowRemoteContext") is True,
            hints.get("needFreshIndex") is True,
            body.get("metadata_condition") or body.get("metadataCondition") or {},
        )


def find_source(sources: DataFrame, name: str) -> DataFrame:
    """The source of an id, else of a title or folder name, as no row or one."""
    folded = lambda c: F.lower(F.replace(F.trim(c), F.lit("\\"), F.lit("/")))
    wanted = name.strip().replace("\\", "/").lower()
    tier = F.when(F.col("source_id") == name.strip(), 0).when((folded(F.col("title")) == wanted) | (folded(base_name(F.col("path"))) == wanted), 1)
    return sources.withColumn("_tier", tier).filter("_tier is not null").orderBy("_tier", "source_id").limit(1).drop("_tier")


def resolve_scope(question: str, sources: DataFrame, requested: str = "", context: str = "") -> dict:
    """Which contract a question is about: the one requested, a confident match, the conversation's; else all of them."""
    spark = sources.sparkSession
    contracts = sources.filter("source_type = 'contract'")
    asked = spark.createDataFrame([(0, question)], "question_id int, question string")
    every = asked.select(recognition.intent(F.col("question"))["all_sources"].alias("a")).first()["a"]
    has = lambda i: bool(i) and not contracts.filter(F.col("source_id") == i).isEmpty()
    source = requested if not every and has(requested) else ""
    from_context = False
    if not source and not requested and not every:
        best = matching.match_sources(asked, contracts).filter("rank = 1 and confident").first()
        source = best["source_id"] if best else ""
        if not source and has(context):
            source, from_context = context, True
    all_sources = every or (not source and not requested)
    ids = [] if all_sources or not source else [r["member_id"] for r in matching.scope_expansion(sources).filter(F.col("source_id") == source).orderBy("member_id").collect()]
    return {"source_id": source, "source_ids": ids, "all_sources": all_sources, "context_used": from_context, "missing": bool(requested and not source and not every)}


def run_retrieval(body: dict, sources: DataFrame, chunks: DataFrame, files: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, remote_allowed: bool = False, scorer: Callable | None = None) -> tuple[int, dict, DataFrame | None]:
    """(status, metadata with warnings, records): one request through scope, search and threshold."""
    r = Request.of(body)
    if not r.query:
        return 400, {"error": "query is required"}, None
    spark = sources.sparkSession
    if r.source:
        found = find_source(sources, r.source).first()
        if found is None:
            return 404, {"error": "source was not found"}, None
        source, auto, every = found["source_id"], False, False
    else:
        scope = resolve_scope(" ".join(filter(None, (r.project, r.query))), sources)
        source, auto, every = scope["source_id"], bool(scope["source_id"]), scope["all_sources"]
    ids = None
    if source:
        members = matching.scope_expansion(sources).filter(F.col("source_id") == source).select(F.col("member_id").alias("owner_id"))
        stored = matching.expanded_ids(files, sources).join(members, "owner_id", "left_semi") if files is not None else members.withColumnRenamed("owner_id", "source_id")
        ids = [x["source_id"] for x in stored.select("source_id").distinct().collect()]
    q = spark.createDataFrame([(0, r.query, query_vector)], "query_id int, query_text string, query_vector array<double>")
    q = q if vectors is not None else q.drop("query_vector")
    hits = retrieval.search(chunks, q, vectors, limit=r.top_k, scorer=scorer, source_ids=ids)
    records = hits.filter(F.col("score") >= r.threshold).withColumn("content", truncate_text(F.col("snippet"), 1200)["text"])
    warnings = [
        text
        for said, text in (
            (r.fresh, "needFreshIndex was requested; the current index was searched"),
            (bool(r.condition), "metadata_condition was received; only the source scope is applied"),
            (every and not auto, "source auto-match was not confident; all indexed sources were searched"),
            (r.remote and not remote_allowed, "remote context was denied by policy"),
        )
        if said
    ]
    return 200, {"query": r.query, "source_id": source, "matched_automatically": auto, "remote_context_allowed": r.remote and remote_allowed, "warnings": warnings}, records


def quality_filter(files: DataFrame, wanted: str = "all") -> DataFrame:
    """all, searchable, or those of a status."""
    if wanted == "searchable":
        return files.filter("chunks > 0")
    if wanted in ("ok", "warning", "error"):
        return files.filter(quality.file_status(F.col("status"), F.col("chunks")) == wanted)
    return files


def quality_counts(files: DataFrame, wanted: tuple[str, ...] = ("all", "searchable", "ok", "warning", "error")) -> DataFrame:
    """(wanted, n): how many files each filter of quality_filter lets through, from one reading of the files."""
    status = quality.file_status(F.col("status"), F.col("chunks"))
    kept = lambda w: F.col("chunks") > 0 if w == "searchable" else F.col("status_") == w if w in ("ok", "warning", "error") else F.lit(True)
    counts = files.select(status.alias("status_"), "chunks").agg(*(F.count_if(kept(w)).alias(w) for w in wanted))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(w).alias("wanted"), F.col(w).alias("n")) for w in wanted))))


def indexed_files(files: DataFrame, source_id: str, wanted: str = "all") -> DataFrame:
    """A source's files without absolute paths, with their strings redacted."""
    return privacy.sanitize_frame(quality_filter(files.filter(F.col("source_id") == source_id), wanted).drop("path"))


def list_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources with counts and a masked path."""
    counts = files.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))
    return sources.join(counts, "source_id", "left").fillna(0, ["files", "chunks"]).withColumn("path", privacy.mask_path(F.col("path")))


def preview_target(files: DataFrame, chunk_path: str = "", file_id: str = "", path: str = "") -> DataFrame:
    """The file to show: of the chunk if there is one, else of the id, else of the path. One kind of key decides alone."""
    if any(x in p.lower() for p in (chunk_path, path) for x in ("%2e", "%2f", "%5c")):
        return files.limit(0)
    key = F.col("path") == chunk_path if chunk_path else F.col("file_id") == file_id if file_id else F.col("path") == path
    return files.filter(key).orderBy("file_id").limit(1)


def temporary_path(path: Column) -> Column:
    """Folders that tests and uploads leave behind."""
    p = F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/")))
    return p.contains("/appdata/local/temp/") | p.startswith("/tmp/")


def chat_models(models: DataFrame) -> DataFrame:
    """Models that aren't for embeddings."""
    return models.filter(~F.concat_ws(" ", "id", "type").rlike("(?i)embed"))


def index_overview(files: DataFrame, latest_jobs: DataFrame) -> DataFrame:
    """One row: files by status, recognised, chunks, jobs by state, and the overall status. latest_jobs: status, failed, health."""
    status = quality.file_status(F.col("status"), F.col("chunks"))
    f = files.agg(F.count("*").alias("indexed"), *(F.count_if(status == s).alias(s) for s in ("ok", "warning", "error", "unchecked")), F.count_if((F.col("chunks") > 0) & (status != "error")).alias("recognized"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    j = latest_jobs.agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("health") == "stale").alias("stale"), F.count_if(F.col("health") == "interrupted").alias("interrupted"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    trouble = (F.col("failed") > 0) | (F.col("interrupted") > 0)
    overall = (
        F.when((F.col("running") > 0) & (F.col("stale") > 0), "warning")
        .when(F.col("running") > 0, "running")
        .when(F.col("recognized") > 0, F.when(trouble, "warning").otherwise("ready"))
        .when(F.col("interrupted") > 0, "warning")
        .otherwise("empty")
    )
    return f.crossJoin(j).withColumn("overall", overall)  # one row each


def link_status(links: DataFrame, files: DataFrame, latest_jobs: DataFrame) -> DataFrame:
    """Links with what the index and the source's latest job say of them. links: link_id, source_id; files: link_id, chunks, status."""
    f = files.filter("link_id is not null").groupBy("link_id").agg(F.max("chunks").alias("chunks"), F.max("status").alias("file_status"))
    df = links.join(f, "link_id", "left").join(latest_jobs.select("source_id", F.col("status").alias("job_status")), "source_id", "left")
    state = F.when(F.col("job_status") == "running", "indexing").when(F.col("file_status") == "error", "error").when(F.col("chunks") > 0, "indexed").otherwise("not_indexed")
    return df.withColumn("link_status", state)


def folder_report(folders: DataFrame, categories: list[str]) -> DataFrame:
    """Folders of each wanted category, those without any included. folders: category, name."""
    wanted = folders.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = folders.filter("name <> 'desktop.ini'").groupBy("category").agg(F.count("*").alias("folders"))
    df = wanted.join(counts, "category", "left").fillna(0, ["folders"])
    return df.withColumn("status", F.when(F.col("folders") > 0, "readable").otherwise("missing"))


def run_agent(source_ids: list[str], index: Callable[[str], dict], now: Callable[[], str], run_id: str) -> tuple[dict, list[dict]]:
    """Index sources one by one; a failure is that source's row, and the run goes on. Returns the run and its rows."""
    began, rows = now(), []
    for s in source_ids:
        try:
            rows.append({"source_id": s, "status": "completed", **index(s)})
        except Exception as e:  # the row says what went wrong
            rows.append({"source_id": s, "status": "failed", "error": f"{type(e).__name__}: {e}"[:500]})
    totals: dict[str, int] = {}
    for r in rows:
        for k, v in r.items():
            if isinstance(v, int):
                totals[k] = totals.get(k, 0) + v
    failed = sum(r["status"] == "failed" for r in rows)
    run = {"id": run_id, "status": "completed" if failed < len(rows) or not rows else "failed", "started_at": began, "finished_at": now(), "totals": totals | {"sources": len(rows), "failed_sources": failed}}
    return run, rows


def public_runs(runs: DataFrame, alive: Column, keep: int = 20) -> DataFrame:
    """The newest runs; a running one without a live process is interrupted, and so are its sources."""
    df = runs.withColumn("_dead", (F.col("status") == "running") & ~alive)
    if "sources" in runs.columns:
        fixed = F.transform("sources", lambda s: s.withField("status", F.when(F.col("_dead") & (s["status"] == "running"), "interrupted").otherwise(s["status"])))
        df = df.withColumn("sources", fixed)
    return df.withColumn("status", jobs.reinterpreted(F.col("status"), alive)).drop("_dead").orderBy(F.desc("started_at"), "id").limit(keep)
