"""Cases of the third round's findings, each failing before its change."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from docsift.operators import ann, audit, best, embedding, lexical, paged, retrieval
from docsift.plans import service
from docsift.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crops_are_never_broadcast(spark):
    """a plan guesses 20 bytes for a crop of thousands, so the driver gathered them all."""
    chunks = spark.range(30).select(F.col("id").alias("page"), F.lit(0).alias("chunk_ord"), F.lit("t").alias("text"), F.array(F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("b")).alias("block_ids"))
    crops = spark.range(30).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("block_id"), F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")).alias("crop")).unionByName(spark.createDataFrame([("b", "yy")], "block_id string, crop string"))
    got = paged.with_crops(chunks, crops, ["page"], budget=10)
    assert "Broadcast" not in plan(got)
    cut = lambda i: "x" * min(i + 1, 10) + ("\n" + "yy"[: 10 - (i + 1)] if i + 1 < 10 else "")
    assert {r["page"]: r["text"] for r in got.collect()} == {i: "t\n" + cut(i) for i in range(30)}


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


def test_lexical_best_are_chosen_in_tasks(spark):
    """The k best equal those of all pairs, with ties, and no more than k rows of a query leave a task."""
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("w"), (F.col("id") % 40 * i % 17).cast("string")))
    chunks = spark.range(400).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.array_join(words, " ").alias("text")).repartition(3)
    queries = spark.range(25).select(F.col("id").alias("query_id"), F.array(*(F.concat(F.lit("w"), ((F.col("id") + i) % 19).cast("string")) for i in (0, 3, 7))).alias("terms"))
    queries = queries.withColumn("phrase", F.concat_ws(" ", F.lit("w0"), F.get("terms", F.lit(0))))
    k = 5
    assert ranked(lexical.bm25_top(chunks, queries, k)) == ranked(lexical.top_k(lexical.bm25(chunks, queries), k))
    assert ranked(lexical.simple_top(chunks, queries, k)) == ranked(lexical.top_k(lexical.simple_scores(chunks, queries), k))
    wanted = lexical.query_terms(queries)
    post = lexical.postings(lexical.tokenized(chunks), wanted)
    tasks = max(8, spark.sparkContext.defaultParallelism)
    assert best.by_terms(lexical._parts(post, "chunk_id"), wanted, k).count() <= 25 * k * tasks < lexical.bm25(chunks, queries).count()


def test_blocks_of_queries_find_the_same(spark, monkeypatch):
    chunks = spark.range(60).select(F.col("id").alias("chunk_id"), F.concat(F.lit("aa bb w"), (F.col("id") % 7).cast("string")).alias("text"))
    queries = spark.range(12).select(F.col("id").alias("query_id"), F.array(F.lit("aa"), F.concat(F.lit("w"), (F.col("id") % 9).cast("string"))).alias("terms"))
    whole = ranked(lexical.bm25_top(chunks, queries, 3))
    monkeypatch.setattr(best, "BLOCK", 7)
    assert ranked(lexical.bm25_top(chunks, queries, 3)) == whole


def test_nearest_vectors_are_chosen_in_tasks(spark):
    """As all pairs, with vectors of other lengths, null elements, NaN, copies and models."""
    rows = [(i, [float(i % 7) - 3, 0.5, float(i % 3)], "m" if i % 5 else None) for i in range(200)]
    rows += [(900, [1.0], "m"), (901, [1.0, None, 2.0], "m"), (902, [float("nan"), 1.0], "m"), (903, [], "m"), (904, None, "m"), (905, [1.0, 2.0, 3.0, 4.0], "n")]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>, model string").repartition(4)
    q = v.filter("chunk_id % 10 = 0 or chunk_id > 900").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"), "model")
    for vectors, queries in ((v, q), (v.drop("model"), q.drop("model"))):
        got, want = (lexical.top_k(retrieval.vector_scores(vectors, queries), 6), retrieval.nearest(vectors, queries, 6))
        assert list(map(str, ranked(got))) == list(map(str, ranked(want)))
    few = v.filter("chunk_id < 200").drop("model")
    assert best.by_vectors(few, q.filter("query_id < 200").drop("model"), 6).count() <= 20 * 6 * few.rdd.getNumPartitions()


def test_rounding_is_sparks(spark):
    x = [0.1234565, 2.0000005, 1.0000015, 0.0000005, 12345.6789015, 3.3333333, -1.0000005]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6)).collect()]
    assert best.rounded(np.array(x[:-1]), 6).tolist() == want[:-1]


def test_index_search_gives_k_rows_a_task(spark, tmp_path, monkeypatch):
    """No table of pairs, whatever the cells; few files; the probes measured are those that recall needs."""
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(500)] + [(900, [1.0, None, 2.0, 0.0, 0.0])], "chunk_id long, vector array<double>").repartition(6)
    q = v.filter("chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    ann.build(v, cells=20).save(str(tmp_path / "i"))
    index = ann.Index.load(spark, str(tmp_path / "i"))
    assert len(list((tmp_path / "i" / "rows").rglob("*.parquet"))) <= max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert not list((tmp_path / "i" / "rows").glob("cell=*"))
    want = ranked(lexical.top_k(retrieval.vector_scores(v, q), 4))
    for size in (best.VECTOR_BLOCK, 150):
        monkeypatch.setattr(ann, "VECTOR_BLOCK", size)
        got = ann.search(index, q, 4, 2, exact=True)
        assert ranked(got) == want and "Join" not in plan(got)
    n = ann.probes_for(index, q, 0.9, 4)
    exact = ann.search(index, q, 4, 1, exact=True)
    assert ann.recall(index, q, exact, 4, n) >= 0.9 and (n <= 4 or ann.recall(index, q, exact, 4, n // 2) < 0.9)


def test_file_lists_read_files_once(spark):
    """F16: one reading of the files for all filters, with the counts of each filter alone."""
    files = spark.createDataFrame([("ok", 3), ("ok", 0), ("warning", 1), ("error", 2), (None, 4), ("ok", None)], "status string, chunks int")
    got = service.quality_counts(files)
    assert plan(got).count("Scan") <= 1 and "Union" not in plan(got)
    assert {r["wanted"]: r["n"] for r in got.collect()} == {w: service.quality_filter(files, w).count() for w in ("all", "searchable", "ok", "warning", "error")}


def test_audit_makes_records_and_mentions_once(spark, tmp_path):
    """each of a dozen steps parsed all mentions and joined all records anew."""
    records = spark.range(40).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 5).alias("tender_id"), F.concat(F.lit("pipe "), (F.col("id") % 3).cast("string")).alias("position_name"), F.lit("q/a.pdf").alias("quote_link"), F.lit("a.pdf").alias("supplier"))
    chunks = spark.range(6).select((F.col("id") % 4).alias("tender_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("q/b.pdf").alias("path"), F.lit("").alias("title"), F.concat(F.lit("pipe "), (F.col("id") % 3).cast("string"), F.lit(" цена: 1"), F.col("id").cast("string"), F.lit("0.50")).alias("text"))
    records.write.parquet(str(tmp_path / "records"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    got = audit.best_candidates(spark.read.parquet(str(tmp_path / "records")), audit.candidates(spark.read.parquet(str(tmp_path / "chunks"))))
    tree = plan(got)
    assert tree.count(f"{tmp_path}/records") <= 1 and f"{tmp_path}/chunks" not in tree
    best = {r["record_id"]: r["best"] and r["best"]["chunk_id"] for r in got.collect()}
    assert len(best) == 40 and best["4"] is None and best["0"] == "0" and best["1"] == "1" and best["5"] == "4"


def test_findings_parse_only_compared_prices(spark):
    """prices of records without a candidate were parsed as well; their finding shows them as they are."""
    fields = ", ".join(f"{f} string" for f in audit.FIELDS)
    records = spark.createDataFrame([("a", "t", "pipe", "", "", "1 000,5", None, "0", ""), ("b", "u", "pipe", "", "", "x 7", "2", None, None), ("c", "t", "pipe", "", "", "0", None, None, "")], f"record_id string, tender_id string, position_name string, quote_link string, supplier string, {fields}")
    chunks = spark.createDataFrame([("t", "k", "q/b.pdf", "", "pipe цена: 10")], "tender_id string, chunk_id string, path string, title string, text string")
    got = audit.findings(records, audit.candidates(chunks))
    assert sorted((r["record_id"], r["severity"], r["db_value"], r["expected_value"]) for r in got.collect()) == [("a", "warning", "1000.500000", "10.000000"), ("b", "needs_review", "x 7", None), ("c", "needs_review", None, None)]
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    listed = tree[tree.index("posexplode") :]  # below it, only the chosen amount is parsed
    assert all(f"translate(regexp_replace(coalesce(cast({f}" not in listed and f"coalesce({f}" not in listed for f in audit.FIELDS)


def test_vectors_are_computed_once(spark):
    """the filter on empty vectors was pushed below and computed each of them a second time."""
    texts = ["", None, "a", "Alpha beta ALPHA, gamma-1", "x" * 9 + " б" * 5 + " слово 11 1 11 111"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    for n in (16, 300):
        got = embedding.embedded(rows, lambda t: embedding.hashed_vector(t, n), "m", native=True)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
        want = {}
        for i, text in enumerate(texts):
            words = [w for w in re.findall(r"[\w-]+", (text or "").lower()) if len(w) > 1]
            counts = np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % n for w in words], minlength=n)
            if words:
                want[i] = np.float32(counts / np.sqrt((counts * counts).sum())).tolist()
        assert {r["chunk_id"]: r["vector"] for r in got.collect()} == want


def test_converted_texts_leave_a_task_in_pieces(spark):
    """a task held the texts of a whole batch of files, and the batch a second and third time as Python objects."""

    def convert(ext, content):
        with open("/proc/self/statm") as f:
            return f"{int(f.read().split()[1]) * 4096}:" + "x" * 4_000_000

    files = spark.range(60, numPartitions=1).select(F.col("id").alias("file_id"), F.lit(".txt").alias("extension"), F.lit("a").cast("binary").alias("content"))
    got = readers.convert(files, convert).select("file_id", F.substring_index("markdown", ":", 1).cast("long").alias("rss"), F.length("markdown").alias("n"), "error").orderBy("file_id").collect()
    assert len(got) == 60 and all(r["error"] is None and r["n"] > 4_000_000 for r in got)
    assert got[-1]["rss"] - got[0]["rss"] < 120_000_000
