"""Many requests with scopes of their own against a plain BM25 over each request's chunks."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from docsift.operators import scoped


def plain(chunks, terms, scope, k):
    own = [(i, t.split(), s) for i, t, s in chunks if scope is None or s in scope]
    n, length = len(own), sum(max(1, len(t)) for _, t, _ in own) / max(1, len(own))
    out = []
    for i, t, _ in own:
        score = 0.0
        for w in set(terms):
            tf, df = t.count(w), sum(w in u for _, u, _ in own)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(1, len(t)) / length))
        if score > 0:
            out.append((-round(score, 6), i))
    return [i for _, i in sorted(out)[:k]]


def test_requests_with_scopes(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(words[min(rnd.randrange(30), rnd.randrange(30))] for _ in range(n))
    chunks = [(i, text(rnd.randrange(0, 20)), rnd.choice(["a", "b", "c", "d", "", None])) for i in range(150)]
    requests = [(i, text(rnd.randrange(0, 4)).split(), rnd.randrange(1, 8)) for i in range(200)]
    scopes = {i: set(rnd.sample(["a", "b", "c", "d", "", "gone"], rnd.randrange(1, 4))) for i in range(200) if i % 4}
    frame = spark.createDataFrame(chunks, "chunk_id long, text string, source_id string")
    rows = [(i, s) for i, own in scopes.items() for s in own] + [(1, s) for s in scopes[1]] + [(0, None)]
    got = scoped.search(frame, spark.createDataFrame(requests, "query_id long, terms array<string>, top_k long"), spark.createDataFrame(rows, "query_id long, source_id string"))
    found: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i, terms, k in requests:
        assert found.get(i, []) == plain(chunks, terms, scopes.get(i), k), i


def test_nothing_to_search(spark):
    requests = spark.createDataFrame([(1, ["ww"], 3)], "query_id long, terms array<string>, top_k long")
    scopes = spark.createDataFrame([(1, "a")], "query_id long, source_id string")
    chunks = spark.createDataFrame([(1, "ww", "b")], "chunk_id long, text string, source_id string")
    assert scoped.search(chunks, requests, scopes).count() == 0
    assert scoped.search(chunks.limit(0), requests, scopes.limit(0)).count() == 0
    assert scoped.search(chunks, requests.limit(0), scopes).count() == 0
    assert [r["chunk_id"] for r in scoped.search(chunks, requests, scopes.limit(0)).collect()] == [1]


def test_sources_by_name(spark):
    sources = spark.createDataFrame([("s1", "First", "/x/Folder"), ("s2", "first", None), ("first", None, "y\\Ordner"), ("s3", "s1", "")], "source_id string, title string, path string")
    asked = [(1, "q", "s1"), (2, "q", " FIRST "), (3, "q", "folder"), (4, "q", "ordner"), (5, "q", "none"), (6, " ", "s1"), (7, "q", None), (8, "q", "first"), (9, None, None)]
    requests = spark.createDataFrame(asked, "query_id long, query_text string, source string")
    members = spark.createDataFrame([("s1", "m1"), ("s1", "s1")], "source_id string, member_id string")
    status, scopes = scoped.resolved(requests, sources, members)
    assert {r["query_id"]: (r["status"], r["source_id"]) for r in status.collect()} == {
        1: (200, "s1"), 2: (200, "s1"), 3: (200, "s1"), 4: (200, "first"), 5: (404, None), 6: (400, None), 7: (200, None), 8: (200, "first"), 9: (400, None)
    }
    assert {r[0]: sorted(r[1]) for r in scopes.groupBy("query_id").agg(F.collect_list("source_id")).collect()} == {1: ["m1", "s1"], 2: ["m1", "s1"], 3: ["m1", "s1"], 4: ["first"], 8: ["first"]}
