"""Joins of likeness against all pairs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from docsift.operators import likeness, matching


def plain_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.7
    x, y = ({t for t in re.split(r"[\s,./-]+", v) if len(t) > 2} for v in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def titles(rng: random.Random, n: int) -> list[str]:
    """Words of very different frequency; most titles hold the first."""
    words = ["works"] + [f"w{i}x" for i in range(12)] + ["of", "a"]
    return [" ".join(["works"] * (rng.random() < 0.8) + [words[min(int(rng.expovariate(0.3)), 14)] for _ in range(rng.randrange(0, 6))]) for _ in range(n)] + ["", "w1", "orks w2", "works"]


def test_alike_is_all_pairs(spark):
    rng = random.Random(11)
    a, b = titles(rng, 120), titles(rng, 120)
    frame = lambda v: spark.createDataFrame([(x,) for x in v] + [(None,)], "value string")
    for threshold in (0.3, 0.55, 0.7):
        got = {(r["a"], r["b"]): r["score"] for r in likeness.alike(frame(a), frame(b), threshold).collect()}
        want = {(x, y): plain_score(x, y) for x in a for y in b if x and y and plain_score(x, y) >= threshold}
        assert got == want
    empty = spark.createDataFrame([], "value string")
    assert likeness.alike(empty, frame(b), 0.5).count() == 0 and likeness.alike(frame(a), empty, 0.5).count() == 0


def test_contained_within_groups(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randrange(n)))
    patterns, texts = [(rng.randrange(3), word(14)) for _ in range(80)], [(rng.randrange(3), word(40)) for _ in range(80)]
    patterns.append((None, "ab"))
    texts.append((None, "cab"))
    p, t = spark.createDataFrame(patterns, "g int, pattern string"), spark.createDataFrame(texts, "g int, text string")
    want = {(g, p, t) for g, p in patterns for h, t in texts if g == h and p and p in t}
    for options in ({}, {"few_patterns": True}, {"kind": "g", "few_patterns": True}):
        got = likeness.contained(p, t, ("g",), **options).collect()
        told = {w for w in want if w[0] is not None or "kind" not in options}  # a kind isn't null
        assert len(got) == len(told) and {tuple(r) for r in got} == told


def test_a_common_word_is_no_key(spark):
    left = spark.createDataFrame([(f"works of object{i} street{i}",) for i in range(400)], "value string")
    pairs = likeness.overlapping(left, left, 0.55)
    assert pairs.count() == 400
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tenders_by_likeness_are_all_pairs(spark):
    rng = random.Random(13)
    a, b, roads = titles(rng, 60), titles(rng, 60), ["", "", "long road 1", "long road 2", "short road, 1", "road"]
    tenders = [(str(i), "", f"n{i}", t, rng.choice(roads)) for i, t in enumerate(a)]
    sources = [(f"s{i:03d}", "tender", "", "", t, rng.choice(roads)) for i, t in enumerate(b)]
    t = spark.createDataFrame(tenders, "tender_id string, linked_contract_id string, tender_number string, title string, object_address string")
    s = spark.createDataFrame(sources, "source_id string, source_type string, hub_tender_id string, linked_contract_id string, title string, object_address string")
    got = {r["tender_id"]: (r["source_id"], round(r["score"], 9)) for r in matching.match_tenders(t, s).collect()}
    want = {}
    for key, _, _, title, road in tenders:
        scored = [((plain_score(title, x[4]) + plain_score(road, x[5])) / 2 if road else plain_score(title, x[4]), x[0]) for x in sources]
        score, source = min(((-v, k) for v, k in scored))
        want[key] = (source, round(-score, 9)) if -score >= 0.55 else (None, 0.0)
    assert got == want and len({v for v, _ in want.values()}) > 5
    assert matching.match_tenders(t, s.limit(0)).filter(F.col("strategy") != "unmatched").count() == 0
