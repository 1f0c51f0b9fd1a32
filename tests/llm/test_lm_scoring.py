"""Scores of the backoff automaton against a plain n-gram model of whole strings."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import lm_scoring

WHITE = " \t\n\x0b\x0c\r"


def tokens(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            out, word = (out + [word], "") if word else (out, word)
        else:
            word += c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c
    return out + [word] * bool(word) + [("end",)]


def plain(rows, held, order, strengths):
    counts = Counter()
    for i, text in rows:
        if not held(i):
            seq = [("begin",), *tokens(text)]
            counts.update(tuple(seq[a : a + k]) for k in range(1, order + 1) for a in range(len(seq) - k + 1))
    words = {g: c for g, c in counts.items() if len(g) == 1 and g != (("begin",),)}
    n, v = sum(words.values()), len(words)

    def p(history, w):
        if not history:
            return (words.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1))
        s, c = strengths[min(len(history), len(strengths)) - 1], counts[history]
        return (counts[(*history, w)] + s * p(history[1:], w)) / (c + s)

    out = []
    for i, text in rows:
        seq = [("begin",), *tokens(text)]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        own = sum(math.log10(p(tuple(seq[max(0, k - order + 1) : k]), seq[k])) for k in range(1, len(seq)))
        out.append((i, held(i), len(seq) - 1, sum((w,) in words for w in seq[1:]), n, base, own))
    return out


def id_held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def check(spark, rows, order, df=None, **parameters):
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0, F.lit(True))
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted((tuple(r) for r in lm_scoring.score(df, held, order, **parameters).collect()), key=key)
    want = sorted(plain(rows, id_held, order, lm_scoring.STRENGTHS), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(60)] + ["Éé", "ÀB", "a b", "Z", "😀"]
    out = [rnd.choice(["", " ", None, "\t\n"]) if rnd.random() < 0.1 else rnd.choice([" ", "\n", "\x0b "]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for _ in range(n)]
    return out + out[: n // 4]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_strings(spark, order):
    rows = [(i, t) for i, t in enumerate(texts(order, 160))]
    check(spark, rows + rows[:9] + [(None, "w1 w2"), (None, None), (3, "other text")], order, block_bytes=900)


def test_block_size_does_not_matter(spark):
    rows = [(i, t) for i, t in enumerate(texts(9, 80))]
    for block_bytes in (50, 1 << 20):
        check(spark, rows, 2, block_bytes=block_bytes)


def test_rows_of_files_are_blocks(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(11, 90))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    assert df.select(F.input_file_name()).distinct().count() == 5
    check(spark, rows, 2, df, block_bytes=700, near=F.struct(F.input_file_name(), F.input_file_block_start()))


def test_packs_in_pieces_and_slices(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PER_SLICE", 200)
    check(spark, [(i, t) for i, t in enumerate(texts(4, 120))], 3, block_bytes=2000)


def test_edges(spark):
    check(spark, [], 2)
    check(spark, [(None, "a b"), (None, "")], 2)  # nothing is learnt
    check(spark, [(1, "word " * 120_000), (2, "word word"), (3, None)], 2)
    df = spark.createDataFrame([(1, "a b", 5, "x", 2)], "doc_id long, text string, block int, copies string, held_out int")
    assert lm_scoring.op13_lm_scoring(df).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_probabilities_sum_to_one():
    """Over all known words, the end and one unknown word, from any state."""
    rows = [(i, t) for i, t in enumerate(texts(2, 60))]
    training = [t or "" for i, t in rows if not id_held(i)]
    words = sorted({w for t in training for w in tokens(t)[:-1]})
    probes = [f"{a} {b}" for a in words[:3] for b in [*words, "unknown"]]
    n = sum(len(tokens(t)) for t in training)
    both = training + probes + words[:3]
    laid = lm_scoring.Laid(both)
    learn = np.repeat([1] * len(training) + [0] * (len(both) - len(training)), laid.ends - laid.starts)
    automaton = lm_scoring.Automaton(laid, learn, [], 3, n, len(words) + 1, 1, lm_scoring.STRENGTHS)

    def walked(*ws):
        ids = np.array([laid.known[w] for w in ws], np.int32)
        return float(automaton.walk(ids, np.array([0]), np.array([len(ids)]), automaton.state_after[:1])[0])

    for first in words[:3]:
        last = [*(w.encode() for w in words), b"unknown", lm_scoring.END]
        lead = walked(first.encode())
        assert math.isclose(sum(10 ** (walked(first.encode(), w) - lead) for w in last), 1.0, rel_tol=1e-9)


def test_long_texts_are_walked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE", 3)
    texts_ = [t or "" for t in texts(8, 40)]
    got = lm_scoring.scores_of(texts_, np.ones(len(texts_), int), [], 3, 900, 40, 1, lm_scoring.STRENGTHS)
    monkeypatch.setattr(lm_scoring, "PIECE", 1 << 20)
    np.testing.assert_allclose(got, lm_scoring.scores_of(texts_, np.ones(len(texts_), int), [], 3, 900, 40, 1, lm_scoring.STRENGTHS))


def test_held_out_texts_fit_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_scoring.op13_lm_scoring(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
