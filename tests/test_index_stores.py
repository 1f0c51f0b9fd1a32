"""The vector index against all pairs; snapshots with writers that meet or die; audits that go on; contents by path."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docsift.operators import ann
from docsift.plans import audit_runs, index_queries, ingest
from docsift.sources.snapshots import Conflict, Snapshots

SF = "/root/testdata/sf0.001"
ROWS = "id long, source string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(index_queries.SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = ", ".join(df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(f"SELECT {columns} FROM ({index_queries.SQL[name]})").fetchall()))


def vectors(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 6))
    rows = [(i, [float(np.float32(x)) for x in middles[int(rng.integers(9) ** 0.5) if i % 3 else 0] + 0.3 * rng.normal(size=6)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 6), (n + 3, [1.0, 2.0]), (n + 4, [1.0] * 6), (n + 5, [1.0] * 6)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>"), dict(rows)


def nearest(rows, q, k):
    dot = lambda a, b: round(sum(x * y for x, y in zip(a or [], b or [])), 6)
    return sorted(((-dot(rows[q], v), i) for i, v in rows.items() if dot(rows[q], v) > 0))[:k]


def test_index_equals_all_pairs(spark, tmp_path):
    """Skewed cells in parts, and a second round that ends with the exact result; also from the stored index."""
    df, rows = vectors(spark, 400)
    index = ann.build(df, cells=12, cap=15)
    assert max(index.parts) > 2 and index.rows.count() == len(rows)
    index.save(str(tmp_path / "index"))
    index = ann.Index.load(spark, str(tmp_path / "index"))
    asked = [0, 7, 33, 390, 400, 401, 402, 403, 404]
    queries = df.filter(F.col("chunk_id").isin(asked)).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    for nprobe in (1, 3):
        got = {}
        for r in ann.search(index, queries, 7, nprobe, exact=True).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
        for q in asked:
            want = nearest(rows, q, 7)
            assert [i for _, i in got.get(q, [])] == [i for _, i in want], q
            np.testing.assert_allclose([s for s, _ in got.get(q, [])], [s for s, _ in want], atol=2e-6)
    nprobe = ann.probes_for(index, queries, 0.9, 7)
    assert ann.recall(index, queries, ann.search(index, queries, 7, 1, exact=True), 7, nprobe) >= 0.9


def test_index_of_nothing(spark):
    df = spark.createDataFrame([], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>")
    assert ann.search(ann.build(df), queries).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [0.0])], df.schema)
    assert ann.search(ann.build(nulls), queries, exact=True).count() == 0


def ids(store, version=None, **k):
    return sorted(r["id"] for r in store.read("a", ROWS, version, **k).collect())


def test_versions(spark, tmp_path):
    frame = lambda *x: spark.createDataFrame([(i, "s") for i in x], ROWS)
    store = Snapshots(spark, str(tmp_path / "store"))
    assert ids(store) == [] and store.versions() == [] and store.vacuum() == 0
    w = store.begin()
    w.replace("a", frame(1, 2), "x")
    w.replace("a", frame(3), "y")
    assert ids(store) == []
    assert w.commit(by="me").number == 1 and ids(store) == [1, 2, 3] and ids(store, parts=["y"]) == [3]

    # Two writers from one version: other parts both get through, the same part doesn't.
    one, two, three = store.begin(), store.begin(), store.begin()
    one.replace("a", store.read("a", ROWS, parts=["x"]).filter("id = 2"), "x")
    two.replace("a", frame(4), "y")
    three.replace("a", frame(9), "x")
    assert (one.commit().number, two.commit().number) == (2, 3) and ids(store) == [2, 4]
    with pytest.raises(Conflict):
        three.commit()
    assert ids(store) == [2, 4] and ids(store, 1) == [1, 2, 3] and store.versions() == [1, 2, 3]
    reader = store.begin()
    reader.depends("a")
    reader.replace("b", frame(7))
    w = store.begin()
    w.drop("a", "y")
    w.commit()
    with pytest.raises(Conflict):
        reader.commit()

    # Old versions go; what the rest names, and what is young, stays.
    assert store.vacuum(keep=2) == 0 and store.versions() == [3, 4]
    assert store.vacuum(keep=1, older_ms=-1) >= 4 and ids(store) == [2]
    with pytest.raises(KeyError):
        store.version(1)
    assert [v.number for v in store.notes("by", "me")] == [] and store.note(by="me").tables == store.version(4).tables


def test_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """Between the tables, and just before the version is published: readers see the version before, and the run done again ends well."""
    root, index = tmp_path / "src", str(tmp_path / "index")
    root.mkdir()
    (root / "a [1]{x}*.txt").write_text("Слово за словом. " * 30)
    run = lambda: ingest.index_source(spark, index, "s", [str(root)])
    state = lambda: [sorted((r["title"], r["size"]) for r in ingest.read_index(spark, index, "files").collect()), ingest.read_index(spark, index, "chunks").select("file_id").distinct().count()]
    assert run()["new"] == 1
    before = state()
    (root / "b.txt").write_text("Another text of some words. " * 30)

    def dies(*_):
        raise KeyboardInterrupt

    store_type = type(ingest.store(spark, index))
    writer_type = type(ingest.store(spark, index).begin())
    put = writer_type.replace
    with monkeypatch.context() as m:
        m.setattr(writer_type, "replace", lambda self, table, rows, part="": dies() if table == "files" else put(self, table, rows, part))
        with pytest.raises(KeyboardInterrupt):
            run()
    with monkeypatch.context() as m:
        m.setattr(store_type, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            run()
    assert state() == before
    assert run()["new"] == 1 and state()[1] == 2 and len(state()[0]) == 2


def test_only_wanted_files_are_opened(spark, tmp_path):
    """An unchanged file that can't be read any more does not disturb a run."""
    root, index = tmp_path / "src", str(tmp_path / "index")
    root.mkdir()
    for name in ("old.txt", "same.txt"):
        (root / name).write_text("Some words of a text. " * 20)
    os.utime(root / "old.txt", (1_000_000, 1_000_000))
    seen = tmp_path / "seen"

    def converter(extension, content):
        with open(seen, "a") as f:
            f.write(f"{len(content)}\n")
        return content.decode()

    run = lambda: ingest.index_source(spark, index, "s", [str(root)], converter)
    run()
    (root / "old.txt").write_text("Changed words of an older text. " * 20)
    os.utime(root / "old.txt", (1_500_000, 1_500_000))
    seen.unlink()
    assert run()["changed"] == 1
    assert seen.read_text().split() == [str(os.path.getsize(root / "old.txt"))]
    rows = ingest._contents(spark, ingest.read_index(spark, index, "files").filter("title = 'old.txt'"))
    assert [p.rsplit("/", 1)[-1] for p in rows.inputFiles() if p.endswith(".txt")] == ["old.txt"]


def test_an_audit_goes_on(spark, tmp_path):
    tenders = spark.range(40).select(F.col("id").alias("tender_id"))
    store, calls = Snapshots(spark, str(tmp_path / "runs")), []

    def audit(fail):
        def findings_of(own):
            calls.append(1)
            if len(calls) == fail:
                raise RuntimeError("lost")
            return own.select("tender_id", (F.col("tender_id") % 3).alias("finding"))

        return audit_runs.run_audit(store, "r1", tenders, findings_of, blocks=5)

    with pytest.raises(RuntimeError):
        audit(fail=3)
    assert len(audit_runs.done_blocks(store, "r1")) == 2
    state = audit(fail=0)
    assert len(calls) == 3 + 3 and (state["resumed_from"], state["findings"]) == (2, 40)
    found = audit_runs.findings(store, "r1", "tender_id long, finding long").collect()
    assert sorted((r[0], r[1]) for r in found) == [(i, i % 3) for i in range(40)]
    assert audit(fail=0)["resumed_from"] == 5 and len(calls) == 6
