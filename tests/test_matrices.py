"""Half-precision matrices: ranges read by many tasks, rows placed by many tasks, headers of numpy's own."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.sources import matrices, readers


def read(df):
    return {r["row"]: r["vector"] for r in df.collect()}


@pytest.mark.parametrize("shape", [(0, 3), (1, 1), (1000, 5), (333, 64)])
def test_reads_what_numpy_writes(spark, tmp_path, shape):
    table = np.random.default_rng(1).normal(size=shape).astype("<f2")
    path = str(tmp_path / "a b.npy")
    np.save(path, table)
    df = matrices.read_matrix(spark, path, range_bytes=700)
    assert read(df) == {i: [float(x) for x in row] for i, row in enumerate(table)}
    assert df.rdd.getNumPartitions() == max(1, -(-shape[0] // max(1, 700 // (2 * shape[1]))))
    assert read(matrices.read_matrix(spark, "file://" + path.replace(" ", "%20"), 2)) == {i: [float(x) for x in row[:2]] for i, row in enumerate(table)}


def test_rows_are_placed_in_order(spark, tmp_path):
    rng, path = np.random.default_rng(2), str(tmp_path / "new" / "m.npy")
    rows = [(i * 3, None if i == 5 else [float(x) for x in rng.normal(size=int(rng.integers(0, 7)))]) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, vector array<double>").repartition(9)
    assert matrices.write_matrix(df, path, 4, "k") == (400, 4)
    want = np.zeros((400, 4), "<f2")
    for i, (_, v) in enumerate(rows):
        want[i, : min(4, len(v or []))] = (v or [])[:4]
    np.testing.assert_array_equal(np.load(path), want)
    assert os.listdir(tmp_path / "new") == ["m.npy"]
    assert matrices.write_matrix(df.limit(0), path, 4, "k") == (0, 4) and np.load(path).shape == (0, 4)


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "m.npy")
    df = spark.createDataFrame([(1, [1.0])], "k long, vector array<double>")
    matrices.write_matrix(df, path, 1, "k")
    bad = spark.createDataFrame([(1, ["x"])], "k long, vector array<string>")
    with pytest.raises(Exception):
        matrices.write_matrix(bad, path, 1, "k")
    assert np.load(path).tolist() == [[1.0]] and os.listdir(tmp_path) == ["m.npy"]


def test_files_that_are_none(spark, tmp_path):
    for name, content in (("short", b"\x93NUM"), ("other", b"x" * 200)):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError):
            matrices.shape_of(str(tmp_path / name))
    np.save(tmp_path / "f4.npy", np.zeros((2, 2), "f4"))
    np.save(tmp_path / "cut.npy", np.zeros((20, 2), "f2"))
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-1])
    for name in ("f4.npy", "cut.npy"):
        with pytest.raises(ValueError):
            matrices.shape_of(str(tmp_path / name))


def test_lines_and_vectors_meet(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(20, dtype="f2").reshape(10, 2))
    (tmp_path / "r.jsonl").write_text("".join(f'{{"row": {i}, "text_hash": "h{i}"}}\n' for i in (0, 3, 9)))
    got = readers.read_vectors(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "v.npy"), 2)
    assert {r["text_hash"]: r["vector"] for r in got.select("text_hash", F.col("vector")).collect()} == {f"h{i}": [2.0 * i, 2.0 * i + 1] for i in (0, 3, 9)}
