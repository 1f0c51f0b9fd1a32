"""Stored slot maps are never rewritten."""

from __future__ import annotations

import os

import pytest

from docsift.llm import sharding


def test_versions_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "maps")
    first = sharding.SlotMap.initial(4, 16)
    assert first.save(spark, path)
    other = sharding.SlotMap(0, 2, tuple(s % 2 for s in range(16)))
    assert not other.save(spark, path) and sharding.SlotMap.load(spark, path) == first
    assert sorted(os.listdir(path)) == ["version=0"]

    # A writer that dies while it writes the next version leaves what is there.
    class Dies(sharding.SlotMap):
        def frame(self, spark):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Dies(1, 4, first.shard_of).save(spark, path)
    spark.range(3).write.parquet(f"{path}/_staged-dead")
    assert sharding.SlotMap.latest(spark, path, 4, 16) == first
    assert sharding.SlotMap(1, 4, first.shard_of[::-1]).save(spark, path) and sharding.SlotMap.latest(spark, path, 4, 16).version == 1
    assert sharding.SlotMap.load(spark, path, 0) == first


def test_runs_go_on_from_the_latest(spark, tmp_path):
    path = str(tmp_path / "maps")
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "doc_id long, text string")
    assert [sharding.op4_sharding(docs, maps=path).first()["map_version"] for _ in range(3)] == [1, 2, 3]
    assert sorted(os.listdir(path)) == [f"version={i}" for i in range(4)]
