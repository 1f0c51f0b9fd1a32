"""The pruned walk against a plain one, and JSON objects at every cut of their file."""

from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from docsift.sources import folders, json_objects

OBJECTS = [
    {"id": 1, "text": 'quote " and brace } and { and \\'},
    {"id": 2, "text": "\\\\\" [ ] é 🙂", "inner": {"a": [{"b": "}"}], "c": "\\"}},
    {"id": 3, "text": ""},
    {"id": 4, "text": "{\"id\": 5}", "inner": {}},
    {"id": 6, "text": "\\" * 9 + '"'},
]


def test_objects_at_every_cut(tmp_path):
    for name, text in (("array", json.dumps(OBJECTS, ensure_ascii=False)), ("lines", "\n".join(map(json.dumps, OBJECTS))), ("spaced", json.dumps(OBJECTS, indent=3))):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        size = path.stat().st_size
        for cut in range(1, size):
            for block in (3, 1 << 20):
                found, state, depth = [], 0, 0
                for first, last in ((0, cut), (cut, size)):
                    found += json_objects.objects(str(path), first, last, state, depth, block)
                    states = json_objects.transitions(str(path), first, last, block)
                    state, depth = states[state][0], depth + states[state][1]
                assert [json.loads(raw) for _, raw in found] == OBJECTS, (name, cut, block)
                assert (state, depth) == (0, 0)


def test_objects_of_small_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"id": i, "text": "".join(rng.choice('ab{}[]"\\,:é\n') for _ in range(rng.randrange(60)))} for i in range(300)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(rows[:200], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "a" / "two.json").write_text("\n".join(map(json.dumps, rows[200:])) + '\n{"id": 999, "text": "never ends', encoding="utf-8")
    (tmp_path / "a" / "empty.json").write_text("")
    schema = "id long, text string"
    for size in (64, 1000, 1 << 20):
        got = json_objects.read_objects(spark, str(tmp_path / "a"), schema, range_bytes=size)
        assert sorted((r["id"], r["text"]) for r in got.collect()) == [(r["id"], r["text"]) for r in rows]
    assert json_objects.read_objects(spark, str(tmp_path / "none.json"), schema, fallback=True).count() == 0


def test_first_object_reads_no_further(spark, tmp_path):
    path = tmp_path / "one.json"
    rows = [{"id": i, "text": "x" * 50} for i in range(400)]
    path.write_text(json.dumps(rows))
    find = lambda c: [r["id"] for r in json_objects.first_object(spark, str(path), "id long, text string", c, range_bytes=500, together=2).collect()]
    assert find(F.col("id") % 100 == 99) == [99] and find(F.col("id") == 399) == [399] and find(F.col("id") < 0) == []


def test_arrays_written_and_read(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit('{"\\'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, F.lit(1.5)).alias("x")).repartition(3)
    json_objects.write_arrays(df, str(tmp_path / "out"))
    files = sorted(os.listdir(tmp_path / "out"))
    assert files == [f"part-{i:06d}.json" for i in range(3)]
    assert sum(len(json.loads((tmp_path / "out" / f).read_text())) for f in files) == 1000
    got = json_objects.read_objects(spark, str(tmp_path / "out"), "id long, text string, x double", range_bytes=2000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_walk_prunes_and_counts(spark, tmp_path):
    root = tmp_path / "root"
    for path in ("a.md", "~$a.docx", "x/b.pdf", "x/.hidden.txt", "x/empty.csv", "x/deep/er/c.exe", "node_modules/d.md", "old/e.md", "x/old/f.md", "_g.log", "x/noext"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("" if "empty" in path else "text")
    (root / "link").symlink_to(root / "x")
    (root / "none").mkdir()
    entries = folders.walk(spark, [str(root)], ["old/**", "*/old*"])
    seen = {(r["relative_path"], r["kind"]) for r in entries.collect()}
    assert {p for p, kind in seen if kind == "file"} == {"a.md", "~$a.docx", "x/b.pdf", "x/.hidden.txt", "x/empty.csv", "x/deep/er/c.exe", "_g.log", "x/noext", "old/e.md"}
    assert {p for p, kind in seen if kind == "pruned"} == {"node_modules", "x/old"}
    sizes = {r["relative_path"]: r["size"] for r in folders.walked_files(entries).collect()}
    assert sizes["x/empty.csv"] == 0 and sizes["a.md"] == 4
    counters = folders.scan_counters(entries, exclude=["old/**"]).first().asDict()
    assert counters == {"total_files": 9, "eligible_files": 5, "unsupported_files": 2, "temporary_files": 1, "excluded_files": 1, "included_files": 7, "excluded_by_exclude": 1, "excluded_by_include": 0, "directories": 7, "unreadable_directories": 0}
    assert {r["relative_path"] for r in folders.skipped_files(entries).collect()} == {"~$a.docx", "x/deep/er/c.exe", "x/noext"}
    two = folders.walk(spark, [str(root / "x"), str(root / "gone"), str(root / "x")])
    assert {r["relative_path"] for r in two.filter("kind = 'file'").collect()} >= {"[x]/b.pdf", "[x]/deep/er/c.exe"}
    bad = two.filter("kind = 'unreadable'").collect()
    assert len(bad) == 1 and bad[0]["path"] == str(root / "gone") and "FileNotFoundError" in bad[0]["error"]
    assert folders.scan_counters(two).first()["unreadable_directories"] == 1


def test_excluded_folders_are_never_listed(tmp_path, monkeypatch):
    listed = []
    real = os.scandir
    monkeypatch.setattr(folders.os, "scandir", lambda p: listed.append(p) or real(p))
    (tmp_path / "node_modules").mkdir()
    assert [row[3] for row in folders._entries("r", str(tmp_path), "")] == ["folder"] and listed == [str(tmp_path)]
