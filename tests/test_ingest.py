"""Indexing runs one after the other, scanned documents against a loop, embedding in batches, spreadsheet cells, queries with SQL."""

from __future__ import annotations

import io
import os
import random
import zipfile
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docsift.operators import embedding, maintenance, scans
from docsift.plans import ingest, ingest_queries, service
from docsift.sources import readers
from docsift.sources.tenders import TenderTables

SF = "/root/testdata/sf0.001"
WORDS = "договор подряда содержит условия оплаты работ материалов сроки ответственность сторон гарантия объект смета акт счет банк город область район улица"


def body(n):
    return " ".join(f"{w} раздел" for w in (WORDS.split() * n)[: 20 * n])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ingest_queries.SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, sql = __spark_entry__.queries()[name](spark, SF), con.sql(ingest_queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    rows = lambda names, found: sorted(([r[names.index(c)] for c in columns] for r in found), key=repr)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_index_source(spark, tmp_path):
    root, index = tmp_path / "src", str(tmp_path / "index")
    root.mkdir()
    (root / "a.md").write_text("## Page 3\n\n" + body(6))
    (root / "b.txt").write_text(body(2))
    (root / "bad.pdf").write_text("x")
    (root / "c.bin").write_text("x")
    run = lambda **k: ingest.index_source(spark, index, "s 1/х", [str(root)], **k)
    files = lambda: {r["title"]: r for r in ingest.read_index(spark, index, "files").collect()}
    chunks = lambda: ingest.read_index(spark, index, "chunks").collect()
    assert run() == {"files": 3, "new": 3, "changed": 0, "unchanged": 0, "gone": 0, "failed": 1, "retried": 0, "chunks": len(chunks())}
    got = files()
    assert got["bad.pdf"]["error"].startswith("ValueError") and got["bad.pdf"]["quality"]["status"] == "error" and got["a.md"]["quality"]["status"] == "ok"
    assert {(c["title"], c["page_start"]) for c in chunks()} == {("a.md", 3), ("b.txt", None)} and {c["source_id"] for c in chunks()} == {"s 1/х"}
    before = {c["chunk_id"]: c["text"] for c in chunks()}

    # A second run converts the failed file only; another source doesn't touch this one's rows.
    calls = str(tmp_path / "calls")

    def noted(ext, content):
        with open(calls, "a") as f:
            f.write(ext + "\n")
        return readers.to_markdown(ext, content)

    assert run(converter=noted)["unchanged"] == 2 and Path(calls).read_text().split() == [".pdf"]
    assert {c["chunk_id"]: c["text"] for c in chunks()} == before
    ingest.index_source(spark, index, "other", [str(root)], include=["b.*"])
    assert ingest.read_index(spark, index, "files").groupBy("source_id").count().count() == 2 and len(chunks()) == len(before) + 1

    # Changed, gone and cured files.
    (root / "b.txt").write_text(body(3))
    (root / "a.md").unlink()
    cured = body(2)
    did = run(converter=lambda ext, c: "" if ext == ".pdf" else c.decode(), second=lambda ext, c: cured)
    assert (did["files"], did["changed"], did["gone"], did["failed"], did["retried"]) == (2, 1, 1, 0, 1)
    own = ingest.read_index(spark, index, "files").filter("source_id <> 'other'")
    assert {r["title"]: (r["reindex"] or {"status": None})["status"] for r in own.collect()} == {"b.txt": None, "bad.pdf": "resolved"}

    # Vectors: all, then none, then those of changed chunks; an empty vector stays pending.
    embed = lambda f, **k: ingest.embed_source(spark, index, "other", f, "m", **k)
    assert embed(embedding.hashed_vector, native=True) == {"chunks": 1, "embedded": 1, "cached": 0, "pending": 0}
    assert embed(lambda t: pd.Series([[]] * len(t))) == {"chunks": 1, "embedded": 0, "cached": 1, "pending": 0}
    assert ingest.embed_source(spark, index, "other", lambda t: pd.Series([[]] * len(t)), "m2") == {"chunks": 1, "embedded": 0, "cached": 0, "pending": 1}

    # A source that has no files any more, and one that goes.
    for p in root.iterdir():
        p.unlink()
    (root / "c.bin").write_text("x")
    assert run()["files"] == 0 and {c["source_id"] for c in chunks()} == {"other"}
    ingest.remove_source(spark, index, "other")
    assert ingest.read_index(spark, index, "chunks").isEmpty() and not ingest.store(spark, index).version().tables


def test_agent_goes_on(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text(body(2))
    at = iter("12")
    run, rows = service.run_agent(["a", "none"], lambda s: ingest.index_source(spark, str(tmp_path / "i"), s, [str(tmp_path / s)]), lambda: next(at), "r")
    assert run["status"] == "completed" and run["totals"]["new"] == 1 and [r["status"] for r in rows] == ["completed", "failed"]


def plain_scan(pages):
    """One document's pages in order: (stopped at, failed pages)."""
    row = 0
    for p in sorted(pages, key=lambda p: p["page"]):
        if p["cached"]:
            continue
        row = row + 1 if p["error"] else 0
        if row == 3:
            return p["page"]
    return None


def test_scanned_documents(spark):
    rnd = random.Random(4)
    good, poor = body(2), "a1b2 c3d4 e5f6 g7h8"
    rows = []
    for f in range(60):
        for page in range(1, rnd.randint(2, 12)):
            bad = rnd.random() < (0.7 if f % 2 else 0.05)
            cached = not bad and rnd.random() < 0.3
            text = None if bad else rnd.choice([good, poor, ""]) if f % 3 else poor
            rows.append({"file_id": f, "page": page, "text": text, "confidence": None if bad else rnd.choice([None, 10.0, 48.6, 90.0]), "cached": cached, "error": "E" if bad else None})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "file_id int, page int, text string, confidence double, cached boolean, error string").withColumn("total", F.lit(11))
    got = {r["file_id"]: r for r in scans.scanned_documents(df, total="total").collect()}
    assert set(got) == {r["file_id"] for r in rows}
    for f, r in got.items():
        mine = sorted((x for x in rows if x["file_id"] == f), key=lambda x: x["page"])
        stop = plain_scan(mine)
        fine = [x["page"] for x in mine if x["text"] == good and x["confidence"] != 10.0]
        weak = [x["page"] for x in mine if x["text"] in (good, poor) and x["page"] not in fine]
        assert r["recognition"]["ocr_rejected_pages"] == weak and r["recognition"]["ocr_accepted_pages"] == len(fine)
        assert r["recognition"]["ocr_salvaged_pages"] == ([] if fine else weak)
        assert (r["error"] is None) == (stop is None) and (stop is None or r["error"].endswith(f" {stop}"))
        if stop is None:
            expected = [f"## OCR page {p}" for p in (fine or weak)] + (["## OCR status"] if len(mine) < 11 else [])
            assert [x for x in r["markdown"].split("\n") if x.startswith("## ")] == expected
            assert (scans.LOW_QUALITY in r["markdown"]) == (not fine and bool(weak))
    assert scans.scanned_documents(df.limit(0)).isEmpty()


def test_recognize_pages(spark):
    pages = spark.createDataFrame([(1, 1, bytearray(b"ab")), (1, 2, bytearray(b"bad")), (2, 1, bytearray(b""))], "file_id int, page int, image binary")

    def recognizer(raw):
        if raw == b"bad":
            raise OSError("broken")
        return raw.decode(), 80.0

    cache = spark.createDataFrame([(1, 1, "old", 50.0), (9, 1, "x", 1.0)], "file_id int, page int, text string, confidence double")
    look = lambda df: {(r["file_id"], r["page"]): (r["text"], r["cached"], r["error"]) for r in df.collect()}
    assert look(scans.recognize_pages(pages, recognizer, cache)) == {(1, 1): ("old", True, None), (1, 2): (None, False, "OSError: broken"), (2, 1): ("", False, None)}
    assert look(scans.recognize_pages(pages, recognizer, cache, refresh=True))[(1, 1)] == ("ab", False, None)


def test_embedder_batches(spark):
    chunks = spark.createDataFrame([(i, None if i == 5 else f"text {i}") for i in range(150)], "chunk_id int, text string").coalesce(1)

    def embedder(texts):
        assert len(texts) <= 64
        return pd.Series([None if t == "" else [float(len(texts)), 1.0] for t in texts])

    got = embedding.embedded(chunks, embedder, "m").collect()
    assert len(got) == 149 and {r["vector"][0] for r in got} == {64.0, 22.0} and {r["model"] for r in got} == {"m"}
    assert embedding.embedded(chunks.limit(0), embedder, "m").isEmpty()


def test_file_actions_edges(spark):
    schema = "file_id string, mtime_ms long, size long"
    scan = spark.createDataFrame([("a", 1, 1), ("b", 1, None), (None, 1, 1)], schema)
    was = spark.createDataFrame([("b", 1, None), ("c", 1, 1)], schema)
    got = {r["file_id"]: r["action"] for r in maintenance.file_actions(scan, was).collect()}
    assert got == {"a": "new", "b": "unchanged", None: "new", "c": "gone"}
    assert maintenance.file_actions(scan.limit(0), was.limit(0)).isEmpty()


def test_spreadsheet_cells():
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><r><t>Ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        cells = '<c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>45292</v></c><c r="C1" s="2"><v>45292.75</v></c><c r="D1" s="3"><v>7.5</v></c><c r="E1" t="str"><f>A1</f><v>x&#10;y </v></c><c r="F1" t="b"><v>0</v></c><c r="AA1" t="inlineStr"><is><t>z</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1">{cells}</row><row r="2"><c r="A2"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{m}"><sheetData/></worksheet>')
    assert readers.xlsx_rows(out.getvalue()) == [("S", 1, {1: "Rich", 2: "2024-01-01", 3: "2024-01-01", 4: "7.5", 5: "x\ny", 6: "false", 27: "z"})]
    lines = readers.xlsx_markdown(out.getvalue()).split("\n")
    assert lines[0] == "## Лист: S" and lines[2].startswith("| Строка | A | B |") and lines[2].endswith("| Z | AA |") and len(lines) == 5
    assert lines[4].startswith("| 1 | Rich | 2024-01-01 | 2024-01-01 | 7.5 | x<br>y | false |")


def test_tender_tables(spark):
    closed = []
    t = TenderTables(spark.createDataFrame([("1", "n1"), ("2", "n2")], "id string, tender_number string"), spark.createDataFrame([("r", "1")], "record_id string, tender_id string"), lambda: closed.append(1))
    assert t.list_for_audit().count() == 2 and t.list_for_audit(["2"]).first()["tender_number"] == "n2"
    assert t.find_by_id(None).isEmpty() and t.find_by_number(" n1 ").first()["id"] == "1" and t.price_records("1").count() == 1
    t.close()
    assert closed == [1]
