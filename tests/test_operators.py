from __future__ import annotations

import io
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docsift.functions import links, paths, privacy
from docsift.functions.money import compare_money, money, money_text, price_mentions
from docsift.functions.text import fuzzy_score, human_size, match_tokens, noise_report, token_variants, truncate_text
from docsift.operators import audit, jobs, maintenance, matching, paged, quality, recognition
from docsift.sources import matrices, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_redaction(spark):
    r = lambda s: one(spark, privacy.redact(F.lit(s), "/home/me"))
    assert r("Bearer abc.def-1 x") == "Bearer [redacted] x"
    assert r('api_key: "k1", b') == 'apiKey=[redacted]", b' or "k1" not in r('api_key: "k1", b')
    assert r("https://u:p@h/x?token=1&b=2") == "https://[redacted]@h/x?token=[redacted]&b=2"
    assert r("https://docs.google.com/document/d/abcdefgh1/edit at /Home/Me/x") == "https://docs.google.com/document/d/[redacted]/edit at [home]/x"
    assert one(spark, privacy.mask_path(F.lit("/a/b/c.pdf"))).startswith("c.pdf#") and one(spark, privacy.mask_path(F.lit(""))) == ""
    df = spark.sql("select named_struct('token', 't', 'url', 'http://h?key=1', 'list', array('Bearer zz')) as s, '/p/q' as path, 1 as n")
    clean = privacy.sanitize_frame(df, True).first()
    assert clean["s"]["token"] == "[redacted]" and clean["s"]["list"] == ["Bearer [redacted]"] and clean["path"].startswith("q#") and clean["n"] == 1


def test_links(spark):
    t = lambda h: one(spark, links.html_title(F.lit(h)))
    assert t("<title>A &amp; B &#1071; &#x42;</title>") == "A & B Я B"
    assert t("<title>&amp;lt;</title>") == "&lt;"
    assert t("<meta name='x'><meta property=\"og:title\" content=\"Plan - Google Sheets\"><title>z</title>") == "Plan"
    assert t("<meta property='og:title' content='Google Docs'><title>Real</title>") == "Real"
    assert t("<title>Sign in - x</title>") == "" and t("") == ""
    k = lambda u: one(spark, links.dedupe_key(F.lit(u)))
    assert k("https://docs.google.com/spreadsheets/d/ID1/edit#gid=5") == "sheet:id1:5"
    assert k("https://docs.google.com/spreadsheets/d/ID1/edit") == "sheet:id1:"
    assert k("https://docs.google.com/document/d/AA/view") == "doc:aa" and k("https://drive.google.com/open?id=F1") == "drive:f1"
    assert k("https://h.org/A#x") == "url:https://h.org/a" and k("") == "" and k("https://h.org") == "url:https://h.org/"
    assert one(spark, links.drive_kind(F.lit("https://drive.google.com/drive/folders/x1?y"))) == "folder"
    assert one(spark, links.folder_id(F.lit("https://drive.google.com/drive/folders/x1?y"))) == "x1"
    assert one(spark, links.link_kind(F.lit("auto"), F.lit("http://a/КП.pdf"), F.lit(""))) == "kp"
    assert one(spark, links.disposition_name(F.lit("attachment; filename*=UTF-8''a%20b.xlsx"))) == "a b.xlsx"


def test_paths(spark):
    inc = lambda p, ps: one(spark, paths.included(F.lit(p), ps))
    assert inc("a/b/c.PDF", ["**/*.pdf"]) and inc("c.pdf", ["**/*.pdf"]) and not inc("a/c.pdf", ["*.pdf"]) and inc("x", []) and inc("a/Drafts/b", ["drafts"])
    exc = lambda p, ps: one(spark, paths.excluded(F.lit(p), ps))
    assert exc("a/node_modules/b", []) and not exc("a/mynode_modules/b", []) and exc("a\\b?.txt", ["a/b?.txt"])
    assert one(spark, paths.extension(F.lit("a/b.Tar.GZ"))) == ".gz" and one(spark, paths.extension(F.lit("a/.hidden"))) == ""
    ins = lambda r, p: one(spark, paths.inside(F.lit(r), F.lit(p)))
    assert ins("/r", "/r/x") and ins("/r/", "/r") and not ins("/r", "/rx") and not ins("/r", "/r/../x")
    assert one(spark, paths.point_id(F.lit("x")))[14] == "5"


def test_money(spark):
    m = lambda s: one(spark, money_text(F.lit(s)))
    assert m("1 250 000,50 ₽") == "1250000.500000" and m("12,1234567 руб.") == "12.123456" and m("abc") is None and m("1.2.3") is None and m("-5") == "-5.000000"
    c = lambda a, b, p=1.0: one(spark, compare_money(money(F.lit(a)), money(F.lit(b)), p))
    assert c("1250000", "1245000")["match"]
    far = c("1250000", "1200000")
    assert not far["match"] and far["delta"] == Decimal("50000.000000") and far["delta_percent"] == Decimal("4.166666")
    assert c("x", "1")["reason"] == "invalid_input" and c("0", "0")["match"] and not c("1", "0")["match"]


def test_price_mentions(spark):
    got = one(spark, price_mentions(F.lit("Бетон М300\nитого: 1 250 000,00 руб.")))
    assert [(r["amount"], r["pattern"]) for r in got][:1] == [("1250000.00", "labeled_price")]
    assert one(spark, price_mentions(F.lit(None).cast("string"))) == []
    assert [r["amount"] for r in one(spark, price_mentions(F.lit("цена 0")))] == []


def test_noise_and_quality(spark):
    n = one(spark, noise_report(F.lit("слово wоrd аbc tест3 ab1c x1")))
    assert (n["letter_tokens"], n["mixed_script_tokens"], n["alpha_digit_tokens"], n["severe"]) == (6, 3, 1, True)
    docs = spark.createDataFrame([(1, "short"), (2, None), (3, "нормальный текст документа " * 20), (4, "1 2 3 4 5 6 7 8 9 0 " * 10)], "id int, text string")
    q = {r["id"]: r["quality"] for r in quality.with_text_quality(docs).collect()}
    assert q[1]["warnings"] == ["too_little_text", "too_few_words"] and q[1]["score"] == 50 and q[3]["score"] == 100 and q[2]["chars"] == 0
    assert "low_text_density" in q[4]["warnings"]
    v = {r["id"]: r["index_quality"] for r in quality.verify(docs.withColumn("chunks", F.when(F.col("id") == 3, 1).otherwise(0))).collect()}
    assert v[3]["status"] == "ok" and v[1]["status"] == "error" and v[1]["score"] == 0 and "no_chunks" in v[1]["warnings"]
    rec = docs.filter("id = 3").withColumn("chunks", F.lit(1)).withColumn("r", F.expr("named_struct('ocr_limited', true, 'ocr_confidence', 40, 'ocr_empty_pages', array(2))"))
    w = quality.verify(rec, recognition="r").first()["index_quality"]
    assert w["warnings"] == ["ocr_limited", "low_ocr_confidence", "empty_ocr_pages"] and w["score"] == 50 and w["status"] == "warning"


def test_retry(spark):
    q = lambda status, score, *w: F.struct(F.lit(status).alias("status"), F.lit(score).alias("score"), F.array(*map(F.lit, w)).cast("array<string>").alias("warnings"))
    d = one(spark, quality.retry_decision(q("error", 40, "no_chunks", "ocr_limited"), F.lit(False), F.lit(0)))
    assert d["queued"] and d["reasons"] == ["quality_error", "low_quality_score", "no_chunks"]
    assert one(spark, quality.retry_decision(q("ok", 100), F.lit(True), F.lit(0)))["reason"] == "not_needed"
    assert one(spark, quality.retry_decision(q("error", 0), F.lit(False), F.lit(1)))["reason"] == "max_attempts"
    r = one(spark, quality.retry_report(q("error", 20), q("ok", 90), F.lit(False)))
    assert r["status"] == "resolved" and r["improved"]


def test_source_rollup(spark):
    rows = [("s", "ok", 100, 1000, 100, 2), ("s", "warning", 70, 100, 20, 1), ("s", None, None, None, None, 3), ("t", "error", 0, 10, 1, 0)]
    f = spark.createDataFrame(rows, "source_id string, status string, score int, chars int, words int, chunks int")
    got = {r["source_id"]: r for r in quality.source_rollup(f).collect()}
    s = got["s"]
    assert (s["files"], s["ok_files"], s["unchecked_files"], s["score"], s["status"], s["text_coverage"], s["avg_chars"]) == (3, 1, 1, 83, "warning", 100, 550)
    assert got["t"]["status"] == "error" and got["t"]["text_coverage"] == 0
    pages = spark.createDataFrame([("d", i, c, True) for i, c in enumerate([90, 10, 50, 70, 30, 95, 80, 60, 99, 40, 20])], "k string, page int, confidence int, usable boolean")
    assert quality.page_rollup(pages, "k").first()["confidence_p10"] == 20


def test_folders(spark):
    f = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4)], "path string, chunks int")
    assert {r["folder"]: (r["files"], r["total"]) for r in quality.folder_totals(f).collect()} == {"": (3, 7), "a": (2, 3), "a/b": (1, 1)}


SOURCES = [("balchug", "ЖК Балчуг Садовническая 31", "/p/balchug", "contract", ""), ("other", "Проект Тверская", "/p/tver", "contract", ""), ("alia", "ALIA residence", "/p/alia", "contract", "")]


def test_source_match(spark):
    s = spark.createDataFrame(SOURCES, "source_id string, title string, path string, source_type string, linked_contract_id string")
    q = spark.createDataFrame([(1, "какой срок договора по Балчуг Садовническая?"), (2, "условия договора"), (3, "что по Алия")], "question_id int, question string")
    got = {r["question_id"]: r for r in matching.match_sources(q, s).filter("rank = 1").collect()}
    assert got[1]["source_id"] == "balchug" and got[1]["score"] == 13.0 and got[1]["matched_tokens"] == ["балчуг", "садовническая"] and got[1]["confident"]
    assert 2 not in got and got[3]["source_id"] == "alia"
    assert one(spark, match_tokens(F.lit("Что по ЖК Ёлка-2?"))) == ["елка"]
    assert "садовническ" in one(spark, token_variants(F.lit("садовническая"))) and "aliia" not in one(spark, token_variants(F.lit("алия")))
    assert one(spark, fuzzy_score(F.lit("Дом на горе"), F.lit("дом на горе"))) == 1.0 and one(spark, fuzzy_score(F.lit("abc def ghi"), F.lit("def ghi jkl"))) == 0.5


def test_scope_and_owners(spark):
    s = spark.createDataFrame([("c", "contract", "", "/c", []), ("t1", "tender", "c", "/t1", ["/x/y/"]), ("t2", "tender", "gone", "/t2", [])], "source_id string, source_type string, linked_contract_id string, path string, additional_paths array<string>")
    pairs = {(r["source_id"], r["member_id"]) for r in matching.scope_expansion(s).collect()}
    assert pairs == {("c", "c"), ("c", "t1"), ("t1", "t1"), ("t2", "t2")}
    files = spark.createDataFrame([("f1", "c", "/t1/a"), ("f2", "old", "/t1/a"), ("f3", "old", "/x/y/z/b"), ("f4", "old", "/t11/a"), ("f5", None, "/c/q")], "file_id string, source_id string, path string")
    own = {r["file_id"]: (r["owner_id"], r["how"]) for r in matching.owned_files(files, s).collect()}
    assert own == {"f1": ("c", "id"), "f2": ("t1", "path"), "f3": ("t1", "path"), "f5": ("c", "path")}


def test_tender_match(spark):
    s = spark.createDataFrame([("a", "tender", "h1", "", "x", ""), ("b", "tender", "", "k1", "y", ""), ("c", "tender", "", "", "N7. Склад на Лесной", ""), ("d", "tender", "", "", "реконструкция большой школы номер пять", "")], "source_id string, source_type string, hub_tender_id string, linked_contract_id string, title string, object_address string")
    t = spark.createDataFrame([("h1", "", "", "zz", ""), ("2", "k1", "", "", ""), ("3", "", "n7", "склад на лесной", ""), ("4", "", "", "реконструкция большой школы", ""), ("5", "", "", "ничего общего", "")], "tender_id string, linked_contract_id string, tender_number string, title string, object_address string")
    got = {r["tender_id"]: (r["source_id"], r["strategy"], round(r["score"], 2), r["confidence"]) for r in matching.match_tenders(t, s).collect()}
    assert got == {"h1": ("a", "hub_tender_id", 1.0, "exact"), "2": ("b", "linked_contract_id", 0.95, "high"), "3": ("c", "tender_number", 0.92, "high"), "4": ("d", "title_fuzzy", 0.7, "medium"), "5": (None, "unmatched", 0.0, "none")}


def test_audit(spark):
    records = spark.createDataFrame(
        [("r1", "t", "бетон", "q/kp.pdf", "kp.pdf", "1250000", "0", "0", "0"), ("r2", "t", "кирпич", "", "", "5", "0", "0", "0"), ("r3", "u", "песок", "", "", "7", "0", "0", "0"), ("r4", "t", "пусто", "", "", "0", "0", "", "0")],
        "record_id string, tender_id string, position_name string, quote_link string, supplier string, " + ", ".join(f"{f} string" for f in audit.FIELDS),
    )
    chunks = spark.createDataFrame([("t", "c1", "docs/kp.pdf", "", "бетон цена: 1200000 руб.")], "tender_id string, chunk_id string, path string, title string, text string")
    found = audit.findings(records, audit.candidates(chunks)).collect()
    got = {r["record_id"]: r for r in found}
    assert got["r1"]["severity"] == "error" and got["r1"]["delta"] == Decimal("50000.000000") and got["r1"]["confidence"] == 0.9 and got["r1"]["chunk_id"] == "c1"
    assert got["r2"]["severity"] == "warning" and got["r2"]["confidence"] == 0.55
    assert got["r3"]["field"] == "total_commercial_material_cost" and got["r3"]["confidence"] == 0.25 and got["r4"]["field"] == "record"
    f = audit.findings(records, audit.candidates(chunks))
    t = audit.global_totals(f, spark.createDataFrame([("t", False), ("u", True)], "tender_id string, needs_review boolean")).first()
    assert (t["tenders_checked"], t["findings"], t["high"], t["medium"], t["low"], t["needs_review"], t["status"]) == (2, 4, 1, 1, 2, 3, "error")
    status = {r["tender_id"]: r["status"] for r in audit.tender_status(f, spark.createDataFrame([("t",), ("u",), ("v",)], "tender_id string"), F.lit(True), F.lit(True)).collect()}
    assert status == {"t": "error", "u": "needs_review", "v": "ok"}


VOLUME = """# Document: КР1
Path: a.md
> **Stamp:** Code: 12-КР | Stage: П | Object: Дом: один

## Page 1
> **Stamp:** Code: 12-КР1 | Sheet: 3 | Name: План
### BLOCK #1 [IMAGE]: b1
> **Crop:** [c](http://x/c.png)
**[IMAGE]** | Type: План этажа | Axes: 1-2; А-Б | Level: -9,300, -5,700
**Summary:** кратко
Текст листа

## Page 2
### BLOCK #1 [TEXT]: b2
""" + "длинный текст записки " * 60


def test_paged(spark):
    v = spark.createDataFrame([("v", VOLUME), ("w", "no pages"), ("x", None)], "id string, text string")
    p = {r["page"]: r for r in paged.pages(v, "id").collect()}
    assert set(p) == {1, 2} and p[1]["document_code"] == "12-КР1" and p[2]["document_code"] == "12-КР" and p[1]["levels"] == "-9,300|-5,700"
    assert (p[1]["page_kind"], p[2]["page_kind"], p[1]["sheet_type"], p[1]["crop_url"], p[1]["axes"], p[1]["summary"]) == ("drawing", "text", "plan", "http://x/c.png", "1-2|А-Б", "кратко")
    c = paged.page_chunks(paged.pages(v, "id"), max_chars=400)
    two = c.filter("page = 2").orderBy("chunk_ord").collect()
    assert len(two) > 1 and all(len(r["text"]) <= 400 and r["text"].startswith("12-КР | лист b2\n") for r in two)
    index = spark.createDataFrame([("v", 1)], "id string, page int")
    assert paged.on_index(c, index, ("id", "page")).select("page").distinct().count() == 1
    crops = spark.createDataFrame([("b1", "abcdef"), ("b2", None)], "block_id string, crop string")
    first = paged.with_crops(c, crops, ["id", "page"], budget=4).filter("page = 1 and chunk_ord = 0").first()
    assert first["has_crop_text"] and first["text"].endswith("\nabcd")
    m = one(spark, paged.fields(F.lit("Code: a:b | bare | Stage : П | code: c")))
    assert m == {"code": "c", "stage": "П"}
    letters = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 702)], "n int").select(paged.column_letters(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in letters] == ["A", "Z", "AA", "AZ", "ZZ"]


def test_recognition(spark):
    d = spark.createDataFrame([(1, "Коммерческое предложение, цена 5 руб"), (2, "Локальная смета"), (3, "техническое задание"), (4, "итого 5 ₽"), (5, "ничего"), (6, None)], "id int, text string")
    got = {r["id"]: r["recognition"] for r in recognition.recognize(d, F.lit("папка")).collect()}
    assert [got[i]["document_type"] for i in range(1, 7)] == ["commercial_proposal", "cost_estimate", "tender_document", "price_table", "tender_file", "tender_file"]
    assert got[1]["has_price_signals"] and got[1]["signal_score"] == 75 and got[5]["signal_score"] == 10
    assert recognition.recognize(d, F.lit("x"), is_tender=F.lit(False)).first()["recognition"]["document_type"] == ""


def test_maintenance(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in maintenance.upsert(cur, new, "id", "at").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    kept, gone = maintenance.prune_unseen(cur, new, "id")
    assert [r["id"] for r in kept.collect()] == [2] and [r["id"] for r in gone.collect()] == [1]
    assert {r["v"] for r in maintenance.replace_partition(cur, new, "id").collect()} == {"a", "c", "d"}
    assert maintenance.vector_provider("auto", True, False) == ("json", True) and maintenance.vector_provider("bad", True, True) == ("qdrant", True) and maintenance.vector_provider("qdrant", False, True) == ("json", False)
    assert maintenance.newest(cur, "at", 1, "id").first()["id"] == 1


def test_health(spark):
    h = lambda status, phase, seconds, alive: one(spark, jobs.health(F.lit(status), F.lit(phase), F.timestamp_seconds(F.lit(1000)), F.timestamp_seconds(F.lit(1000 + seconds)), F.lit(alive)))
    assert h("running", "", 10, True)["health"] == "active" and h("running", "", 121, True)["code"] == "no_recent_progress" and h("running", "", 1, False)["health"] == "interrupted"
    assert h("failed", "interrupted", 1, True)["code"] == "process_missing" and h("failed", "x", 1, True)["health"] == "failed" and h("", "", 1, True)["code"] == "not_indexed"


def test_small(spark):
    assert one(spark, truncate_text(F.lit("abcd"), 2))["text"] == "ab…" and not one(spark, truncate_text(F.lit("abcd"), 0))["truncated"]
    assert one(spark, human_size(F.lit(1536))) == "1.5 KB"
    e = one(spark, sinks.parsed_events(F.concat(sinks.event_text(F.lit("a"), F.lit("x\ny")), F.lit("data: z\n\n"))))
    assert [(r["event"], r["data"]) for r in e] == [("a", "x\ny"), ("message", "z")]


def test_sources(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes("Привет".encode())
    (root / "sub" / "b.md").write_bytes("Договор".encode("cp1251"))
    (root / "~$x.docx").write_bytes(b"x")
    (root / "c.bin").write_bytes(b"\x00")
    scan = readers.classified(readers.scan_folders(spark, [str(root)]))
    assert {r["relative_path"]: r["reason"] for r in scan.collect()} == {"a.txt": "eligible", "sub/b.md": "eligible", "~$x.docx": "temporary", "c.bin": "unsupported"}
    texts = {r["relative_path"]: r["text"] for r in readers.read_texts(spark, [str(root)]).collect()}
    assert texts == {"a.txt": "Привет", "sub/b.md": "Договор"}
    (tmp_path / "i.csv").write_text('a,b\n"x, ""y""\nz",1\n,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "i.csv")).collect()] == [('x, "y"\nz', "1")]
    assert readers.read_json_state(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "twice.json").write_text('[{"a": 1}]')
    with pytest.raises(AnalysisException):  # another fault than an absent file is told
        readers.read_json_state(spark, str(tmp_path / "twice.json"), "a int, a string").count()
    assert readers.read_yaml_list("sources:\n  - id: a\n    title: 'T x'\n  - id: b\nother: 1\n", "sources") == [{"id": "a", "title": "T x"}, {"id": "b"}]


def xlsx() -> bytes:
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>a|b</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>')
    return out.getvalue()


def test_convert(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p></w:body></w:document>')
    files = spark.createDataFrame([(1, ".docx", bytearray(docx.getvalue())), (2, ".xlsx", bytearray(xlsx())), (3, ".pdf", bytearray(b"x")), (4, ".docx", bytearray(b"bad"))], "file_id int, extension string, content binary")
    got = {r["file_id"]: r for r in readers.convert(files, readers.to_markdown).collect()}
    assert got[1]["markdown"] == "Hi" and got[2]["markdown"] == "## Лист: S1\n\n| Строка | A | B | C |\n| --- | --- | --- | --- |\n| 2 | a\\|b |  | 5 |"
    assert got[3]["error"].startswith("ValueError") and got[4]["error"] and got[4]["markdown"] is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    part = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, source_id string")
    sinks.replace_partitions(rows, part)
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "v int, source_id string"), part)
    assert {(r["v"], r["source_id"]) for r in spark.read.parquet(part).collect()} == {(9, "a"), (2, "b")}
    raw = sinks.npy_bytes([[1.0, 2.0], [0.5]], 3)
    assert np.load(io.BytesIO(raw)).tolist() == [[1, 2, 0], [0.5, 0, 0]]
    (tmp_path / "v.npy").write_bytes(raw)
    (tmp_path / "c.jsonl").write_text('{"row": 0, "text_hash": "h0"}\n{"row": 1, "text_hash": "h1"}\n')
    back = {r["text_hash"]: r["vector"] for r in readers.read_vectors(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "v.npy"), 2).collect()}
    assert back == {"h0": [1.0, 2.0], "h1": [0.5, 0.0]}
    text = sinks.with_front_matter(F.lit("body"), a=F.lit(1), b=F.lit('x "y"'))
    assert one(spark, sinks.front_matter(text)) == {"a": "1", "b": '"x \\"y\\""'} and one(spark, sinks.without_front_matter(text)) == "body"
    chunks = spark.createDataFrame([(0, "f", 1, True), (1, "f", 2, False)], "row long, file_path string, page int, has_crop_text boolean")
    vec = spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0, 4.0])], "row long, vector array<float>")
    m = sinks.export_index(chunks, vec, str(tmp_path / "x"), 2)
    assert m == {"version": 1, "dimensions": 2, "chunks": 2, "documents": 1, "pages": 2, "cropped": 1}
    assert {r["row"]: r["vector"] for r in matrices.read_matrix(spark, str(tmp_path / "x/vectors.f16.npy")).collect()} == {0: [1.0, 0.0], 1: [2.0, 3.0]}


def test_link_precedence(spark):
    folders = spark.createDataFrame([(1, "f", "a", "", ""), (2, "f", "a", "", "c9"), (3, "f", "a", "", ""), (4, "f", "z", "", ""), (5, "f", "a", "", "c9"), (6, "f", "a", "", "")], "tender_id int, folder string, category string, path string, linked_contract_id string")
    pair = lambda *rows: spark.createDataFrame(list(rows), "tender_id int, contract_id string")
    contracts = spark.createDataFrame([("c1",), ("c2",)], "source_id string")
    got = {r["tender_id"]: (r["contract_id"], r["link_source"]) for r in matching.resolve_links(folders, pair((2, "c1"), (3, "no"), (5, "no")), contracts, pair((1, "c2")), pair((1, "c1"), (6, "c1"), (4, "c1")), ["a"]).collect()}
    assert got == {1: ("c2", "selected"), 2: ("c1", "manual"), 3: ("", "manual-missing"), 4: ("", "none"), 5: ("c9", "existing"), 6: ("c1", "auto")}


@pytest.mark.parametrize("rows,length", [([1, 1, 1], 3), ([1, 0, 1], 1)])
def test_failure_runs(spark, rows, length):
    e = spark.createDataFrame([("k", i, v == 1) for i, v in enumerate(rows)], "k string, i int, bad boolean")
    got = jobs.failure_runs(e, "k", ["i"], F.col("bad")).collect()
    assert max(r["length"] for r in got) == length and any(r["aborted"] for r in got) == (length >= 3)
