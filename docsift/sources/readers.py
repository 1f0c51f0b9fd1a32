"""Readers: folder scans, texts with a fallback encoding, CSV, JSON and JSON lines, JDBC, office files, half-precision vectors."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docsift.functions.paths import base_name, extension, file_class, file_id
from docsift.sources.matrices import read_matrix

SCAN = "path string, modificationTime timestamp, length long"
MAX_COLUMNS, MAX_CELL = 80, 2000
#: Characters of converted texts that a task gathers before it hands them on.
PIECE = 1 << 20


def scan_folders(spark: SparkSession, roots: list[str], content: bool = False, since_ms: int | None = None) -> DataFrame:
    """Files below the roots, recursively: path, relative_path, root, mtime_ms, size[, content].

    With more than one root, relative paths start with the root's name in brackets. since_ms: older files are left out
    by the listing, their contents unread. Spark lists neither empty files nor
    those whose names start with a dot or an underscore."""
    out = None
    roots = list(dict.fromkeys(r.rstrip("/") for r in roots))
    for root in roots:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        if since_ms is not None:
            df = df.filter(F.col("modificationTime") >= F.timestamp_millis(F.lit(since_ms)))
        label = f"[{root.rsplit('/', 1)[-1]}]/" if len(roots) > 1 else ""
        tail = F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1)
        columns = ["path", F.concat(F.lit(label), tail).alias("relative_path"), F.lit(root).alias("root"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")]
        df = df.select(*columns, *(["content"] if content else []))
        out = df if out is None else out.unionByName(df)
    return out


def classified(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Add extension and reason: temporary, excluded, unsupported or eligible."""
    return files.withColumns({"extension": extension(F.col("relative_path")), "reason": file_class(F.col("relative_path"), include or [], exclude or [])})


def scan_report(files: DataFrame) -> DataFrame:
    """Files by reason, and unsupported ones by extension."""
    return files.groupBy("reason", F.when(F.col("reason") == "unsupported", F.col("extension")).alias("extension")).count()


def with_ids(files: DataFrame, source_id: Column) -> DataFrame:
    return files.withColumn("file_id", file_id(source_id, F.col("path"))).withColumn("title", base_name(F.col("path")))


@F.pandas_udf(StringType())
def _cp1251(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else b.decode("cp1251", "replace"))


def decoded(content: Column) -> Column:
    """UTF-8, or Windows-1251 where that gives replacement characters; only those rows go through Python."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")).otherwise(_cp1251(F.when(~valid, content)))


def read_texts(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Text files of the roots, decoded."""
    files = classified(scan_folders(spark, roots, content=True)).filter(F.col("reason") == "eligible")
    return files.filter(F.col("extension").isin(".txt", ".md", ".markdown", ".csv", ".log")).withColumn("text", decoded(F.col("content"))).drop("content")


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Quoted fields may hold commas, quotes and line breaks; rows without content are dropped."""
    df = spark.read.csv(path, header=header, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.dropna("all")


def read_json_state(spark: SparkSession, path: str, schema: str, fallback: bool = True) -> DataFrame:
    """A JSON array or object of the given schema; an absent file gives no rows if fallback."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if not fallback or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def find_first(chunks: DataFrame, condition: Column) -> DataFrame:
    """A row that meets the condition; the scan stops at the first that it finds."""
    return chunks.filter(condition).limit(1)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, **options).option("dbtable", f"({query}) q").load()


def read_vectors(spark: SparkSession, lines: str, half: str, dimensions: int, schema: str = "row long, text_hash string") -> DataFrame:
    """Rows of a JSON-lines file with their vectors from a half-precision .npy file of as many rows, read in ranges."""
    return read_jsonl(spark, lines, schema).join(read_matrix(spark, half, dimensions), "row")


def convert(files: DataFrame, converter: Callable[[str, bytes], str], key: str = "file_id") -> DataFrame:
    """(key, markdown, error): a converter applied to each file; its failure is a row with the error.

    A task holds one Arrow batch, one file's bytes and at most PIECE characters of texts beyond the last one."""

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(key, "extension", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(0), ("markdown", pa.string()), ("error", pa.string())])
            at, out, size = 0, [], 0
            for i in range(b.num_rows):
                markdown = error = None
                try:
                    markdown = converter(b.column(1)[i].as_py(), bytes(b.column(2)[i].as_py()))
                    size += len(markdown or "")
                except Exception as e:  # the row says what went wrong
                    error = f"{type(e).__name__}: {e}"[:500]
                out.append((markdown, error))
                if size >= PIECE or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(out)), *(pa.array(c, pa.string()) for c in zip(*out))], schema=schema)
                    at, out, size = i + 1, [], 0

    return rows.mapInArrow(run, f"{key} {kind}, markdown string, error string")


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, from its XML."""
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


#: Built-in number formats that show dates or times.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


def _cell_text(value: str) -> str:
    """A cell's lines without blanks at their ends, at most one empty line in a row."""
    import re

    lines = re.sub(r"[ \t]+\n", "\n", value.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def _shows_date(code: str) -> bool:
    """Whether a number format has a part of a date or time outside of quotes, brackets and escapes."""
    import re

    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.split(";")[0].lower())))


def xlsx_rows(content: bytes) -> list[tuple[str, int, dict[int, str]]]:
    """(sheet, row, {column: text}) of an XLSX file, from its XML; rows and cells without text are left out.

    Rich text is joined, without its readings; of a formula its stored result counts; dates are shown as days; a cell with
    a link has its own text. Texts are cut to MAX_CELL."""
    import datetime
    import re
    import zipfile
    from xml.etree import ElementTree

    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def rich(item) -> str:
        return "".join(t.text or "" for t in [*item.findall(f"{m}t"), *item.findall(f"{m}r/{m}t")])

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        strings, styles, book = part("xl/sharedStrings.xml"), part("xl/styles.xml"), ElementTree.fromstring(z.read("xl/workbook.xml"))
        shared = [] if strings is None else [rich(si) for si in strings.iter(f"{m}si")]
        own = {} if styles is None else {n.get("numFmtId"): _shows_date(n.get("formatCode", "")) for n in styles.iter(f"{m}numFmt")}
        cell_formats = None if styles is None else styles.find(f"{m}cellXfs")
        dated = [] if cell_formats is None else [own.get(x.get("numFmtId"), int(x.get("numFmtId", "0")) in DATE_FORMATS) for x in cell_formats]
        properties = book.find(f"{m}workbookPr")
        since_1904 = properties is not None and properties.get("date1904") in ("1", "true")

        def text_of(c) -> str:
            kind, v = c.get("t", "n"), c.find(f"{m}v")
            if kind == "inlineStr":
                held = c.find(f"{m}is")
                return "" if held is None else rich(held)
            raw = "" if v is None else v.text or ""
            if not raw:
                return ""
            if kind == "s":
                return shared[int(raw)]
            if kind == "b":
                return "true" if raw == "1" else "false"
            if kind == "d":
                return raw[:10]
            style = int(c.get("s", "0"))
            if kind == "n" and style < len(dated) and dated[style]:
                days = float(raw)
                # Day 60 of the 1900 calendar never was, so that days before it start one later.
                start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30 if days >= 60 else 31)
                try:
                    return (start + datetime.timedelta(days=days, milliseconds=0.5)).date().isoformat()
                except OverflowError:
                    return raw
            return raw

        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in book.iter(f"{m}sheet"):
            target = targets[sheet.get(rel)].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{m}row"):
                cells: dict[int, str] = {}
                at = 0
                for c in row.iter(f"{m}c"):
                    named = re.match("[A-Z]+", c.get("r", ""))
                    at = at + 1 if named is None else 0
                    for letter in named.group() if named else "":
                        at = at * 26 + ord(letter) - 64
                    text = _cell_text(text_of(c))[:MAX_CELL]
                    if text:
                        cells[at] = text
                if cells:
                    out.append((sheet.get("name", ""), int(row.get("r", "0")), cells))
    return out


def _column_name(at: int) -> str:
    name = ""
    while at > 0:
        at, letter = divmod(at - 1, 26)
        name = chr(65 + letter) + name
    return name


def xlsx_markdown(content: bytes) -> str:
    """Each sheet under its heading as a table of numbered rows, with the letters of its columns above them."""
    sheets: dict[str, list[tuple[int, dict[int, str]]]] = {}
    for sheet, number, cells in xlsx_rows(content):
        sheets.setdefault(sheet, []).append((number, cells))
    out = []
    for sheet, rows in sheets.items():
        columns = range(1, min(max(max(c) for _, c in rows), MAX_COLUMNS) + 1)
        shown = lambda values: "| " + " | ".join(values) + " |"
        lines = [shown(["Строка", *map(_column_name, columns)]), shown(["---"] * (len(columns) + 1))]
        lines += [shown([str(n), *(c.get(i, "").replace("|", "\\|").replace("\n", "<br>") for i in columns)]) for n, c in rows]
        out.append(f"## Лист: {sheet}\n\n" + "\n".join(lines))
    return "\n\n".join(out).strip()


def to_markdown(ext: str, content: bytes) -> str:
    """A file's text by its extension; others need a converter of the caller's."""
    if ext == ".docx":
        return docx_text(content)
    if ext in (".xlsx", ".xlsm"):
        return xlsx_markdown(content)
    if ext in (".txt", ".md", ".markdown", ".csv", ".log"):
        try:
            return content.decode("utf-8")
        except UnicodeDecodeError:
            return content.decode("cp1251", "replace")
    raise ValueError(f"no converter for {ext}")


def read_yaml_list(text: str, key: str) -> list[dict[str, str]]:
    """The flat records under a key of a simple YAML text: two levels of indentation, scalars only."""
    out: list[dict[str, str]] = []
    inside = False
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace() and not line.startswith("-"):
            inside = line.split(":")[0].strip() == key
            continue
        if inside:
            body = line.strip()
            if body.startswith("- "):
                out.append({})
                body = body[2:]
            name, _, value = body.partition(":")
            if out and value.strip():
                out[-1][name.strip()] = value.strip().strip("\"'")
    return out
