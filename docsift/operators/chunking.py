"""Cutting texts into chunks, with what headings say about pages, sheets, rows and sections.

Paragraphs (between blank lines) are packed greedily up to `max_chars`; a longer paragraph is cut into windows
that overlap. Positions carry over: a chunk reports the range of pages and rows that its paragraphs touch, the
state it starts from included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import normalize_text, tokens

MAX_CHARS, OVERLAP = 1800, 220
_HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"


def windows(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Slices of max_chars at steps of max_chars - overlap; one slice if it fits."""
    step = max_chars - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(max_chars))))


def pack(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """The chunks of a normalised text, as an array of strings."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def closed(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit("\n\n"), p)).otherwise(p)
        fits, short = F.length(joined) <= max_chars, F.length(p) <= max_chars
        out = F.when(fits, acc["out"]).when(short, closed(acc)).otherwise(F.concat(closed(acc), windows(p, max_chars, overlap)))
        return F.struct(out.alias("out"), F.when(fits, joined).when(short, p).otherwise(F.lit("")).alias("cur"))

    packed = F.aggregate(F.split(text, r"\n{2,}"), start, step, closed)
    return F.filter(F.transform(packed, normalize_text), lambda c: c != "")


def chunk_frame(docs: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: the other columns, chunk_index from 0, and chunk_text. Empty and null texts have none."""
    body = docs.withColumn("_chunks", pack(normalize_text(F.col(text)), max_chars, overlap))
    return body.select(*(c for c in docs.columns if c != text), F.posexplode("_chunks").alias("chunk_index", "chunk_text"))


def window_frame(docs: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """As chunk_frame for texts without blank lines, where packing has nothing to do."""
    body = docs.withColumn("_chunks", F.filter(F.transform(windows(normalize_text(F.col(text)), max_chars, overlap), normalize_text), lambda c: c != ""))
    return body.select(*(c for c in docs.columns if c != text), F.posexplode("_chunks").alias("chunk_index", "chunk_text"))


def heading_facts(line: Column) -> Column:
    """What one line says: page, sheet, section, row."""
    title = F.trim(F.regexp_extract(line, _HEADING, 1))
    page = F.regexp_extract(title, r"(?i)^(?:OCR\s+)?page\s+(\d+)$", 1).try_cast("int")
    sheet = F.nullif(F.trim(F.regexp_extract(title, r"(?iu)^(?:лист|sheet)\s*:\s*(.+)$", 1)), F.lit(""))
    section = F.when((title != "") & page.isNull() & sheet.isNull(), title)
    row = F.regexp_extract(line, r"^\|\s*(\d+)\s*\|", 1).try_cast("int")
    return F.struct(page.alias("page"), sheet.alias("sheet"), section.alias("section"), row.alias("row"))


def chunk_with_places(docs: DataFrame, key: str, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_text, page_start, page_end, sheet_name, row_start, row_end, section_title).

    Each chunk's own lines give its facts; what precedes comes from windows over the document's chunks. The range
    of pages starts with the page that the chunk begins on."""
    return placed(chunk_frame(docs.select(key, text), text, max_chars, overlap), key)


def placed(chunks: DataFrame, key: str) -> DataFrame:
    """Add those facts to chunks (key, chunk_index, chunk_text)."""
    facts = F.transform(F.split("chunk_text", "\n"), heading_facts)
    of = lambda name: F.filter(F.transform("_facts", lambda f: f[name]), lambda x: x.isNotNull())
    df = chunks.withColumn("_facts", facts).withColumns({f"_{n}": of(n) for n in ("page", "sheet", "section", "row")})
    before = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.when(F.size(c) > 0, F.element_at(c, -1))
    earlier = {f"_was_{n}": F.last(last(f"_{n}"), ignorenulls=True).over(before) for n in ("page", "sheet", "section")}
    df = df.withColumns(earlier)
    return df.select(
        *chunks.columns,
        F.least("_was_page", F.array_min("_page")).alias("page_start"),
        F.greatest("_was_page", F.array_max("_page")).alias("page_end"),
        F.coalesce(last("_sheet"), "_was_sheet").alias("sheet_name"),
        F.array_min("_row").alias("row_start"),
        F.array_max("_row").alias("row_end"),
        F.coalesce(last("_section"), "_was_section").alias("section_title"),
    )


def with_terms(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    return chunks.withColumn("terms", tokens(F.col(text)))
