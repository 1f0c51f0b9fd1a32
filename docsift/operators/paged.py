"""Paged documents: volumes in Markdown with stamps, blocks, crops and attributes, one chunk per page and part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PAGE_CHARS, CROP_BUDGET = 4000, 3000
#: Words of a sheet's type and their codes.
SHEET_TYPES = (
    ("план", "plan"), ("разрез", "section"), ("фасад", "elevation"), ("узел", "detail"), ("схема", "scheme"),
    ("спецификац", "specification"), ("ведомост", "schedule"), ("экспликац", "explication"), ("общих данных", "general"),
    ("общие данные", "general"), ("пояснительная записка", "note"), ("таблица", "table"), ("текст", "text"),
)
_STAMP, _ATTRIBUTE, _BLOCK = r"(?m)^>?[ ]*\*\*Stamp:\*\*\s*(.+?)\s*$", r"(?m)^\*\*\[[A-Z]+\]\*\*\s*\|\s*(.+?)\s*$", r"(?m)^###\s+BLOCK\s+#\d+\s+\[([A-Z]+)\]:\s*\S+\s*$"
_BLOCK_ID, _CROP, _SUMMARY = r"(?m)^###\s+BLOCK\s+#\d+\s+\[[A-Z]+\]:\s*(\S+)\s*$", r"(?m)^>\s*\*\*Crop:\*\*\s*\[[^\]]*\]\((\S+?)\)", r"(?m)^\*\*Summary:\*\*\s*(.+?)\s*$"


def fields(line: Column) -> Column:
    """``Code: X | Stage: Y`` as a map with lower-case keys; a value may hold colons, the last of equal keys counts."""
    parts = F.filter(F.split(F.coalesce(line, F.lit("")), r"\|"), lambda p: F.contains(p, F.lit(":")))
    rows = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("v")))
    keys = F.transform(rows, lambda r: r["k"])
    last = F.filter(rows, lambda r, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), r["k"]))
    return F.map_from_entries(last)


def sheet_codes(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.array_join(F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(c)) for w, c in SHEET_TYPES)))), "|")


def listed(values: Column, limit: int) -> Column:
    """Distinct parts of lists, at semicolons and at commas that no digit follows, joined by bars."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, r"\s*;\s*|\s*,(?!\d)\s*")))
    return F.array_join(F.slice(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")), 1, limit), "|")


def page_kind(types: Column) -> Column:
    image = F.array_contains(types, "image")
    return F.when(image & (F.size(F.array_distinct(types)) == 1), "drawing").when(image, "mixed").when(F.size(types) > 0, "text").otherwise("")


def is_paged(text: Column) -> Column:
    return text.rlike(r"(?m)^#\s+Document:\s*\S") & text.rlike(r"(?m)^##\s+Page\s+\d+\s*$")


def _all(body: Column, pattern: str) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0)), F.lit(""))


def pages(volumes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per page with its facts and payload. Volumes without pages have none."""
    parts = F.split(F.col(text), r"(?m)^##\s+Page\s+(?=\d+\s*$)", -1)
    df = volumes.select(key, F.get(parts, F.lit(0)).alias("_head"), F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).alias("ord", "_part"))
    df = df.withColumn("page", F.regexp_extract("_part", r"^(\d+)", 1).cast("int")).withColumn("_body", F.regexp_replace("_part", r"^\d+[ \t]*", ""))
    df = df.withColumns({"_stamps": F.transform(_all(F.col("_body"), _STAMP), fields), "_attrs": F.transform(_all(F.col("_body"), _ATTRIBUTE), fields), "_head_stamp": fields(F.regexp_extract("_head", _STAMP, 1)), "block_ids": _all(F.col("_body"), _BLOCK_ID), "_types": F.transform(_all(F.col("_body"), _BLOCK), lambda t: F.lower(t))})
    stamp = lambda n: _first(F.transform("_stamps", lambda s: F.try_element_at(s, F.lit(n))))
    attr = lambda n: F.transform("_attrs", lambda s: F.coalesce(F.try_element_at(s, F.lit(n)), F.lit("")))
    head = lambda n: F.coalesce(F.try_element_at("_head_stamp", F.lit(n)), F.lit(""))
    payload = F.filter(F.split("_body", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^(> |### |\*\*Stamp:|\*\*\[)"))
    own = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_code", stamp("code"))
    first_code = F.first(F.nullif("_code", F.lit("")), ignorenulls=True).over(own)
    return df.select(
        key,
        "ord",
        "page",
        F.coalesce(F.nullif("_code", F.lit("")), F.nullif(head("code"), F.lit("")), first_code, F.lit("")).alias("document_code"),
        stamp("stage").alias("stage"),
        stamp("sheet").alias("sheet"),
        stamp("name").alias("title"),
        stamp("revisions").alias("revision"),
        sheet_codes(F.array_join(attr("type"), " ")).alias("sheet_type"),
        listed(attr("axes"), 6).alias("axes"),
        listed(attr("level"), 6).alias("levels"),
        listed(attr("zone"), 4).alias("zone"),
        "block_ids",
        page_kind(F.col("_types")).alias("page_kind"),
        F.coalesce(F.get(_all(F.col("_body"), _CROP), F.lit(0)), F.lit("")).alias("crop_url"),
        F.substr(F.regexp_extract("_body", _SUMMARY, 1), F.lit(1), F.lit(400)).alias("summary"),
        F.array_join(payload, "\n").alias("text"),
    )


def header(discipline: Column) -> Column:
    """What a page is, in front of each of its parts."""
    sheet = F.coalesce(F.nullif("sheet", F.lit("")), F.get("block_ids", F.lit(0)), F.lit(""))
    said = lambda word, c: F.when(c != "", F.concat(F.lit(f"{word} "), c)).otherwise("")
    parts = F.array(discipline, F.col("document_code"), said("лист", sheet), F.col("title"), F.col("sheet_type"), said("отметки", F.col("levels")), said("оси", F.col("axes")), said("зона", F.col("zone")), F.col("summary"))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " | ")


def page_chunks(paged: DataFrame, max_chars: int = PAGE_CHARS, discipline: Column | None = None) -> DataFrame:
    """One row per part of a page; each part starts with the header, and both fit max_chars (a body has 200 at least)."""
    df = paged.withColumn("_h", header(F.lit("") if discipline is None else discipline)).withColumnRenamed("text", "_body")
    budget = F.greatest(F.lit(200), max_chars - F.length("_h") - 1)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("_body") / budget).cast("int") - 1, F.lit(0))), lambda i: i * budget)
    parts = F.transform(starts, lambda s: F.substr("_body", s + 1, budget))
    df = df.select("*", F.posexplode(parts).alias("chunk_ord", "_p"))
    return df.withColumn("text", F.when(F.col("_p") != "", F.concat_ws("\n", "_h", "_p")).otherwise(F.col("_h"))).drop("_h", "_body", "_p")


def on_index(chunks: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("file_path", "page")) -> DataFrame:
    """Chunks of pages that the sheet index lists, with its row; the index decides what belongs."""
    return chunks.join(index, list(keys), "inner")


def with_crops(chunks: DataFrame, crops: DataFrame, key: list[str], budget: int = CROP_BUDGET) -> DataFrame:
    """Add to the first part of each page the text of its blocks' crops, in order, budget characters in all.

    crops: block_id, crop. Adds has_crop_text and text_hash. Crops are wide and their size is guessed too low from the
    plan, so they are merged with the pages, never broadcast, and cut to the budget before they travel."""
    ids = chunks.filter("chunk_ord = 0").select(*key, F.posexplode("block_ids").alias("_o", "block_id"))
    cut_crops = crops.filter("crop is not null and crop <> ''").withColumn("crop", F.substr("crop", F.lit(1), F.lit(budget)))
    rows = ids.join(cut_crops.hint("merge"), "block_id")
    before = F.coalesce(F.sum(F.length("crop")).over(Window.partitionBy(*key).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("_before", before).filter(F.col("_before") < budget).withColumn("_c", F.substr("crop", F.lit(1), (budget - F.col("_before")).cast("int")))
    joined = cut.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_c"))), lambda r: r["_c"]), "\n").alias("_crop"))
    df = chunks.join(joined.hint("merge"), key, "left").withColumn("_crop", F.when(F.col("chunk_ord") == 0, F.col("_crop")))
    df = df.withColumn("has_crop_text", F.col("_crop").isNotNull()).withColumn("text", F.when(F.col("has_crop_text"), F.concat_ws("\n", "text", "_crop")).otherwise(F.col("text"))).drop("_crop")
    return df.withColumn("text_hash", F.sha2("text", 256))


def column_letters(n: Column) -> Column:
    """A for 1, Z for 26, AA for 27, up to ZZ."""
    letter = lambda i: F.char(65 + i.cast("int"))
    return F.when(n <= 26, letter(n - 1)).otherwise(F.concat(letter(F.floor((n - 27) / 26)), letter((n - 1) % 26)))


def markdown_row(cells: Column) -> Column:
    clean = F.transform(cells, lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def csv_markdown(rows: DataFrame, key: str, order: str, cells: str, max_columns: int = 80) -> DataFrame:
    """One Markdown table per key: numbered rows under lettered columns; rows without content are left out.

    A sheet's rows meet in one group, as the sheet is one text."""
    kept = rows.withColumn("_c", F.slice(cells, 1, max_columns)).filter(F.exists("_c", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    sheet = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_c").alias("c")))).alias("_r"), F.max(F.size("_c")).alias("_n"))
    pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(""), max_columns)), 1, F.col("_n"))
    letters = F.transform(F.sequence(F.lit(1), F.col("_n")), column_letters)
    head = F.array(markdown_row(F.concat(F.array(F.lit("Row")), letters)), F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_n") + 1), " | "), F.lit(" |")))
    body = F.transform("_r", lambda r: markdown_row(F.concat(F.array(r["o"].cast("string")), pad(r["c"]))))
    return sheet.select(key, F.array_join(F.concat(head, body), "\n").alias("markdown"))


