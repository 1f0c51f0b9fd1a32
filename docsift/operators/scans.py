"""Recognised pages: only pages that the cache lacks go to the recogniser; a document is put together from its pages.

Pages are rows, so the pages of one document are recognised in parallel, wherever they lie; what a sequential loop would
decide on the way (stop after several failures in a row) is decided afterwards from the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import normalize_text
from docsift.operators.quality import usable_page, with_text_quality

#: Failures in a row that end a document, and the note above pages that the gate refused.
FAILURES, LOW_QUALITY = 3, "_Низкое качество распознавания._"


def recognize_pages(pages: DataFrame, recognizer: Callable[[bytes], tuple[str, float]], cache: DataFrame | None = None, key: str = "file_id", refresh: bool = False) -> DataFrame:
    """(key, page, text, confidence, cached, error) of each page (key, page, image).

    cache: key, page, text, confidence of pages recognised before; with refresh it isn't used. A recogniser that raises
    leaves a row with the error. Null confidences stay null."""
    kind = pages.schema[key].dataType.simpleString()
    todo, known = pages, None
    if cache is not None and not refresh:
        have = cache.filter("text is not null").select(key, "page", "text", "confidence")
        known = have.join(pages.select(key, "page").distinct(), [key, "page"], "left_semi").withColumns({"cached": F.lit(True), "error": F.lit(None).cast("string")})
        todo = pages.join(have.select(key, "page"), [key, "page"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, page, image in zip(f[key], f["page"], f["image"]):
                try:
                    text, confidence = recognizer(bytes(image))
                    rows.append((k, page, text or "", confidence, False, None))
                except Exception as e:  # the row says what went wrong
                    rows.append((k, page, None, None, False, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[key, "page", "text", "confidence", "cached", "error"])

    fresh = todo.select(key, "page", "image").mapInPandas(run, f"{key} {kind}, page int, text string, confidence double, cached boolean, error string")
    return fresh if known is None else fresh.unionByName(known.withColumn("page", F.col("page").cast("int")))


def failed_runs(pages: DataFrame, key: str = "file_id", most: int = FAILURES) -> DataFrame:
    """(key, page): the page at which a document is given up, the last of `most` failures in a row. Pages from the
    cache neither count nor end a run."""
    tried = pages.filter(~F.col("cached"))
    order = Window.partitionBy(key).orderBy("page")
    fails = F.sum(F.col("error").isNotNull().cast("int")).over(order.rowsBetween(1 - most, 0))
    return tried.withColumn("_n", fails).filter(F.col("_n") == most).groupBy(key).agg(F.min("page").alias("page"))


def page_gate(pages: DataFrame) -> DataFrame:
    """Add chars, words, usable and failed to (page, text, confidence, error)."""
    df = with_text_quality(pages.withColumns({"text": normalize_text(F.col("text")), "confidence": F.round("confidence").cast("int")}), out="_q", min_chars=20, min_words=3)
    failed = F.col("error").isNotNull()
    return df.withColumns({"chars": F.col("_q.chars"), "words": F.col("_q.words"), "failed": failed, "usable": ~failed & usable_page(F.col("_q"), F.col("confidence"))}).drop("_q")


def _pages(condition: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(condition, F.col("page"))))


def scanned_documents(pages: DataFrame, key: str = "file_id", total: str | None = None) -> DataFrame:
    """(key, markdown, error, recognition) of each document, from its pages (page, text, confidence, cached, error).

    Usable pages are taken under headings with their numbers. Where none is usable but some have text, those are taken
    with a note. total: a column with the document's number of pages; if it has more than the rows, a last part says so.
    A document with three failures in a row has an error instead of a text. A page that repeats is taken as often."""
    df = page_gate(pages)
    part = F.when(F.col("text") != "", F.struct("page", "text", "usable"))
    refused = ~F.col("usable") & (F.col("chars") > 0)
    out = df.groupBy(key).agg(
        F.sort_array(F.collect_list(part)).alias("_parts"),
        F.count("*").alias("ocr_pages"),
        (F.max(total) if total else F.count("*")).cast("long").alias("ocr_total_pages"),
        F.count_if(F.col("usable") & (F.col("chars") > 0)).alias("ocr_accepted_pages"),
        F.count_if(F.col("chars") > 0).alias("ocr_raw_recognized_pages"),
        _pages(refused).alias("ocr_rejected_pages"),
        F.count_if("cached").alias("ocr_cached_pages"),
        F.round(F.avg("confidence")).cast("int").alias("ocr_confidence"),
        F.expr("sort_array(collect_list(confidence))").alias("_sorted"),
        F.coalesce(F.sum(F.when(F.col("usable"), F.col("chars"))), F.lit(0)).cast("long").alias("ocr_chars"),
        F.sum("chars").cast("long").alias("ocr_raw_chars"),
        _pages(F.col("confidence") < 50).alias("ocr_low_confidence_pages"),
        _pages(F.col("chars") < 20).alias("ocr_empty_pages"),
        _pages(F.col("failed")).alias("ocr_failed_pages"),
    )
    none = F.array().cast("array<int>")
    salvaged = (F.col("ocr_accepted_pages") == 0) & (F.size("ocr_rejected_pages") > 0)
    limited = F.col("ocr_total_pages") > F.col("ocr_pages")
    heading = lambda p: F.concat(F.lit("## OCR page "), p["page"].cast("string"), F.lit("\n\n"))
    taken = F.filter("_parts", lambda p: p["usable"] | F.col("_salvaged"))
    texts = F.transform(taken, lambda p: F.concat(heading(p), F.when(p["usable"], "").otherwise(f"{LOW_QUALITY}\n\n"), p["text"]))
    status = F.concat(F.lit("## OCR status\n\nRecognized "), F.col("ocr_pages").cast("string"), F.lit(" of "), F.col("ocr_total_pages").cast("string"), F.lit(" pages."))
    out = out.withColumns({"_salvaged": salvaged, "ocr_limited": limited, "ocr_confidence_p10": F.get("_sorted", F.floor((F.size("_sorted") - 1) * 0.1).cast("int"))})
    out = out.withColumn("ocr_salvaged_pages", F.when(salvaged, F.col("ocr_rejected_pages")).otherwise(none))
    body = F.concat(texts, F.when(limited, F.array(status)).otherwise(F.array().cast("array<string>")))
    names = [c for c in out.columns if c.startswith("ocr_")]
    stopped = failed_runs(pages, key).select(key, F.concat(F.lit(f"{FAILURES} pages failed in a row, the last of them "), F.col("page").cast("string")).alias("error"))
    out = out.withColumn("markdown", normalize_text(F.array_join(body, "\n\n"))).join(stopped, key, "left")
    return out.select(key, F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown"), "error", F.struct(*names).alias("recognition"))
