"""Quality of indexed texts: warnings, status and score of each file, gates, retry decisions, and rollups by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.paths import extension
from docsift.functions.text import TEXT_PENALTIES, WORD, noise_report, normalize_text, penalty, regexp_count, text_warnings

#: What each warning of an indexed file costs.
INDEX_PENALTIES = {
    "ocr_limited": 15, "low_ocr_confidence": 25, "low_ocr_page_confidence": 15, "empty_ocr_pages": 10,
    "ocr_rejected_pages": 15, "no_usable_ocr_pages": 35, "ocr_failed_pages": 20, "pdf_text_layer_noise": 20,
    "ocr_text_noise": 35, "low_text_density": 20, "encoding_noise": 25, "too_little_text": 30, "too_few_words": 20,
}
#: Warnings that a second conversion may cure.
RETRYABLE = (
    "no_chunks", "too_little_text", "too_few_words", "low_text_density", "encoding_noise", "ocr_text_noise",
    "pdf_text_layer_noise", "empty_pdf_text", "low_ocr_confidence", "low_ocr_page_confidence", "empty_ocr_pages",
    "ocr_rejected_pages", "no_usable_ocr_pages", "ocr_failed_pages", "chunks_skipped_for_quality",
)
SUPPRESSING = ("ocr_text_noise", "pdf_text_layer_noise")


def with_text_quality(df: DataFrame, text: str = "text", out: str = "quality", min_chars: int = 120, min_words: int = 25) -> DataFrame:
    """Add the struct (score, warnings, chars, words, letter_ratio, replacement_ratio, noise_ratio, noisy_tokens, ...)."""
    df = df.withColumn("_t", normalize_text(F.col(text)))
    df = df.withColumns({"_chars": F.length("_t"), "_letters": F.length(F.regexp_replace("_t", r"\P{L}+", "")), "_words": regexp_count(F.col("_t"), WORD), "_bad": F.length("_t") - F.length(F.replace("_t", F.lit("\ufffd"), F.lit(""))), "_noise": noise_report(F.col("_t"))})
    ratio = lambda c: F.when(F.col("_chars") > 0, F.col(c) / F.col("_chars")).otherwise(0.0)
    warnings = text_warnings(F.col("_chars"), F.col("_words"), ratio("_letters"), ratio("_bad"), F.col("_noise.severe"), min_chars, min_words)
    df = df.withColumn("_warnings", warnings)
    quality = F.struct(
        penalty(F.col("_warnings"), TEXT_PENALTIES).alias("score"),
        F.col("_warnings").alias("warnings"),
        F.col("_chars").alias("chars"),
        F.col("_words").alias("words"),
        F.round(ratio("_letters"), 3).alias("letter_ratio"),
        F.round(ratio("_bad"), 3).alias("replacement_ratio"),
        F.col("_noise.noise_ratio").alias("noise_ratio"),
        F.col("_noise.noisy_tokens").alias("noisy_tokens"),
        F.col("_noise.mixed_script_tokens").alias("mixed_script_tokens"),
        F.col("_noise.alpha_digit_tokens").alias("alpha_digit_tokens"),
    )
    return df.withColumn(out, quality).drop("_t", "_chars", "_letters", "_words", "_bad", "_noise", "_warnings")


def usable_text_layer(quality: Column) -> Column:
    return (quality["chars"] >= 120) & (quality["words"] >= 10) & (quality["score"] >= 70) & ~F.arrays_overlap(quality["warnings"], F.array(F.lit("encoding_noise"), F.lit("ocr_text_noise")))


def usable_page(quality: Column, confidence: Column) -> Column:
    """quality: of a page's text with min_chars 20 and min_words 3."""
    bad = F.array(*map(F.lit, ("ocr_text_noise", "encoding_noise", "low_text_density")))
    return (quality["chars"] >= 20) & (quality["words"] >= 3) & ~F.arrays_overlap(quality["warnings"], bad) & (confidence.isNull() | (confidence >= 25))


def choose_text(layer: Column, scanned: Column) -> Column:
    """ocr if the text layer isn't usable, or the scan's text scores more than ten higher; else text-layer."""
    return F.when(~usable_text_layer(layer) | (F.coalesce(scanned["score"], F.lit(0)) > layer["score"] + 10), "ocr").otherwise("text-layer")


def verify(df: DataFrame, text: str = "text", chunks: str = "chunks", recognition: str | None = None, out: str = "index_quality") -> DataFrame:
    """Add the struct (status, score, warnings, chars, words, chunks) of an indexed file.

    recognition: a struct column with any of ocr_limited, ocr_confidence, ocr_low_confidence_pages, ocr_empty_pages,
    ocr_rejected_pages, ocr_failed_pages, ocr_accepted_pages, ocr_raw_recognized_pages, method, selected_text, layer_warnings."""
    df = with_text_quality(df, text, "_q")
    have = {f.name for f in df.schema[recognition].dataType.fields} if recognition else set()
    r = lambda n: F.col(f"{recognition}.{n}")
    some = lambda n: F.size(F.coalesce(r(n), F.array().cast("array<int>"))) > 0
    rules: list[tuple[set[str], Column | None, str]] = [(set(), F.col(chunks) == 0, "no_chunks")]
    if recognition:
        rules += [
            ({"ocr_limited"}, r("ocr_limited") if "ocr_limited" in have else None, "ocr_limited"),
            ({"ocr_confidence"}, r("ocr_confidence") < 50 if "ocr_confidence" in have else None, "low_ocr_confidence"),
            *(({n}, some(n) if n in have else None, w) for n, w in (("ocr_low_confidence_pages", "low_ocr_page_confidence"), ("ocr_empty_pages", "empty_ocr_pages"), ("ocr_rejected_pages", "ocr_rejected_pages"), ("ocr_failed_pages", "ocr_failed_pages"))),
        ]
        if {"ocr_accepted_pages", "ocr_raw_recognized_pages"} <= have:
            rules.append((set(), (r("ocr_accepted_pages") == 0) & (r("ocr_raw_recognized_pages") > 0), "no_usable_ocr_pages"))
        if "method" in have:
            rules += [(set(), r("method") == "conversion-error", "conversion_error"), (set(), r("method") == "pdf-empty", "empty_pdf_text")]
        if {"selected_text", "layer_warnings"} <= have:
            noisy = F.arrays_overlap(r("layer_warnings"), F.array(F.lit("encoding_noise"), F.lit("ocr_text_noise")))
            rules.append((set(), (r("selected_text") == "text-layer") & noisy, "pdf_text_layer_noise"))
    own = F.array_compact(F.array(*(F.when(c, F.lit(w)) for needs, c, w in rules if c is not None and needs <= have)))
    df = df.withColumn("_w", F.array_distinct(F.concat("_q.warnings", own)))
    severe = F.arrays_overlap("_w", F.array(*map(F.lit, SUPPRESSING)))
    status = F.when((F.col(chunks) == 0) | (F.col("_q.chars") < 80) | severe, "error").when(F.size("_w") > 0, "warning").otherwise("ok")
    score = F.when(F.col(chunks) == 0, 0).otherwise(penalty(F.col("_w"), INDEX_PENALTIES))
    quality = F.struct(status.alias("status"), score.alias("score"), F.col("_w").alias("warnings"), F.col("_q.chars").alias("chars"), F.col("_q.words").alias("words"), F.col(chunks).cast("int").alias("chunks"))
    return df.withColumn(out, quality).drop("_q", "_w")


def suppressed(quality: Column) -> Column:
    """The quality of a file whose chunks are dropped for noise; others unchanged."""
    drop = F.arrays_overlap(quality["warnings"], F.array(*map(F.lit, SUPPRESSING))) & (quality["chunks"] > 0)
    return F.when(
        drop,
        F.struct(F.lit("error").alias("status"), quality["score"].alias("score"), F.array_union(quality["warnings"], F.array(F.lit("chunks_skipped_for_quality"))).alias("warnings"), quality["chars"].alias("chars"), quality["words"].alias("words"), F.lit(0).alias("chunks")),
    ).otherwise(quality)


def retry_reasons(quality: Column, from_cache: Column, min_score: int = 60) -> Column:
    """Why a file should be converted once more; empty if it shouldn't."""
    own = F.filter(quality["warnings"], lambda w: w.isin(*RETRYABLE))
    head = F.array_compact(F.array(F.when(quality["status"] == "error", F.lit("quality_error")), F.when(quality["score"] < min_score, F.lit("low_quality_score"))))
    cached = F.when(from_cache & (F.size(F.array_remove(quality["warnings"], "ocr_limited")) > 0), F.array(F.lit("cached_quality_warning"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(head, own, cached))


def retry_decision(quality: Column, from_cache: Column, attempt: Column, max_attempts: int = 1) -> Column:
    """(queued, reason, reasons)."""
    spent = attempt >= max_attempts
    reasons = F.when(spent, F.array().cast("array<string>")).otherwise(retry_reasons(quality, from_cache))
    return F.struct((F.size(reasons) > 0).alias("queued"), F.when(spent, "max_attempts").when(F.size(reasons) > 0, "quality").otherwise("not_needed").alias("reason"), reasons.alias("reasons"))


def retry_report(before: Column, after: Column, failed: Column) -> Column:
    """(status, final_reasons, improved) of a second conversion."""
    left = F.when(failed, F.array().cast("array<string>")).otherwise(retry_reasons(after, F.lit(False)))
    return F.struct(F.when(failed, "retry_failed").when(F.size(left) > 0, "unresolved").otherwise("resolved").alias("status"), left.alias("final_reasons"), F.coalesce(after["score"] > before["score"], F.lit(False)).alias("improved"))


def page_rollup(pages: DataFrame, key: str, confidence: str = "confidence", page: str = "page", usable: str = "usable") -> DataFrame:
    """Per document: pages, accepted, mean and tenth percentile of confidence (the floor index's value), pages below 50."""
    c = F.col(confidence)
    return pages.groupBy(key).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col(usable)).alias("accepted_pages"),
        F.round(F.avg(c)).cast("int").alias("confidence"),
        F.expr(f"percentile_disc(0.1) WITHIN GROUP (ORDER BY `{confidence}`)").cast("int").alias("confidence_p10"),
        F.sort_array(F.collect_list(F.when(c < 50, F.col(page)))).alias("low_confidence_pages"),
        F.sort_array(F.collect_list(F.when(~F.col(usable), F.col(page)))).alias("rejected_pages"),
    )


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100.0 * part / total + 0.5)))).otherwise(0).cast("int")


def file_status(status: Column, chunks: Column) -> Column:
    return F.coalesce(status, F.when(chunks > 0, "unchecked").otherwise("error"))


def fallback_score(status: Column, chunks: Column) -> Column:
    return F.when(status == "ok", 100).when(status == "warning", 70).when(status == "error", 0).when(chunks > 0, 80).otherwise(0)


def shown_warnings(warnings: str = "warnings", status: str = "status") -> Column:
    """A file's warnings, each once; an error without any counts as quality_error."""
    own = F.filter(F.array_distinct(F.transform(warnings, lambda w: F.trim(w))), lambda w: w != "")
    return F.when(F.size(own) > 0, own).when(F.col(status) == "error", F.array(F.lit("quality_error"))).otherwise(F.array().cast("array<string>"))


def source_rollup(files: DataFrame, key: str = "source_id") -> DataFrame:
    """Per source, from files (status, score, chars, words, chunks[, warnings]): histogram, coverage, means, score and
    status, and the number of warnings, if files have them. One aggregate, so files are looked at once."""
    status = file_status(F.col("status"), F.col("chunks"))
    count = lambda s: F.count_if(status == s).alias(f"{s}_files")
    half_up = lambda c: F.floor(F.avg(c) + 0.5).cast("int")
    out = files.groupBy(key).agg(
        F.count("*").alias("files"),
        *map(count, ("ok", "warning", "error", "unchecked")),
        F.count_if(F.col("chunks") > 0).alias("searchable"),
        F.count_if((F.col("chunks") > 0) | (F.col("chars") >= 80)).alias("with_text"),
        F.sum("chunks").cast("long").alias("chunks"),
        F.sum("chars").cast("long").alias("total_chars"),
        half_up(F.col("chars")).alias("avg_chars"),
        half_up(F.col("words")).alias("avg_words"),
        half_up(F.coalesce(F.col("score"), fallback_score(status, F.col("chunks")))).alias("score"),
        *([F.sum(F.size(shown_warnings())).alias("warnings")] if "warnings" in files.columns else []),
    )
    overall = F.when((F.col("error_files") > 0) | (F.col("score") < 60), "error").when((F.col("warning_files") > 0) | (F.col("unchecked_files") > 0) | (F.col("score") < 85), "warning").otherwise("ok")
    return out.withColumn("text_coverage", percent(F.col("searchable"), F.col("files"))).withColumn("status", overall)


def warning_histogram(files: DataFrame, key: str = "source_id", warnings: str = "warnings", status: str = "status") -> DataFrame:
    """(key, warning, count): each file counts once for each warning; an error without any counts as quality_error."""
    return files.select(key, F.explode(shown_warnings(warnings, status)).alias("warning")).groupBy(key, "warning").count()


def first_files(files: DataFrame, key: str = "source_id", n: int = 8, order: str = "file_id") -> DataFrame:
    """The first n files of each source."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def top_types(files: DataFrame, key: str = "source_id", path: str = "path", n: int = 5) -> DataFrame:
    """The n commonest extensions of each source, by count and name."""
    ext = F.coalesce(F.nullif(extension(F.col(path)), F.lit("")), F.lit("[no extension]"))
    counted = files.groupBy(key, ext.alias("extension")).count()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "extension"))
    return counted.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def retry_summary(files: DataFrame, key: str = "source_id") -> DataFrame:
    """files: reindex struct (retried, status, reasons)."""
    s = F.col("reindex.status")
    return files.filter("reindex.retried").groupBy(key).agg(
        F.count("*").alias("retried"),
        *(F.count_if(s == v).alias(n) for v, n in (("resolved", "resolved"), ("unresolved", "unresolved"), ("retry_failed", "failed"))),
        F.count_if(F.array_contains("reindex.reasons", "conversion_error")).alias("recovered_errors"),
    )


def snapshot(files: DataFrame, key: str = "source_id", at: str = "indexed_at") -> DataFrame:
    """Files, searchable, chunks and the latest time, per source and, with a null key, in all."""
    return files.rollup(key).agg(F.count("*").alias("files"), F.count_if(F.col("chunks") > 0).alias("searchable"), F.sum("chunks").cast("long").alias("chunks"), F.max(at).alias("indexed_at"))


def summary_text(files: Column, chunks: Column, warnings: Column) -> Column:
    word = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))
    return F.concat(word(files, "file"), F.lit(", "), word(chunks, "chunk"), F.lit(", "), F.when(warnings > 0, word(warnings, "quality warning")).otherwise(F.lit("no quality warnings")), F.lit("."))


def folder_totals(files: DataFrame, path: str = "path", size: str = "chunks") -> DataFrame:
    """(folder, files, total) for every folder above a file, the root as the empty string."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("folder"), F.col(size).alias("_s")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("_s").cast("long").alias("total"))
