"""Citations: labels and targets of chunks, numbers and evidence in answers, context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.arrays import let, prefix_sums
from docsift.functions.paths import base_name

PAGE, SHEET, SECTION, SOURCES = "стр.", "лист", "раздел", "Источники"


def file_label(title: Column, path: Column) -> Column:
    """The title, else the file's name, else source."""
    blank = F.lit("")
    return F.trim(F.coalesce(F.nullif(F.coalesce(title, blank), blank), F.nullif(base_name(path), blank), F.lit("source")))


def quoted(value: Column, limit: int = 90) -> Column:
    t = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    cut = F.when(F.length(t) > limit, F.concat(F.trim(F.substr(t, F.lit(1), F.lit(limit - 1))), F.lit("..."))).otherwise(t)
    return F.concat(F.lit('"'), F.replace(cut, F.lit('"'), F.lit("'")), F.lit('"'))


def label(title: Column, path: Column, page_start: Column, page_end: Column, sheet: Column, section: Column) -> Column:
    """Name and page or pages, else sheet, else section."""
    name = file_label(title, path)
    pages = F.when(page_end > page_start, F.concat_ws("-", page_start.cast("string"), page_end.cast("string"))).otherwise(page_start.cast("string"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(page_start.isNotNull(), F.concat(name, F.lit(f", {PAGE} "), pages))
        .when(has(sheet), F.concat(name, F.lit(f", {SHEET} "), quoted(sheet)))
        .when(has(section), F.concat(name, F.lit(f", {SECTION} "), quoted(section)))
        .otherwise(name)
    )


def label_of(df: DataFrame) -> Column:
    """The label from whichever of the usual columns a frame has."""
    col = lambda n, kind="string": F.col(n) if n in df.columns else F.lit(None).cast(kind)
    return label(col("title"), col("path"), col("page_start", "int"), col("page_end", "int"), col("sheet_name"), col("section_title"))


def target(df: DataFrame, index: Column) -> Column:
    """Where a citation points, as a struct."""
    names = ("source_id", "chunk_id", "chunk_index", "file_id", "document_type", "page_start", "page_end", "total_pages", "sheet_name", "row_start", "row_end", "section_title")
    have = [F.col(n).alias(n) for n in names if n in df.columns]
    title, path = (F.col(n) if n in df.columns else F.lit(None).cast("string") for n in ("title", "path"))
    text = F.col("snippet") if "snippet" in df.columns else F.col("text")
    return F.struct((index + 1).alias("citation_id"), index.alias("index"), *have, file_label(title, path).alias("file_label"), label_of(df).alias("label"), F.substr(text, F.lit(1), F.lit(1200)).alias("snippet"))


def numbers(answer: Column, sources: Column) -> Column:
    """Distinct citation numbers from 1 to sources, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n > 0) & (n <= sources)))


def with_sources(answer: Column, sources: Column) -> Column:
    """The answer with a line of sources unless it has one: those cited (12 at most), else the first three."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    cited = numbers(text, sources)
    first = F.when(sources > 0, F.sequence(F.lit(1), F.greatest(F.least(sources, F.lit(3)), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    chosen = F.when(F.size(cited) > 0, F.slice(cited, 1, 12)).otherwise(first)
    refs = F.array_join(F.transform(chosen, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    done = (text == "") | text.rlike(rf"(?iu)(?:^|\n)\s*{SOURCES}\s*:") | (sources <= 0)
    return F.when(done, text).otherwise(F.concat(text, F.lit(f"\n\n{SOURCES}: "), refs, F.lit(".")))


def clean_evidence(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"\[(\d+)\]", " "), r"^[\s\-–—*•\d.)]+", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    cut = F.when(F.length(t) > 700, F.concat(F.trim(F.substr(t, F.lit(1), F.lit(700))), F.lit("..."))).otherwise(t)
    return F.when(t.rlike(rf"(?iu)^{SOURCES}\s*:"), "").otherwise(cut)


def evidence_line(answer: Column, number: Column) -> Column:
    """The first line that cites a number, cleaned; of a line that is nothing but the citation, the sentence before."""
    mark = F.concat(F.lit("["), number.cast("string"), F.lit("]"))
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.contains(x, mark))
    cleaned = F.filter(F.transform(lines, clean_evidence), lambda x: x != "")
    before = F.call_function("substring_index", F.coalesce(answer, F.lit("")), mark, F.lit(1))
    sentence = F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(before, r"[.!?]")), lambda s: (F.trim(s) != "") | (s == "")), -1)
    return F.coalesce(F.get(cleaned, F.lit(0)), F.when(F.size(lines) > 0, clean_evidence(sentence)), F.lit(""))


def compact_evidence(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[(\d+)\]", " ")
    return F.substr(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(1), F.lit(900))


_EMAIL = r"(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
_URL = r"(?i)(https?://[^\s),;]+)"
_NUMBER = r"(?iu)\b(\d[\d\s.,-]*(?:%|₽|руб\.?|дн(?:ей|я)?|мес(?:яцев|ца)?|лет|год(?:а|ов)?)?)"
_WORD = r"([\p{L}\p{N}_@.+%-]{3,})"


def evidence_tokens(text: Column, limit: int = 32) -> Column:
    """E-mails, addresses, numbers, then words, each once whatever its case."""

    def found(t: Column) -> Column:
        every = [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (_EMAIL, _URL, _NUMBER, _WORD)]
        words = F.filter(every[3], lambda w: ~w.rlike(r"^\d+$"))
        return F.filter(F.transform(F.concat(every[0], every[1], every[2], words), lambda x: F.trim(x)), lambda x: x != "")

    def once(all_: Column) -> Column:
        return let(F.transform(all_, lambda x: F.lower(x)), lambda low: F.filter(all_, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    return F.slice(let(let(compact_evidence(text), found), once), 1, limit)


def token_weight(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("@")) | token.rlike("(?i)^https?://"), 8).when(token.rlike(r"\d"), 4).when(F.length(token) >= 6, 2).otherwise(1)


def evidence_span(text: Column, focus: Column) -> Column:
    """The run of one to three lines that holds the most of the focus text, by weight of its tokens; the shortest of
    equals. (start, end, score); null if nothing matches. A text that holds the focus itself gives that place."""
    body, wanted = F.coalesce(text, F.lit("")), compact_evidence(focus)
    direct = F.instr(F.lower(body), F.lower(wanted))

    def best(toks: Column, lines: Column, starts: Column) -> Column:
        n = F.size(lines)

        def run(i: Column, span: Column) -> Column:
            part = F.array_join(F.slice(lines, i + 1, span), "\n")

            def scored(low: Column) -> Column:
                score = F.aggregate(toks, F.lit(0), lambda a, t: a + F.when(F.contains(low, t), token_weight(t)).otherwise(0))
                at = F.get(starts, i)
                return F.struct(score.alias("score"), (-F.length(low)).alias("shorter"), (-at).alias("earlier"), at.alias("start"), (at + F.length(part)).alias("end"))

            return let(F.lower(part), scored)

        runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), n - i)), lambda s: run(i, s))))
        return F.array_max(F.filter(runs, lambda r: r["score"] > 0))

    low_tokens = F.transform(evidence_tokens(focus), lambda t: F.lower(t))
    offsets = lambda lines: F.concat(F.array(F.lit(0)), prefix_sums(F.transform(lines, lambda x: F.length(x) + 1)))
    searched = let(low_tokens, lambda toks: let(F.split(body, "\n"), lambda lines: let(offsets(lines), lambda starts: best(toks, lines, starts))))
    found = F.struct((direct - 1).alias("start"), (direct - 1 + F.length(wanted)).alias("end"), F.lit(0).alias("score"))
    span = lambda b: F.when(b.isNotNull(), F.struct(b["start"].alias("start"), b["end"].alias("end"), b["score"].alias("score")))
    return F.when((wanted != "") & (direct > 0), found).otherwise(let(searched, span))


def preview(text: Column, start: Column, end: Column, before: int = 520, after: int = 760) -> Column:
    """The lines around a range: text, where the range is in it, and what was cut."""
    raw_start, raw_end = F.greatest(F.lit(0), start - before), F.least(F.length(text), end + after)
    head = F.substr(text, F.lit(1), raw_start)
    first = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    tail = F.substr(text, raw_end + 1)
    last = raw_end + F.length(F.substring_index(tail, "\n", 1))
    return F.struct(F.substr(text, first + 1, last - first).alias("text"), (start - first).alias("focus_start"), (end - first).alias("focus_end"), (first > 0).alias("cut_before"), (last < F.length(text)).alias("cut_after"))


#: Sources and characters of each, for a first try and a tighter one: by whether all sources are searched and the answer is broad.
CONTEXT_PROFILES = {(False, False): ((8, 1400), (6, 900)), (False, True): ((14, 1200), (10, 900)), (True, False): ((16, 900), (12, 700)), (True, True): ((20, 900), (14, 700))}


def context_text(results: DataFrame, max_sources: int = 8, max_chars: int = 1400, query_key: str = "query_id") -> DataFrame:
    """One text per query of its best results, in order, each under its number and label. At most max_sources rows of a query meet."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), F.substr("text", F.lit(1), F.lit(max_chars)))
    rows = results.filter(F.col("rank") <= max_sources).select(query_key, F.struct("rank", part.alias("part")).alias("r"))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["part"]), "\n\n").alias("context"))


def excerpt(text: Column, question_terms: Column, count: int = 4) -> Column:
    """The best paragraphs for a question, at most `count`, back in the text's order; else the text's first 900 characters."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p)), lambda p: F.length(p) >= 30)
    rows = F.transform(
        parts,
        lambda p, i: F.struct(
            (-(F.size(F.filter(question_terms, lambda t: F.contains(F.lower(p), t))) + F.when(p.rlike(r"\d{2}\.\d{2}\.\d{4}"), 0.5).otherwise(0.0))).alias("minus"),
            i.alias("i"),
            p.alias("p"),
        ),
    )
    best = F.slice(F.array_sort(F.filter(rows, lambda r: r["minus"] < 0)), 1, count)
    ordered = F.array_join(F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["i"].alias("i"), r["p"].alias("p")))), lambda r: r["p"]), "\n\n")
    chosen = F.when(F.size(best) > 0, ordered).otherwise(F.substr(text, F.lit(1), F.lit(900)))
    return F.when(F.length(chosen) > 1200, F.concat(F.trim(F.substr(chosen, F.lit(1), F.lit(1200))), F.lit("..."))).otherwise(chosen)
