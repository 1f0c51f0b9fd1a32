"""Tender documents: signals of commercial proposals, prices, estimates and tender papers in names and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.money import SPACE
from docsift.functions.text import match_text

SAMPLE = 20_000
#: Signals by family. Words of Cyrillic letters end where no letter or digit follows, forms KS-2 and KS-3 too.
COMMERCIAL = (
    ("kp_ru", r"(?:^|[^\p{L}\p{N}])кп(?:[^\p{L}\p{N}]|$)"),
    ("commercial_proposal_ru", r"коммерческ\p{L}{0,20}\s+предложен\p{L}{0,20}"),
    ("quotation_en", r"\b(?:quote|quotation|commercial\s+proposal|proposal|offer)\b"),
)
PRICE = (
    ("price_ru", r"(?:^|[^\p{L}\p{N}])(?:цена|стоимость|расценк\p{L}*|сумма|итого|ндс)(?:[^\p{L}\p{N}]|$)"),
    ("currency_ru", r"(?:₽|(?:^|[^\p{L}\p{N}])руб\.?|(?:^|[^\p{L}\p{N}])рубл\p{L}*)"),
    ("number_currency", r"\b\d[\d\s.,]*(?:₽|руб\.?|рубл\p{L}*)"),
)
ESTIMATE = (
    ("estimate_ru", r"(?:^|[^\p{L}\p{N}])(?:смета|сметн\p{L}*|локальн\p{L}*\s+смет\p{L}*)(?:[^\p{L}\p{N}]|$)"),
    ("ks_forms", r"(?:^|[^\p{L}\p{N}])кс\s*-?\s*(?:2|3)(?:[^\p{L}\p{N}]|$)"),
)
TENDER = (
    ("tender_docs_ru", r"(?:тендерн\p{L}*\s+документац\p{L}*|документац\p{L}*\s+закупк\p{L}*)"),
    ("technical_task_ru", r"(?:техническ\p{L}*\s+задан\p{L}*|(?:^|[^\p{L}\p{N}])тз(?:[^\p{L}\p{N}]|$))"),
    ("specification_ru", r"(?:^|[^\p{L}\p{N}])(?:спецификац\p{L}*|ведомост\p{L}*\s+объем\p{L}*)(?:[^\p{L}\p{N}]|$)"),
)


def _plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), "ёЁ", "еЕ"), rf"[{SPACE}]+", " "))


def _signals(text: Column, family: tuple[tuple[str, str], ...]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?iu){p}"), F.lit(n)) for n, p in family)))


def recognize(df: DataFrame, name: Column, text: str = "text", is_tender: Column | None = None, out: str = "recognition") -> DataFrame:
    """Add the struct (document_type, is_commercial_proposal, has_price_signals, has_estimate_signals,
    has_tender_doc_signals, signal_score, signals). name: title and paths, in one string."""
    sample = F.concat_ws("\n", _plain(name), F.substr(_plain(F.col(text)), F.lit(1), F.lit(SAMPLE)))
    df = df.withColumn("_s", sample)
    names = {"_c": COMMERCIAL, "_p": PRICE, "_e": ESTIMATE, "_d": TENDER}
    df = df.withColumns({c: _signals(F.col("_s"), f) for c, f in names.items()})
    n = lambda c: F.size(c)
    kind = F.when(n("_c") > 0, "commercial_proposal").when(n("_e") > 0, "cost_estimate").when(n("_d") > 0, "tender_document").when(n("_p") > 0, "price_table").otherwise("tender_file")
    score = F.greatest(F.lit(0), F.least(F.lit(100), 10 + 35 * n("_c") + 10 * n("_p") + 12 * n("_e") + 8 * n("_d")))
    tender = F.lit(True) if is_tender is None else is_tender
    no = lambda c: tender & (n(c) > 0)
    value = F.struct(
        F.when(tender, kind).otherwise("").alias("document_type"),
        no("_c").alias("is_commercial_proposal"),
        no("_p").alias("has_price_signals"),
        no("_e").alias("has_estimate_signals"),
        no("_d").alias("has_tender_doc_signals"),
        F.when(tender, score).otherwise(0).alias("signal_score"),
        F.when(tender, F.array_distinct(F.concat("_c", "_p", "_e", "_d"))).otherwise(F.array().cast("array<string>")).alias("signals"),
    )
    return df.withColumn(out, value).drop("_s", *names)


def type_summary(files: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, document_type, files, commercial, with_prices) of files with a recognition struct."""
    return files.groupBy(key, F.col("recognition.document_type").alias("document_type")).agg(
        F.count("*").alias("files"), F.count_if("recognition.is_commercial_proposal").alias("commercial"), F.count_if("recognition.has_price_signals").alias("with_prices")
    )


#: Questions, as match text, that ask all sources.
ALL_SOURCES = (
    r"\b(?:all|every)\s+(?:projects?|sources?|folders?)\b",
    r"\bacross\s+(?:all\s+)?(?:projects?|sources?|folders?)\b",
    r"(?:^|\s)(?:все|всех|всем|всеми)\s+(?:проект\p{L}*|источник\p{L}*|папк\p{L}*)(?:\s|$)",
    r"(?:^|\s)кажд\p{L}*\s+(?:проект\p{L}*|источник\p{L}*|папк\p{L}*)(?:\s|$)",
)
#: Questions that ask for a broad answer.
BROAD = (
    r"\b(?:summary|overview|summarize|summarise)\b",
    r"\b(?:main|key|essential)\s+(?:terms|conditions|points|facts|risks)\b",
    r"(?:^|\s)(?:основн|ключев|существенн)\p{L}*\s+(?:услов|положен|пункт|факт|риск|требован)\p{L}*(?:\s|$)",
    r"(?:^|\s)(?:сводк|обзор|резюме)\p{L}*(?:\s|$)",
    r"(?:^|\s)(?:проанализируй|разбери|проверь)\s+(?:договор|контракт|проект)\p{L}*(?:\s|$)",
    r"(?:^|\s)(?:что|чего)\s+(?:в|по)\s+(?:договор|контракт)\p{L}*(?:\s|$)",
)
#: Broad questions about a contract, and the terms that their search adds.
CONTRACT = (r"(?:^|\s)(?:договор|контракт|соглашени|дс|допсоглашени|услов)\p{L}*(?:\s|$)", r"\b(?:contract|agreement|terms|conditions)\b")
CONTRACT_TERMS = (
    "предмет договора",
    "стороны заказчик подрядчик исполнитель",
    "цена стоимость сумма договора НДС",
    "срок выполнения работ дата окончания период",
    "оплата платеж аванс",
    "гарантийное удержание банковская гарантия обеспечение",
    "ответственность штраф пени неустойка",
    "дополнительное соглашение изменение цены",
)


def _asks(question: Column, patterns: tuple[str, ...]) -> Column:
    return match_text(question).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def intent(question: Column) -> Column:
    """(all_sources, broad, limit): what a chat question asks for, and how many results that takes."""
    every, broad = _asks(question, ALL_SOURCES), _asks(question, BROAD)
    limit = F.when(every & broad, 36).when(every, 24).when(broad, 20).otherwise(12)
    return F.struct(every.alias("all_sources"), broad.alias("broad"), limit.alias("limit"))


def expanded_question(question: Column) -> Column:
    """A broad question about a contract with the terms that its answer needs on a line of their own; others unchanged."""
    q = F.coalesce(question, F.lit(""))
    return F.when(_asks(q, BROAD) & _asks(q, CONTRACT), F.concat(q, F.lit("\n" + " ".join(CONTRACT_TERMS)))).otherwise(q)
