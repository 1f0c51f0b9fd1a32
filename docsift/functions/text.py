"""Text functions as column expressions: tokens, normalisation, snippets, noise and quality measures, match text.

Lengths are code points throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.arrays import let

TOKEN = r"([\p{L}\p{N}_-]{2,})"

#: Groups of words that stand for each other in a query. The first is about cost, the second about contracts.
SYNONYMS = (
    ("стоимость", "стоимости", "стоит", "стоить", "цена", "цену", "цены", "цене", "сумма", "сумму", "размер"),
    ("договор", "договора", "договору", "договором", "договоры", "договоров", "договорах", "договорам", "договорами", "контракт", "контракта", "контракту", "контракты", "контрактов", "контрактах", "соглашение", "соглашения"),
    ("срок", "сроки", "сроков", "период", "дата", "даты"),
    ("оплата", "оплаты", "платеж", "платежи", "аванс", "авансовый"),
    ("штраф", "штрафы", "пени", "неустойка", "ответственность"),
    ("почта", "почты", "почту", "почте", "электронная", "электронной", "электронный", "email", "e-mail", "mail"),
    ("ндс", "налог"),
)
#: Words without weight when a question is matched to a source.
STOP_WORDS = (
    "где", "как", "какие", "какая", "какой", "какое", "что", "кто", "чем", "почему",
    "проект", "проекта", "проекту", "папка", "папке", "договор", "договора", "договору",
    "условия", "условие", "срок", "сроки", "сумма", "цена", "размер", "основные",
    "найди", "найти", "покажи", "скажи", "ответь", "прописано", "указано",
    "по", "на", "в", "во", "и", "или", "а", "к", "ко", "о", "об", "от", "для", "из", "с", "со",
    "жк", "жилой", "комплекс", "ооо", "зао", "пао", "ао",
    "договоре", "договоры", "договоров", "договорам", "договорами",
    "гарантийного", "гарантийный", "удержания", "удержание", "предусмотрен", "предусмотрено",
)
#: Endings that a word of four letters or more may lose.
ENDINGS = (
    "иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими",
    "ая", "яя", "ое", "ее", "ые", "ие", "ый", "ий", "ой", "ей",
    "ов", "ев", "ах", "ях", "ам", "ям", "ом", "ем", "а", "я", "у", "ю", "ы", "и", "е", "о",
)
#: Latin spelling of Cyrillic letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ы": "y", "э": "e", "ю": "yu", "я": "ya",
}


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, _ and -, longer than one character, in order, with repeats. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


#: What counts as white space at the ends of a text.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(text: Column) -> Column:
    """Trim all white space, no-break spaces too."""
    return F.trim(text, F.lit(_BLANKS))


def _replaced(text: Column, needles: tuple[str, ...], pattern: str, to: str) -> Column:
    """regexp_replace for texts that hold one of the needles, without which the pattern can't match."""
    held = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(n)) for n in needles))
    return let(text, lambda t: F.when(held(t), F.regexp_replace(t, pattern, to)).otherwise(t))


def normalize_text(text: Column) -> Column:
    """Line ends to LF, no blanks before them, at most two blank lines running, trimmed."""
    t = _replaced(F.coalesce(text, F.lit("")), ("\r",), r"\r\n?", "\n")
    t = _replaced(t, (" \n", "\t\n"), r"[ \t]+\n", "\n")
    return js_trim(_replaced(t, ("\n\n\n\n",), r"\n{4,}", "\n\n\n"))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def expand_synonyms(terms: Column) -> Column:
    """The terms, then those of each group that one of them belongs to."""
    none = F.array().cast("array<string>")
    added = [F.when(F.arrays_overlap(terms, strings(*g)), strings(*g)).otherwise(none) for g in SYNONYMS]
    return F.array_distinct(F.concat(terms, *added))


def phrase_boost(text: Column, terms: Column) -> Column:
    """A small bonus for texts that state a contract's price, when the terms ask for cost and for a contract."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *phrases: F.greatest(*(F.contains(low, F.lit(p)) for p in phrases)) if len(phrases) > 1 else F.contains(low, F.lit(phrases[0]))
    bonus = (
        F.when(has("цена договора"), 0.08).otherwise(0.0)
        + F.when(has("цена работ по договору", "цену работ по договору"), 0.04).otherwise(0.0)
        + F.when(has("составляет") & low.rlike(r"[0-9][0-9\s\x{A0}]{6,},[0-9]{2}"), 0.04).otherwise(0.0)
        - F.when(has("стоимость подготовительных работ"), 0.04).otherwise(0.0)
    )
    asked = F.arrays_overlap(terms, strings(*SYNONYMS[0])) & F.arrays_overlap(terms, strings(*SYNONYMS[1]))
    return F.when(asked, bonus).otherwise(0.0)


def snippet(text: Column, query: Column, radius: int = 260) -> Column:
    """The text around the first query term, in the query's order, that occurs in it; else the text's beginning."""
    body = F.coalesce(text, F.lit(""))
    low = F.lower(body)
    first = let(low, lambda b: F.get(F.filter(F.transform(tokens(query), lambda t: F.instr(b, t)), lambda p: p > 0), F.lit(0)))

    def around(place: Column) -> Column:
        start, end = F.greatest(F.lit(0), place - 1 - radius), F.least(F.length(body), place - 1 + radius)
        cut = F.concat(F.when(start > 0, "...").otherwise(""), normalize_text(F.substr(body, start + 1, end - start)), F.when(end < F.length(body), "...").otherwise(""))
        return F.when(place.isNull(), F.substr(normalize_text(body), F.lit(1), F.lit(2 * radius))).otherwise(cut)

    return let(first, around)


WORD = r"[\p{L}\p{N}]{2,}"
#: Words with a digit, and words of both scripts, each looked at from its first character on only.
_DIGIT_WORD = r"(?<![\p{L}\p{N}])\p{L}*+\p{N}[\p{L}\p{N}]*+"
_MIXED_WORD = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}]*\p{IsLatin})(?=[\p{L}\p{N}]*\p{IsCyrillic})[\p{L}\p{N}]{2,}"


def noise_report(text: Column) -> Column:
    """Counts of letter tokens and of tokens that look misread: mixed scripts, or digits within words.

    A token is a run of two or more letters and digits. Only tokens with a digit are taken out of the text, and those
    of mixed scripts from texts that have both."""
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    both = lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"\p{IsCyrillic}")
    digits = F.filter(F.regexp_extract_all(body, F.lit(_DIGIT_WORD), F.lit(0)), lambda w: F.length(w) >= 2)
    mixed = F.when(body.rlike(r"\p{IsCyrillic}") & body.rlike(r"\p{IsLatin}"), F.regexp_extract_all(body, F.lit(_MIXED_WORD), F.lit(0))).otherwise(none)
    lettered = lambda words: F.filter(words, lambda w: w.rlike(r"\p{L}"))
    misread = lambda d: F.size(F.filter(lettered(d), lambda w: (F.length(w) >= 4) & ~both(w)))
    counts = let(digits, lambda d: F.struct((regexp_count(body, WORD) - F.size(d) + F.size(lettered(d))).alias("n"), F.size(lettered(mixed)).alias("mixed"), misread(d).alias("digits")))

    def report(c: Column) -> Column:
        noisy = c["mixed"] + c["digits"]
        ratio = F.when(c["n"] > 0, noisy / c["n"]).otherwise(0.0)
        return F.struct(
            c["n"].alias("letter_tokens"),
            noisy.alias("noisy_tokens"),
            c["mixed"].alias("mixed_script_tokens"),
            c["digits"].alias("alpha_digit_tokens"),
            F.round(ratio, 3).alias("noise_ratio"),
            ((noisy >= 3) & (ratio >= 0.08)).alias("severe"),
        )

    return let(counts, report)


def regexp_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


#: What each warning of the text report costs.
TEXT_PENALTIES = {"too_little_text": 30, "too_few_words": 20, "low_text_density": 20, "encoding_noise": 25, "ocr_text_noise": 35}


def text_warnings(chars: Column, words: Column, letter_ratio: Column, replacement_ratio: Column, severe: Column, min_chars: int = 120, min_words: int = 25) -> Column:
    checks = (
        (chars < min_chars, "too_little_text"),
        (words < min_words, "too_few_words"),
        ((chars >= min_chars) & (letter_ratio < 0.2), "low_text_density"),
        (replacement_ratio > 0.01, "encoding_noise"),
        (severe, "ocr_text_noise"),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(w)) for c, w in checks)))


def penalty(warnings: Column, prices: dict[str, int]) -> Column:
    """100 less the price of each warning, from 0 to 100."""
    cost = F.lit(0)
    for w, p in prices.items():
        cost = cost + F.when(F.array_contains(warnings, w), p).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost))


def match_text(value: Column) -> Column:
    """Lower case, ё as е, runs of anything but letters and digits as one blank, trimmed."""
    t = F.translate(F.lower(F.coalesce(value, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def match_tokens(value: Column) -> Column:
    """Distinct tokens of two or more characters that aren't stop words."""
    parts = F.split(match_text(value), " ")
    return F.array_distinct(F.array_except(F.filter(parts, lambda t: F.length(t) >= 2), strings(*STOP_WORDS)))


def transliterate(token: Column) -> Column:
    """Latin spelling of a token with Cyrillic letters, else empty."""
    out = token
    for c, latin in LATIN.items():
        out = F.replace(out, F.lit(c), F.lit(latin))
    return F.when(token.rlike("[а-я]"), out).otherwise("")


def latin_variants(token: Column) -> Column:
    latin = transliterate(token)
    looser = [F.replace(latin, F.lit(a), F.lit(b)) for a, b in (("iya", "ia"), ("iy", "i"), ("iu", "u"), ("yi", "i"))]
    return F.filter(F.array_distinct(F.array(latin, *looser)), lambda v: F.length(v) >= 2)


def token_variants(token: Column) -> Column:
    """The token, its Latin spellings, and both without each ending that it can lose."""
    stems = F.array_compact(
        F.array(*(F.when((F.length(token) - len(e) >= 4) & token.endswith(e), F.substr(token, F.lit(1), F.length(token) - len(e))) for e in ENDINGS))
    )
    bases = F.concat(F.array(token), stems)
    return F.array_distinct(F.concat(bases, F.flatten(F.transform(bases, latin_variants))))


def fuzzy_score(left: Column, right: Column) -> Column:
    """1 if equal, 0.7 if one contains the other, else the Jaccard overlap of their tokens of three or more characters."""
    a, b = F.lower(js_trim(F.coalesce(left, F.lit("")))), F.lower(js_trim(F.coalesce(right, F.lit(""))))
    parts = lambda v: F.array_distinct(F.filter(F.split(v, r"[\s,./-]+"), lambda t: F.length(t) > 2))
    x, y = parts(a), parts(b)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.7)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(jaccard)
    )


def truncate_text(text: Column, limit: int = 400) -> Column:
    """(text, truncated): cut to limit characters and an ellipsis; a limit of 0 keeps all."""
    value = F.coalesce(text, F.lit(""))
    long = F.length(value) > limit if limit else F.lit(False)
    return F.struct(F.when(long, F.concat(F.substr(value, F.lit(1), F.lit(limit)), F.lit("…"))).otherwise(value).alias("text"), long.alias("truncated"))


def collapse_html(html: Column) -> Column:
    """Tags as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "), r"\s+", " "))


def chat_title(text: Column, limit: int = 72) -> Column:
    """One line without quotes at its ends, cut to limit characters."""
    t = F.regexp_replace(collapse_html(text), "^[\"'«»“”`]+|[\"'«»“”`.]+$", "")
    return F.substr(F.trim(t), F.lit(1), F.lit(limit))


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun that goes with a number."""
    m = F.abs(n)
    return F.when((m % 10 == 1) & (m % 100 != 11), one).when((m % 10).between(2, 4) & ~(m % 100).between(12, 14), few).otherwise(many)


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .otherwise(F.format_string("%.1f GB", n / 1024**3))
    )
