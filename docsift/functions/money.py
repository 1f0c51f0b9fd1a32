"""Amounts as decimals: parsing with truncation, comparison within a tolerance, price mentions in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.arrays import let, prefix_sums

SCALE = 6
DECIMAL = "decimal(38,6)"
#: White space of any kind, as members of a character class: no-break spaces, which usually group digits, are among it.
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Currency words around a number, a price after its label, and a number that may have a currency.
_CURRENCY = r"(?iu)(?:^|[^\p{L}\p{N}])(?:руб\.?|рубл\p{L}*)(?:[^\p{L}\p{N}]|$)"
LABELLED = rf"(?iu)(?:цена|стоимость|итого|сумма|расценк\p{{L}}*)[{SPACE}]*[:\-]?[{SPACE}]*(\d[\d{SPACE}]{{0,15}}(?:[,.]\d{{1,6}})?)"
NUMBER = rf"(?iu)(\d[\d{SPACE}]{{0,15}}(?:[,.]\d{{1,6}})?)[{SPACE}]*(?:₽|руб\.?|рубл\p{{L}}*)?"


def money_text(value: Column) -> Column:
    """The number in a string, with exactly six decimals, the rest cut off; null if there is none."""
    raw, plain = F.coalesce(value.cast("string"), F.lit("")), r"^-?\d+(?:\.\d+)?$"
    t = F.translate(F.regexp_replace(raw, rf"^[{SPACE}]+|[{SPACE}]+$", ""), "₽", "")
    t = F.regexp_replace(F.regexp_replace(t, _CURRENCY, ""), rf"[{SPACE}]+", "")
    clean = F.when(raw.rlike(plain), raw).otherwise(F.regexp_replace(t, r"^([^,]*),", "$1."))

    def fixed(t: Column) -> Column:
        part = F.when(F.contains(t, F.lit(".")), F.substring_index(t, ".", -1)).otherwise("")
        return F.when(t.rlike(plain), F.concat(F.substring_index(t, ".", 1), F.lit("."), F.rpad(F.substr(part, F.lit(1), F.lit(SCALE)), SCALE, "0")))

    return let(clean, fixed)


def money(value: Column) -> Column:
    """The same as a decimal; null too if it has over 32 whole digits."""
    return money_text(value).try_cast(DECIMAL)


def compare_money(left: Column, right: Column, percent: float = 1.0) -> Column:
    """left and right: decimals. match, delta, delta_percent (cut to six decimals) and reason."""
    delta = (left - right).cast(DECIMAL)
    base = F.when(right != 0, F.abs(right)).when(left != 0, F.abs(left)).otherwise(F.expr("0.000001").cast(DECIMAL))
    micro = lambda d: (d * F.lit(10**SCALE)).cast("decimal(38,0)")
    tolerance = F.floor(micro(base) * F.lit(round(percent * 10_000)).cast("decimal(10,0)") / F.lit(10**6).cast("decimal(10,0)"))
    match = micro(F.abs(delta)) <= tolerance
    bad = left.isNull() | right.isNull()
    share = F.floor((micro(F.abs(delta)).cast("decimal(28,0)") * F.lit(10**8).cast("decimal(9,0)")).cast("decimal(38,0)") / micro(base).cast("decimal(28,0)"))
    return F.struct(
        F.coalesce(match, F.lit(False)).alias("match"),
        F.when(~bad, delta).alias("delta"),
        F.when(~bad, (share.cast("decimal(30,0)") / F.lit(10**SCALE)).cast(DECIMAL)).alias("delta_percent"),
        F.when(bad, "invalid_input").when(match, "within_tolerance").otherwise("outside_tolerance").alias("reason"),
    )


def match_starts(text: Column, pattern: str) -> Column:
    """Offset of each match: what stands before it is gaps and earlier matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = lambda m: lambda g: F.transform(m, lambda _, i: F.length(F.get(g, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
    return let(found, lambda m: prefix_sums(let(F.split(text, pattern, -1), steps(m))))


def price_mentions(text: Column) -> Column:
    """Array of (amount, label, pattern): labelled prices first, then bare numbers; each amount and label once.

    The label is what stands before the number on its line, within 80 or 100 characters."""
    body = F.coalesce(text, F.lit(""))
    parts = []
    for name, pattern, reach in (("labeled_price", LABELLED, 80), ("currency_number", NUMBER, 100)):
        amounts = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        starts = match_starts(body, pattern)

        def row(amount: Column, start: Column, name: str, reach: int) -> Column:
            left = F.substr(body, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
            label = F.trim(F.element_at(F.split(left, "\n"), -1))
            return F.struct(
                F.regexp_replace(F.regexp_replace(amount, rf"[{SPACE}]+", ""), ",", ".").alias("amount"),
                label.alias("label"),
                F.lit(name).alias("pattern"),
                F.lower(F.regexp_replace(label, rf"[{SPACE}]+", " ")).alias("folded"),
            )

        parts.append(F.zip_with(amounts, starts, (lambda n, r: lambda a, s: row(a, s, n, r))(name, reach)))
    rows = F.filter(F.concat(*parts), lambda r: r["amount"].rlike(r"^\d+(\.\d+)?$") & (F.coalesce(r["amount"].try_cast("double"), F.lit(0.0)) > 0))
    key = lambda r: F.struct(r["amount"], r["folded"])
    return let(rows, lambda all_: let(F.transform(all_, key), lambda keys: F.filter(all_, lambda r, i: F.array_position(keys, key(r)) == i + 1)))
