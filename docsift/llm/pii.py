"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything is a column expression; no row leaves the JVM and nothing is shuffled.

Defined results: a null or empty text has no spans; an empty table gives an empty one. Spans that start together come in
the order of the kinds; spans of different kinds may overlap, those of one kind never do. Texts are taken whole whatever
their length, in time in proportion to it. Extra columns pass through; an input column with
the name of one that is made, or of an internal one (leading underscore), is replaced or dropped. Repeated
rows are scanned like any other row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import spans_text, text_or_empty, find_all

#: Quantifiers are possessive and starts are anchored where this leaves the matches as they are: a long run of
#: digits or letters then costs time in proportion to its length, and Java's matcher doesn't recurse.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Countries by the length of their IBANs, the partial and experimental ones of the registry included.
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE BI",
    18: "DK FK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CM CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "IR IS TR",
    27: "BF BJ CF CG CI DJ FR GA GQ GR IT KM MC MG ML MR NE SM SN TD TG",
    28: "AL AZ BY CY DO GT HN HU LB MA NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_LONG = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())
#: A whole IBAN, as long as its country's are; what follows it, capitals after a blank too, is no part of it.
IBAN = rf"(?:{_LONG})(?![A-Za-z0-9])"
#: Its first four characters. Only these are taken from the text, so that a run which fails mod-97 hides no IBAN in it.
IBAN_HEAD = rf"(?<![A-Z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?={IBAN})[A-Z]{{2}}[0-9]{{2}}"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"


@dataclass(frozen=True)
class Kind:
    """base: prior score of a confirmed span; context: words that raise it when they stand within `near` characters before
    it, or within `after` characters behind it. Kinds that other numbers look like are looked at from both sides."""

    name: str
    regex: str
    base: float
    context: tuple[str, ...]
    required: float = 0.0
    near: int = 48
    after: int = 0
    boost: float = 0.3
    always: bool = field(default=False)


KINDS = (
    Kind("email", EMAIL, 0.7, ("mail", "e-mail", "contact", "write"), always=True),
    Kind("ip", IP, 0.6, ("ip", "host", "server", "addr"), always=True),
    Kind("card", CARD, 0.7, ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"), always=True),
    Kind("phone", PHONE, 0.6, ("tel", "phone", "call", "fax", "mobil"), always=True),
    Kind("iban", IBAN_HEAD, 0.8, ("iban", "account", "bank", "konto", "cuenta", "compte"), required=0.5, after=48),
    Kind("ssn", SSN, 0.3, ("ssn", "social", "security"), required=0.5, after=48),
)
BASE = ("email", "ip", "card", "phone")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """The Luhn checksum of a digit string."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (n - i) % 2 == 1,
            F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int")),
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )
    return (n > 0) & (total % 10 == 0)


def mod97_ok(iban: Column) -> Column:
    """The mod-97 checksum of an IBAN without blanks."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: (acc * F.when(value(F.substr(turned, i, F.lit(1))) > 9, 100).otherwise(10) + value(F.substr(turned, i, F.lit(1)))) % 97,
    )
    return F.length(iban).between(15, 34) & (rest == 1)


def _ip_ok(match: Column) -> Column:
    return F.forall(
        F.split(match, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
        & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"),
    )


def _confirmed(kind: Column, match: Column) -> Column:
    return (
        F.when(kind == "ip", _ip_ok(match))
        .when(kind == "card", luhn_ok(_digits(match)))
        .when(kind == "phone", F.length(_digits(match)).between(9, 15))
        .when(kind == "iban", mod97_ok(F.replace(match, F.lit(" "), F.lit(""))))
        .otherwise(F.lit(True))
    )


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def scan_pii(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, out: str = "pii") -> DataFrame:
    """Add `out`: array of (start, ord, end, kind, score) structs by start, then by the order of `kinds`.

    Scores lie between 0 and 1: a confirmed span starts from its kind's prior, and a context word near it, as far as its
    kind looks, raises the score. Spans of kinds that aren't `always` need their `required` score.
    """
    df = df.withColumn("_text", text_or_empty(F.col(text)))
    guards = {"email": F.contains(F.col("_text"), F.lit("@")), "phone": F.contains(F.col("_text"), F.lit("+")), "ssn": F.contains(F.col("_text"), F.lit("-"))}
    df = find_all(df, "_text", {k.name: (k.regex, guards.get(k.name)) for k in kinds}, "_spans")
    def whole(s: Column) -> Column:
        iban = F.regexp_extract(F.substr(F.col("_text"), s["start"] + 1, F.lit(2 * max(IBAN_COUNTRIES))), f"^{IBAN}", 0)
        fields = [s[c].alias(c) for c in ("kind", "ord", "start")]
        return F.when(s["kind"] == "iban", F.struct(*fields, (s["start"] + F.length(iban)).alias("end"), iban.alias("match"))).otherwise(s)

    df = df.withColumn("_spans", F.transform("_spans", whole))

    def scored(s: Column) -> Column:
        start = F.greatest(s["start"] - _by_kind(s["kind"], {k.name: F.lit(k.near) for k in kinds}), F.lit(0))
        before = F.substr(F.col("_text"), start + 1, s["start"] - start)
        behind = F.substr(F.col("_text"), s["end"] + 1, _by_kind(s["kind"], {k.name: F.lit(k.after) for k in kinds}))
        told = F.rlike(F.lower(F.concat(before, F.lit("\n"), behind)), _by_kind(s["kind"], {k.name: F.lit(rf"\b(?:{'|'.join(k.context)})") for k in kinds}))
        base = _by_kind(s["kind"], {k.name: F.lit(k.base) for k in kinds})
        more = _by_kind(s["kind"], {k.name: F.lit(min(1.0, k.base + k.boost)) for k in kinds})
        return F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), F.when(told, more).otherwise(base).alias("score"))

    least = lambda s: _by_kind(s["kind"], {k.name: F.lit(0.0 if k.always else k.required) for k in kinds})
    kept = F.filter(F.transform(F.filter("_spans", lambda s: _confirmed(s["kind"], s["match"])), scored), lambda s: s["score"] >= least(s))
    return df.withColumn(out, F.array_sort(kept)).drop("_text", "_spans")


def op1_pii(documents: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of the base spans, and all spans."""
    found = scan_pii(documents.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
