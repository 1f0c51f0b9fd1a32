"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled to a regular expression over host + path, and filed under that of its complete literal
tokens which the URLs at hand hold least often. A URL's tokens fetch candidate rules, and only those run
their regular expression. All native expressions; the rows aren't shuffled as long as the rules are few enough
to be a literal of the plan (`max_inline`), and are a broadcast index in blocks of checked size beyond that.

Defined results: a null url, or one without ://, has an empty host and path, which no rule fits, and is
allowed; an empty table gives an empty one. Among rules that fit, ties of priority and length go to the greater label. Long
addresses are taken whole. Repeated rows stay as many rows, whatever their ids. Extra columns pass through; those named like
a column that is made, or an internal one (leading underscore), are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import ascii_lower, text_or_empty

#: A token, and what can't stand beside it.
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """pattern: ``||host/path`` fits that host and its subdomains with a path that starts so; without || it may
    stand anywhere in host + path. ``*`` is any text and ``^`` an end or a character outside tokens, ``-`` and ``_``.
    label is what is reported; among the rules that fit, the highest (priority, label's length, label) wins.
    """

    pattern: str
    action: str
    priority: int = 0
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or self.pattern

    def regex(self) -> str:
        anchored = self.pattern.startswith("||")
        body = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9_-]|$)"}.get(c) or re.escape(c) for c in self.pattern.removeprefix("||"))
        return ("^(?:[^/]*\\.)?" if anchored else "") + body

    def tokens(self) -> list[str]:
        """Literal tokens that any fitting URL holds as whole tokens."""
        body = self.pattern.removeprefix("||")
        found = []
        for m in re.finditer(TOKEN, body):
            before, after = body[: m.start()][-1:], body[m.end() :][:1]
            starts = before not in ("", "*") or (before == "" and self.pattern.startswith("||"))
            if starts and after not in ("", "*"):
                found.append(m.group())
        return list(dict.fromkeys(found))


def prefix_rule(host: str, path: str, action: str) -> UrlRule:
    return UrlRule(f"||{host}{path}", action, 1, f"{host}{path}")


#: Fixed by the contract of op2.
PREFIX_RULES = (
    prefix_rule("com", "/en/", "block"),
    prefix_rule("example.com", "/en/7", "allow"),
    prefix_rule("net", "/de/", "allow"),
    prefix_rule("example.net", "/de/8", "block"),
    prefix_rule("org", "/es/", "block"),
)
#: What decides where no prefix rule fits.
PATTERN_RULES = (
    UrlRule("spam-farm.", "block"),
    UrlRule("||spam-farm^", "block"),
    UrlRule("/ads/", "block"),
    UrlRule("/casino/", "block"),
    UrlRule("/tracking/*.gif", "block"),
    UrlRule("/doubleclick/", "block"),
)


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    address = text_or_empty(F.col(url))
    rest = F.when(F.contains(address, F.lit("://")), F.substr(address, F.locate("://", address) + 3)).otherwise(F.lit(""))
    return df.withColumns(
        {
            "host": ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(target, F.lit(TOKEN), F.lit(0)))


def rarest_tokens(df: DataFrame, target: Column, rules: tuple[UrlRule, ...]) -> dict[UrlRule, str | None]:
    """The index key of each rule: of its tokens the one in fewest of the rows; None if it has no whole token.

    One pass over the rows; what reaches the driver is a count for each token of the rules."""
    known = sorted({t for r in rules for t in r.tokens()})
    if not known:
        return dict.fromkeys(rules)
    wanted = F.array_intersect(_tokens(target), F.array(*map(F.lit, known)))
    counts = {r["t"]: r["count"] for r in df.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()}
    return {r: min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...], url: str = "url", max_inline: int = 2000, key: str | None = None) -> DataFrame:
    """Add host, path and `match`, the struct (priority, size, name, action) of the winning rule, or null.

    Up to max_inline rules are a literal of the plan, more are a broadcast index; the results are the same. key isn't
    needed, as a match depends on the address alone."""
    df = with_url_parts(df, url)
    df = df.withColumn("_target", F.concat("host", "path"))
    keys = rarest_tokens(df, F.col("_target"), rules)
    shape = "struct<priority:int,size:int,name:string,action:string,regex:string>"
    as_struct = lambda r: F.struct(F.lit(r.priority).alias("priority"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex()).alias("regex")).cast(shape)
    if len(rules) > max_inline:
        return _judge_by_join(df, keys, shape)
    filed: dict[str, list[UrlRule]] = {}
    for r, t in keys.items():
        filed.setdefault(t or "", []).append(r)
    unfiled = [as_struct(r) for r in filed.pop("", [])]
    index = F.create_map(*(x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(as_struct, rs))))) if filed else None
    none = F.array().cast(f"array<{shape}>")
    fetched = none
    if index is not None:
        held = F.array_intersect(_tokens(F.col("_target")), F.array(*map(F.lit, sorted(filed))))
        fetched = F.flatten(F.transform(held, lambda t: F.try_element_at(index, t)))
    candidates = F.concat(fetched, F.array(*unfiled) if unfiled else none)
    df = df.withColumn("_rules", candidates)
    fitting = F.filter("_rules", lambda r: F.rlike(F.col("_target"), r["regex"]))
    return df.withColumn("match", F.array_max(fitting)).drop("_rules", "_target")


def _blocks(rows: list[tuple], max_bytes: int) -> list[list[tuple]]:
    """The rows cut into lists of about max_bytes of text."""
    out, size = [], max_bytes
    for r in rows:
        own = sum(len(x.encode()) for x in r if isinstance(x, str))
        if size + own > max_bytes:
            out.append([])
            size = 0
        out[-1].append(r)
        size += own
    return out


def _judge_by_join(df: DataFrame, keys: dict[UrlRule, str | None], shape: str, max_bytes: int = 8 << 20) -> DataFrame:
    """As above, with the index as tables of at most max_bytes of rules each, broadcast, so that no token gathers its
    URLs in one place. Each different address is judged once; rows get their address's match by a join on its reverse,
    so that both sides have exchanges which adaptive execution may split."""
    columns = "_token string, priority int, size int, name string, action string, regex string"
    rows = [(t, r.priority, len(r.name), r.name, r.action, r.regex()) for r, t in keys.items()]
    targets = df.select("_target").distinct()
    tokens = targets.select("_target", F.explode(_tokens(F.col("_target"))).alias("_token"))
    parts = []
    for block in _blocks([r for r in rows if r[0] is not None], max_bytes):
        parts.append(tokens.join(F.broadcast(df.sparkSession.createDataFrame(block, columns)), "_token"))
    for block in _blocks([r for r in rows if r[0] is None], max_bytes):  # a stated set of rules that no token files
        parts.append(targets.crossJoin(F.broadcast(df.sparkSession.createDataFrame(block, columns))))
    fitting = None
    for p in parts:
        p = p.filter(F.rlike("_target", F.col("regex"))).select("_target", F.struct("priority", "size", "name", "action", "regex").cast(shape).alias("_m"))
        fitting = p if fitting is None else fitting.unionByName(p)
    best = fitting.groupBy("_target").agg(F.max("_m").alias("match")).select(F.reverse("_target").alias("_turned"), "match")
    return df.drop("match", "_turned").withColumn("_turned", F.reverse("_target")).join(best, "_turned", "left").drop("_turned", "_target")


def parse_rules(lines: list[str]) -> tuple[UrlRule, ...]:
    """Rules from lines of text: a pattern blocks, @@ before it makes it an exception, which wins over blocks; lines that
    start with ! and empty ones say nothing."""
    out = []
    for line in map(str.strip, lines):
        if line and not line.startswith("!"):
            allow = line.startswith("@@")
            out.append(UrlRule(line.removeprefix("@@"), "allow" if allow else "block", int(allow), line))
    return tuple(dict.fromkeys(out))


def read_rules(spark: SparkSession, path: str) -> tuple[UrlRule, ...]:
    """The rules of a text file, or of a folder of them. Rules are a stated list and are held by the driver."""
    return parse_rules([r["value"] for r in spark.read.text(path).orderBy("value").collect()])


def op2_url_filter(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, the prefix rule that decided (or null), verdict, and the pattern rule, if one did."""
    judged = judge_urls(pages.select("page_id", "url"), PREFIX_RULES + PATTERN_RULES)
    by_prefix = F.col("match.priority") == 1
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(by_prefix, F.col("match.name")).alias("rule"),
        F.coalesce(F.col("match.action"), F.lit("allow")).alias("verdict"),
        F.when(F.col("match.priority") == 0, F.col("match.name")).alias("pattern_rule"),
    )
