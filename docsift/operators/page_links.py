"""Links of whole HTML pages: anchors in order, with resolved addresses and labels, by column functions alone.

A page is cut at its anchors' openings, so that work is linear in its length whatever its markup. Comments, scripts and styles
hold no anchors. An anchor's label is its aria-label, else its text up to `</a` or the next anchor; anchors without an
address or a label are left out, and of equal addresses of a page the first one stays.

Defined results: a null page or address is empty; an open comment, script or tag reaches to the page's end; an address that
stays relative because the page's own is none is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.links import decode_entities, dedupe_key, drive_kind

_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\z)"
_ATTRIBUTES = r"""(?s)([^\s=/>"']++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))"""
_TAG = r"""(?s)^((?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def attribute(tag: Column, name: str) -> Column:
    """The first attribute of this name in a tag, decoded and trimmed; null where it has none. Values that look like
    attributes are none."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTES), F.lit(1)), lambda a: F.lower(F.trim(F.substring_index(a, "=", 1))) == name)
    raw = F.regexp_replace(F.get(found, F.lit(0)), r"(?s)^[^=]*=\s*", "")
    quoted = raw.startswith('"') | raw.startswith("'")
    return F.trim(decode_entities(F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)))


def _tag_of(part: Column) -> Column:
    """The rest of a tag whose opening was cut off, to its end outside of quotes, or to any end if a quote is open."""
    whole = F.regexp_extract(part, _TAG, 1)
    loose = F.when(F.contains(part, F.lit(">")), F.concat(F.substring_index(part, ">", 1), F.lit(">"))).otherwise(part)
    return F.when(whole != "", whole).otherwise(loose)


def _without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    dotted = F.get(parts, F.size(parts) - 1).isin(".", "..")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dotted & (F.size(kept) > 0), "/").otherwise(""))


def resolved(href: Column, base: Column) -> Column:
    """An address as seen from a base: whole ones stay, others take the base's scheme, host, folder or page."""
    scheme, origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.substr(page, F.length(origin) + 1)
    asked, bare = F.regexp_extract(base, r"^([^#]*)", 1), F.regexp_extract(href, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
    return (
        F.when(href.rlike(_SCHEME) | (origin == ""), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", asked)
        .when(href.startswith("#"), F.concat(asked, href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(origin, _without_dots(whole), F.substr(href, F.length(bare) + 1)))
    )


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, position, href, url, label, kind, link_key) of each page's anchors; position counts all of its anchors from 0.

    kind is that of a document service's address, or `link`; link_key is what makes two links the same."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _UNSEEN, " ")
    df = pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("_url"), body.alias("_body"))
    stated = attribute(F.regexp_extract("_body", r"(?is)<base(?=[\s/])([^>]*)", 1), "href")
    df = df.withColumn("_base", F.when(F.coalesce(stated, F.lit("")) != "", resolved(stated, F.col("_url"))).otherwise(F.col("_url")))
    # What stands before the first anchor is left out.
    df = df.select(key, "_base", F.posexplode(F.split("_body", r"(?i)<a(?=[\s/>])")).alias("_at", "_part")).filter("_at > 0")
    df = df.withColumn("_tag", _tag_of(F.col("_part")))
    inner = F.get(F.split(F.substr("_part", F.length("_tag") + 1), r"(?i)</a(?=[\s/>]|$)", 2), F.lit(0))
    df = df.withColumns({"href": attribute(F.col("_tag"), "href"), "_aria": attribute(F.col("_tag"), "aria-label"), "_text": decode_entities(F.regexp_replace(inner, r"(?s)<[A-Za-z/!?][^>]*+(?:>|\z)", ""))})
    told = F.when(F.coalesce("_aria", F.lit("")) != "", F.col("_aria")).otherwise(F.col("_text"))
    label = F.trim(F.regexp_replace(told, r"(?U)\s+", " "))
    df = df.filter(F.col("href").isNotNull()).select(key, (F.col("_at") - 1).alias("position"), "href", resolved(F.col("href"), F.col("_base")).alias("url"), label.alias("label")).filter("url <> '' and label <> ''")
    first = df.groupBy(key, "url").agg(F.min(F.struct("position", "href", "label")).alias("_f")).select(key, "_f.position", "_f.href", "url", "_f.label")
    kind = drive_kind(F.col("url"))
    return first.withColumns({"kind": F.when(kind == "unsupported", "link").otherwise(kind), "link_key": dedupe_key(F.col("url"))})
