"""Titles of HTML pages, and kinds, keys and ids of document links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_CHARS = 160
READ_CHARS = 120_000
_GENERIC = r"(?iu)^(?:google\s+(?:docs|sheets|slides|drive|forms)$|google$|sign in\b|log in\b|access denied\b|error\b|вход(?![\p{L}\p{N}_])|доступ запрещен(?![\p{L}\p{N}_])|ошибка(?![\p{L}\p{N}_]))"
_SUFFIX = r"(?iu)\s+[-–]\s+Google\s+(?:Docs|Sheets|Slides|Drive|Forms|Документы|Таблицы|Презентации|Диск|Формы)\s*$"
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))


def decode_entities(text: Column) -> Column:
    """The usual named entities and numeric ones. What an entity gives isn't decoded once more."""
    parts = F.split(F.regexp_replace(text, r"(?i)&(#x[0-9a-f]{1,6}|#[0-9]{1,7}|amp|apos|gt|lt|nbsp|quot);", "\u0001$1\u0002"), "\u0001")

    def one(part: Column) -> Column:
        name, rest = F.lower(F.substring_index(part, "\u0002", 1)), F.substring_index(part, "\u0002", -1)
        code = F.when(name.startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2)))
        number = code.cast("int")
        utf8 = F.decode(F.unhex(F.concat(F.lpad(F.hex(number), 8, "0"))), "UTF-32")
        known = F.create_map(*(F.lit(x) for k, v in (*_NAMED, ("&amp;", "&")) for x in (k[1:-1], v)))
        char = F.when(number.between(1, 0x10FFFF), utf8).otherwise(F.coalesce(F.try_element_at(known, name), F.lit("")))
        return F.when(F.contains(part, F.lit("\u0002")), F.concat(char, rest)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def clean_title(title: Column) -> Column:
    """Decoded, without tags, on one line, without an office suite's name; null if nothing or nothing telling is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(decode_entities(title), r"<[^>]*>", " "), r"(?U)\s+", " "))
    t = F.trim(F.regexp_replace(t, _SUFFIX, ""))
    return F.when((t != "") & ~t.rlike(_GENERIC), F.substr(t, F.lit(1), F.lit(TITLE_CHARS)))


def html_title(html: Column) -> Column:
    """The first telling title of a page: Open Graph and card titles in order, then the title element; else empty."""
    body = F.substr(F.coalesce(html, F.lit("")), F.lit(1), F.lit(READ_CHARS))
    tags = F.filter(
        F.regexp_extract_all(body, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1)),
        lambda t: t.rlike(r"""(?i)\s(?:property|name)\s*=\s*["']?(?:og:title|twitter:title|title)["'\s/>]"""),
    )
    content = F.transform(tags, lambda t: F.concat(*(F.regexp_extract(t, rf"(?i)\scontent\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s>\"']+)"))))
    titles = F.concat(content, F.array(F.regexp_extract(body, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.get(F.filter(F.transform(titles, clean_title), lambda t: t.isNotNull()), F.lit(0)), F.lit(""))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)


def drive_kind(url: Column) -> Column:
    """spreadsheet, document, folder, drive-file, or unsupported."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host, path = _host(u), F.lower(_path(u))
    docs, drive = host == "docs.google.com", host == "drive.google.com"
    return (
        F.when(docs & F.contains(path, F.lit("/spreadsheets/")), "spreadsheet")
        .when(docs & F.contains(path, F.lit("/document/")), "document")
        .when(drive & F.contains(path, F.lit("/folders/")), "folder")
        .when(drive & (F.contains(path, F.lit("/file/d/")) | u.rlike(r"[?&]id=[^&#]")), "drive-file")
        .otherwise("unsupported")
    )


def folder_id(url: Column) -> Column:
    return F.regexp_extract(_path(F.trim(url)), "(?i)/folders/([^/?#]+)", 1)


def spreadsheet_id(url: Column) -> Column:
    return F.regexp_extract(_path(F.trim(url)), "(?i)/spreadsheets/d/([^/?#]+)", 1)


def dedupe_key(url: Column) -> Column:
    """What makes two links the same: a sheet's id and tab, a document's or file's id, else the address without its fragment."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    sheet, tab = spreadsheet_id(u), F.regexp_extract(u, r"#\??(?:.*&)?gid=([^&]*)", 1)
    doc = F.regexp_extract(_path(u), "/document/d/([^/?#]+)", 1)
    by_path, by_query = F.regexp_extract(_path(u), "/file/d/([^/?#]+)", 1), F.regexp_extract(u, "[?&]id=([^&#]+)", 1)
    file = F.when(by_path != "", by_path).otherwise(by_query)
    plain = F.regexp_replace(u, "#.*$", "")
    return (
        F.when(u == "", "")
        .when(sheet != "", F.concat_ws(":", F.lit("sheet"), sheet, tab))
        .when((_host(u) == "docs.google.com") & (doc != ""), F.concat(F.lit("doc:"), doc))
        .when((_host(u) == "drive.google.com") & (file != ""), F.concat(F.lit("drive:"), file))
        .when(u.rlike("^[a-z][a-z0-9+.-]*://"), F.concat(F.lit("url:"), F.when(plain.rlike("^[a-z]+://[^/]+$"), F.concat(plain, F.lit("/"))).otherwise(plain)))
        .otherwise(u)
    )


def link_id(url: Column) -> Column:
    return F.concat(F.lit("ctx-"), F.substr(F.sha1(F.lower(url)), F.lit(1), F.lit(10)))


def link_kind(kind: Column, url: Column, title: Column) -> Column:
    """The stated kind if it is one, else by words of the address and title."""
    k, t = F.lower(F.trim(F.coalesce(kind, F.lit("auto")))), F.coalesce(title, F.lit(""))
    both = F.lower(F.concat_ws(" ", url, t))
    return (
        F.when(k.isin("doc", "sheet", "kp", "link"), k)
        .when(F.contains(both, F.lit("spreadsheets")), "sheet")
        .when(F.contains(both, F.lit("document")), "doc")
        .when(F.concat_ws(" ", t, url).rlike(r"(?iu)(?:^|[\s_-])kp(?:[\s_.-]|$)|кп"), "kp")
        .otherwise("link")
    )


def fallback_title(url: Column, kind: Column) -> Column:
    host, path = _host(url), _path(url)
    docs = host == "docs.google.com"
    return (
        F.when(docs & F.contains(path, F.lit("/spreadsheets/")), "Google Sheet")
        .when(docs & F.contains(path, F.lit("/document/")), "Google Doc")
        .when(docs & F.contains(path, F.lit("/presentation/")), "Google Slides")
        .when(host == "drive.google.com", "Google Drive")
        .when(kind == "sheet", "Google Sheet")
        .when(kind == "doc", "Google Doc")
        .when(kind == "kp", "KP")
        .otherwise(host)
    )


def file_name(value: Column) -> Column:
    """A name without characters that file systems refuse, on one line, at most 120 characters."""
    return F.substr(F.trim(F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]+', " "), r"\s+", " ")), F.lit(1), F.lit(120))


def disposition_name(header: Column) -> Column:
    """The file name in a Content-Disposition header; the encoded form comes first."""
    encoded = F.regexp_extract(header, "(?i)filename\\*=(?:UTF-8'')?([^;]+)", 1)
    plain = F.regexp_extract(header, '(?i)filename="?([^";]+)"?', 1)
    return F.when(encoded != "", F.try_url_decode(F.trim(encoded))).otherwise(F.trim(plain))
