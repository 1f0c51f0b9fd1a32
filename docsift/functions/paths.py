"""Paths: names, extensions, glob filters, containment."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EXCLUDED_FOLDERS = (".git", "node_modules", "data", "dist", "build", ".cache", ".venv", "__pycache__", "tmp", "temp")
SUPPORTED = (".txt", ".md", ".markdown", ".csv", ".log", ".docx", ".xlsx", ".xlsm", ".xls", ".pdf")


def base_name(path: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), r"[\\/]"), lambda p: p != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))


def extension(path: Column) -> Column:
    """From the name's last dot, lower-case; empty for none or for a name that starts with its only dot."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*(\.[^.]+)$|^[^.](\.[^.]+)$", 1))


def normal_path(path: Column) -> Column:
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.lower(F.regexp_replace(F.regexp_replace(p, "^/+", ""), "/+", "/"))


def _normal(pattern: str) -> str:
    return re.sub("/+", "/", pattern.strip().replace("\\", "/").lstrip("/")).lower()


def glob_regex(pattern: str) -> str:
    """``**/`` is any folders or none, ``**`` anything, ``*`` and ``?`` stay within a name."""
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", _normal(pattern))
    return "^" + "".join(steps.get(p) or re.escape(p) for p in parts) + "$"


def _any(path: Column, patterns: list[str]) -> Column:
    tests = []
    for p in filter(None, map(_normal, patterns)):
        tests.append(path.rlike(glob_regex(p)) if re.search("[*?]", p) else F.contains(path, F.lit(p)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def included(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits; without patterns everything is included."""
    patterns = [p for p in patterns if p.strip()]
    return _any(normal_path(path), patterns) if patterns else F.lit(True)


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits, or a folder is one of the usual ones that hold no documents."""
    p = normal_path(path)
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, EXCLUDED_FOLDERS))) | _any(p, patterns)


def inside(root: Column, path: Column) -> Column:
    """Whether a path is a root or lies within it; neither may climb."""
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/+$", "")
    return (root != "") & (path != "") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)") & ((clean(path) == clean(root)) | clean(path).startswith(F.concat(clean(root), F.lit("/"))))


def file_class(path: Column, include: list[str], exclude: list[str]) -> Column:
    """temporary, excluded, unsupported or eligible, in this order."""
    name = base_name(path)
    return (
        F.when(name.startswith("~$") | name.startswith("._") | F.lower(name).endswith(".tmp"), "temporary")
        .when(excluded(path, exclude) | ~included(path, include), "excluded")
        .when(~extension(path).isin(*SUPPORTED), "unsupported")
        .otherwise("eligible")
    )


def file_id(source_id: Column, path: Column) -> Column:
    return F.sha1(F.concat_ws(":", source_id, F.lower(path)))


def short_id(prefix: str, path: Column) -> Column:
    return F.concat(F.lit(prefix), F.substr(F.sha1(F.lower(path)), F.lit(1), F.lit(10)))


def point_id(chunk_id: Column) -> Column:
    """A UUID (version 5 form) from the SHA-256 of an id."""
    h = F.sha2(chunk_id, 256)
    s = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    variant = F.lower(F.hex((F.conv(s(17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", s(1, 8), s(9, 4), F.concat(F.lit("5"), s(14, 3)), F.concat(variant, s(19, 2)), s(21, 12))
