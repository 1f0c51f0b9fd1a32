"""Redaction of credentials and private paths in strings, and in any nested value by its schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns and what replaces them, in order.
RULES = (
    (r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
    (r"""(?i)api[_-]?key["'\s:=]+[^"',\s]+""", "apiKey=[redacted]"),
    (r"//[^/@\s:]+:[^/@\s]+@", "//[redacted]@"),
    (r"(?i)([?&](?:token|access_token|api_key|key|id)=)[^&\s#]+", "$1[redacted]"),
    (r"(/d/)([a-zA-Z0-9_-]{8,})", "$1[redacted]"),
)
SECRET_KEYS = ("apiKey", "api_key", "token", "authToken", "password", "secret", "authorization")
URL_KEYS = ("url", "href", "baseUrl")


def redact(text: Column, home: str | None = None) -> Column:
    """Bearer tokens, API keys, user info and tokens in URLs, document ids, then the home folder; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, "(?i)" + re.escape(home.lower()), "[home]") if home else out


def redact_line(text: Column, home: str | None = None) -> Column:
    """The last six lines, redacted."""
    lines = F.split(redact(text, home), r"\r?\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - 5, F.lit(1)), 6), "\n")


def mask_path(path: Column) -> Column:
    """File name and the first eight digits of the path's SHA-256; empty stays empty."""
    p = F.trim(F.coalesce(path, F.lit("")))
    return F.when(p == "", "").otherwise(F.concat(F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1), F.lit("#"), F.substr(F.sha2(p, 256), F.lit(1), F.lit(8))))


def sanitized(value: Column, kind: T.DataType, name: str = "", mask_paths: bool = False) -> Column:
    """A value of any type with its strings redacted, keys that hold secrets blanked, and paths masked if asked."""
    if name in SECRET_KEYS:
        return F.lit("[redacted]")
    if isinstance(kind, T.StringType):
        clean = redact(value)
        if mask_paths:
            path = mask_path(value)
            clean = path if name == "path" else F.when(value.rlike(r"[\\/]"), path).otherwise(clean)
        return F.when(value.isNotNull(), clean)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitized(x, kind.elementType, "", mask_paths))
    if isinstance(kind, T.StructType):
        inner = F.struct(*(sanitized(value[f.name], f.dataType, f.name, mask_paths).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(k.isin(*SECRET_KEYS), F.lit("[redacted]")).otherwise(sanitized(v, kind.valueType, "", mask_paths)))
    return value


def sanitize_frame(df: DataFrame, mask_paths: bool = False) -> DataFrame:
    return df.select(*(sanitized(F.col(f"`{f.name}`"), f.dataType, f.name, mask_paths).alias(f.name) for f in df.schema.fields))
