"""Answers of model services, read tolerantly, names of models, and maps merged key by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROW = "struct<index:string,id:string,document:struct<index:string>,relevance_score:string,relevanceScore:string,score:string>"
_MODEL = "struct<id:string,modelKey:string,key:string,path:string,name:string,type:string,object:string,state:string,loaded:boolean>"


def rerank_rows(payload: Column) -> Column:
    """Array of (index, score) of a reranker's JSON answer, best first, equal scores in the answer's order.

    Rows are under results, else under data; the index may be the row's, its document's or its id, and the score has one
    of three names. Rows without a whole index or a finite score are left out; an answer of another shape has none."""
    rows = F.from_json(payload, f"results array<{_ROW}>, data array<{_ROW}>")
    found = F.coalesce(rows["results"], rows["data"], F.array().cast(f"array<{_ROW}>"))
    index = lambda r: F.coalesce(r["index"], r["document"]["index"], r["id"]).try_cast("double")
    score = lambda r: F.coalesce(r["relevance_score"], r["relevanceScore"], r["score"]).try_cast("double")
    read = F.transform(found, lambda r, i: F.struct((-score(r)).alias("minus"), i.alias("place"), index(r).alias("at"), score(r).alias("score")))
    good = F.filter(read, lambda r: (r["at"] == F.floor(r["at"])) & (F.abs(r["score"]) < float("inf")) & ~F.isnan(r["score"]))
    return F.transform(F.array_sort(good), lambda r: F.struct(r["at"].cast("int").alias("index"), r["score"].alias("score")))


def model_rows(payload: Column) -> Column:
    """Array of (id, type, state, loaded) of a service's list of models: under data or models, or the answer itself; an id
    under any of five names, or a bare string. Rows without an id are left out."""
    whole = F.from_json(payload, f"data array<{_MODEL}>, models array<{_MODEL}>")
    listed = F.coalesce(whole["data"], whole["models"], F.from_json(payload, f"array<{_MODEL}>"))
    empty = F.lit("")
    some = lambda r, *names: F.coalesce(*(F.nullif(r[n], empty) for n in names), empty)
    loaded = lambda r: F.coalesce(r["loaded"], F.lit(False)) | (F.coalesce(r["state"], empty) == "loaded")
    state = lambda r: F.coalesce(F.nullif(r["state"], empty), F.when(loaded(r), "loaded").when(r["loaded"] == F.lit(False), "not-loaded"), empty)
    rows = F.transform(listed, lambda r: F.struct(some(r, "id", "modelKey", "key", "path", "name").alias("id"), some(r, "type", "object").alias("type"), state(r).alias("state"), loaded(r).alias("loaded")))
    return F.filter(F.coalesce(rows, F.array().cast("array<struct<id:string,type:string,state:string,loaded:boolean>>")), lambda r: r["id"] != "")


def model_key(name: Column) -> Column:
    """Letters and digits of a name, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def model_base(name: Column) -> Column:
    """The key of a name's last part, without a variant after @."""
    return model_key(F.element_at(F.split(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"@[^/\\]+$", ""), r"[\\/]"), -1))


def quantisation(name: Column) -> Column:
    """The number after @q, 0 without one."""
    return F.coalesce(F.regexp_extract(F.lower(name), r"@q(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def matched_model(wanted: Column, models: Column) -> Column:
    """The model that a setting means: the same name, in any case, by key, else of the variants of its base the one of
    the highest quantisation; empty if there is none. Of equals the first in the list counts."""
    w = F.trim(F.coalesce(wanted, F.lit("")))
    tier = lambda m: (
        F.when(m == w, 0).when(F.lower(m) == F.lower(w), 1).when(model_key(m) == model_key(w), 2).when(~F.contains(w, F.lit("@")) & (model_base(m) == model_base(w)), 3)
    )
    rows = F.transform(models, lambda m, i: F.struct(tier(m).alias("tier"), F.when(tier(m) == 3, -quantisation(m)).otherwise(0.0).alias("minus"), i.alias("place"), m.alias("name")))
    return F.when(w == "", "").otherwise(F.coalesce(F.array_min(F.filter(rows, lambda r: r["tier"].isNotNull() & (r["name"] != "")))["name"], F.lit("")))


def merged_map(left: Column, right: Column) -> Column:
    """Both maps' keys; where both have one, the right's value counts, null too."""
    return F.map_zip_with(left, right, lambda k, a, b: F.when(F.map_contains_key(right, k), b).otherwise(a))


def natural_key(path: Column) -> Column:
    """A key by which names sort as people read them: case aside, ё as е, numbers by their value."""
    parts = F.regexp_extract_all(F.translate(F.lower(F.coalesce(path, F.lit(""))), "ё", "е"), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    padded = lambda p: F.concat(F.lpad(F.length(number(p)).cast("string"), 4, "0"), number(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), padded(p)).otherwise(p)), "")
