"""Matching questions, folders and tenders to sources; scope expansion; ownership of files by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.paths import base_name, inside
from docsift.functions.text import fuzzy_score, js_trim, match_text, match_tokens, token_variants
from docsift.operators.likeness import alike


def source_profiles(sources: DataFrame) -> DataFrame:
    """Add title and full texts and tokens, and the variants of the tokens. sources: source_id, title, path."""
    title = F.concat_ws(" ", F.coalesce("title", F.lit("")), base_name(F.col("path")))
    df = sources.withColumn("_title", title).withColumn("_full", F.concat_ws(" ", "_title", F.coalesce("path", F.lit(""))))
    df = df.withColumns({"title_text": match_text(F.col("_title")), "full_text": match_text(F.col("_full")), "title_tokens": match_tokens(F.col("_title")), "full_tokens": match_tokens(F.col("_full"))})
    variants = lambda c: F.array_distinct(F.flatten(F.transform(c, token_variants)))
    return df.withColumns({"title_variants": variants("title_tokens"), "full_variants": variants("full_tokens")}).drop("_title", "_full")


def token_score(token: Column, variants: Column) -> Column:
    """How much one token of a question says for a source's profile."""
    long = F.length(token) >= 4
    title = F.when(F.array_contains("title_tokens", token), 5.0).when(F.arrays_overlap(variants, F.col("title_variants")), 4.5).when(long & F.contains("title_text", token), 3.0).otherwise(0.0)
    full = F.when(F.array_contains("full_tokens", token), 1.5).when(F.arrays_overlap(variants, F.col("full_variants")), 1.25).when(long & F.contains("full_text", token), 0.75).otherwise(0.0)
    return title + full


def match_sources(questions: DataFrame, sources: DataFrame, block: int = 100_000) -> DataFrame:
    """(question_id, source_id, score, matched_tokens, rank, confident) of every source that a question scores for.

    sources is the catalogue. It is counted and dealt into blocks of at most `block` rows, each sent to the questions'
    distinct tokens; what is found goes to the questions by an equi-join on the token."""
    blocks = max(1, -(-sources.count() // block))
    profiles = source_profiles(sources.filter("source_id is not null and path is not null"))
    asked = questions.select("question_id", F.explode(match_tokens(F.col("question"))).alias("token"))
    tokens = asked.select("token").distinct().withColumn("_v", token_variants(F.col("token")))
    scored = None
    for i in range(blocks):
        own = profiles if blocks == 1 else profiles.filter(F.pmod(F.xxhash64("source_id"), F.lit(blocks)) == i)
        part = tokens.crossJoin(F.broadcast(own)).select("token", "source_id", token_score(F.col("token"), F.col("_v")).alias("s")).filter("s > 0")
        scored = part if scored is None else scored.unionByName(part)
    found = asked.join(scored, "token").groupBy("question_id", "source_id").agg(F.sum("s").alias("score"), F.sort_array(F.collect_set("token")).alias("matched_tokens"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc(F.size("matched_tokens")), "source_id")
    df = found.withColumn("rank", F.row_number().over(order).cast("long"))
    next_score, next_size = F.lead("score").over(order), F.lead(F.size("matched_tokens")).over(order)
    sure = (F.col("rank") == 1) & (F.col("score") >= 5) & (next_score.isNull() | (F.col("score") >= next_score + 1.5) | (F.size("matched_tokens") > next_size))
    return df.withColumn("confident", sure)


def scope_expansion(sources: DataFrame) -> DataFrame:
    """(source_id, member_id): a source itself and, for a contract, each tender linked to it."""
    own = sources.select("source_id", F.col("source_id").alias("member_id"))
    contracts = sources.filter("source_type = 'contract'").select("source_id")
    linked = sources.filter("source_type = 'tender'").select(F.trim("linked_contract_id").alias("source_id"), F.col("source_id").alias("member_id"))
    return own.unionByName(linked.join(contracts, "source_id", "left_semi").select("source_id", "member_id")).distinct()


def with_contract_title(sources: DataFrame) -> DataFrame:
    contracts = sources.filter("source_type = 'contract'").select(F.col("source_id").alias("linked_contract_id"), F.col("title").alias("contract_title"))
    return sources.join(contracts, "linked_contract_id", "left")


def owned_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, source_id, owner_id, how): by the id that a file names, else by the longest of its folders that is a root.

    Files whose source is gone are joined on each of their ancestor folders, an equi-join, not on a prefix test."""
    ids = sources.select(F.col("source_id").alias("_id"))
    live = files.join(ids, files["source_id"] == ids["_id"], "left_semi").select("file_id", "source_id", F.col("source_id").alias("owner_id"), F.lit("id").alias("how"))
    lost = files.join(ids, files["source_id"] == ids["_id"], "left_anti")
    parts = F.split("path", "/")
    lost = lost.select("file_id", "source_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    roots = sources.select(F.col("source_id").alias("owner_id"), F.explode(F.array_distinct(F.concat(F.array("path"), F.coalesce("additional_paths", F.array().cast("array<string>"))))).alias("root")).filter("root <> ''")
    roots = roots.withColumn("root", F.regexp_replace("root", "/+$", ""))
    found = lost.join(roots, "root").groupBy("file_id", "source_id").agg(F.max_by("owner_id", F.struct(F.length("root"), F.col("owner_id"))).alias("owner_id"))
    return live.unionByName(found.withColumn("how", F.lit("path")))


def expanded_ids(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, source_id): ids under which a live source's files are stored, stale ones included."""
    return owned_files(files, sources).select("owner_id", "source_id").unionByName(sources.select(F.col("source_id").alias("owner_id"), "source_id")).distinct()


def path_guard(root: Column, path: Column) -> Column:
    return inside(root, path)


def match_tenders(tenders: DataFrame, sources: DataFrame, min_score: float = 0.55) -> DataFrame:
    """(tender_id, source_id, strategy, score, confidence): by id, contract link, number, then likeness of titles.

    The first three are equi-joins. Only tenders that none of them matched meet sources of a like title or address: pairs
    of different strings by selective keys (`operators/likeness`), a string that many rows have being one. min_score is at
    most 0.7."""
    t = tenders.select("tender_id", "linked_contract_id", *(F.lower(js_trim(F.coalesce(c, F.lit("")))).alias(c) for c in ("tender_number", "title", "object_address")))
    s = sources.filter("source_type = 'tender'").select("source_id", "hub_tender_id", F.col("linked_contract_id").alias("s_contract"), F.lower(js_trim(F.coalesce("title", F.lit("")))).alias("s_title"), F.lower(js_trim(F.coalesce("object_address", F.lit("")))).alias("s_address"))
    shape = lambda df, how, score, tier: df.select("tender_id", "source_id", F.lit(how).alias("strategy"), score.cast("double").alias("score"), F.lit(tier).alias("tier"))
    by_id = shape(t.join(s, t["tender_id"] == s["hub_tender_id"]), "hub_tender_id", F.lit(1.0), 1)
    by_link = shape(t.filter("linked_contract_id <> ''").join(s, F.col("linked_contract_id") == F.col("s_contract")), "linked_contract_id", F.lit(0.95), 2)
    number = F.regexp_extract("s_title", r"^([^. ]*)", 1)
    heads = F.array_distinct(F.array(F.col("s_title"), number))
    numbered = s.withColumn("_n", F.explode(heads)).filter("_n <> ''")
    by_number = shape(t.filter("tender_number <> ''").join(numbered, F.col("tender_number") == F.col("_n")), "tender_number", F.when((F.col("title") != "") & F.contains("s_title", F.col("title")), 0.92).otherwise(0.85), 3)
    exact = by_id.unionByName(by_link).unionByName(by_number)
    first = exact.groupBy("tender_id").agg(F.min(F.struct("tier", "source_id", "strategy", "score")).alias("m")).select("tender_id", F.col("m.source_id").alias("source_id"), F.col("m.strategy").alias("strategy"), F.col("m.score").alias("score"))
    rest = t.join(first, "tender_id", "left_anti")
    # A mean of two likenesses is below min_score where both are. Rows that look alike meet once.
    looks = rest.select("title", "object_address").distinct()
    theirs = s.groupBy("s_title", "s_address").agg(F.min("source_id").alias("source_id"))
    values = lambda df, c: df.select(F.col(c).alias("value"))
    titles = alike(values(looks, "title"), values(theirs, "s_title"), min_score).select(F.col("a").alias("title"), F.col("b").alias("s_title"))
    addresses = alike(values(looks, "object_address"), values(theirs, "s_address"), min_score).select(F.col("a").alias("object_address"), F.col("b").alias("s_address"))
    untold, told = looks.filter("object_address = ''"), looks.filter("object_address <> ''")
    by_title = theirs.groupBy("s_title").agg(F.min("source_id").alias("source_id")).withColumn("s_address", F.lit(""))
    columns = ["title", "object_address", "s_title", "s_address", "source_id"]
    met = untold.join(titles, "title").join(by_title, "s_title").select(columns)
    for df in (told.join(titles, "title").join(theirs, "s_title"), told.join(addresses, "object_address").join(theirs, "s_address")):
        met = met.unionByName(df.select(columns))
    likeness = fuzzy_score(F.col("title"), F.col("s_title"))
    likeness = F.when(F.col("object_address") != "", (likeness + fuzzy_score(F.col("object_address"), F.col("s_address"))) / 2).otherwise(likeness)
    best = met.withColumn("score", likeness).groupBy("title", "object_address").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("source_id"))).alias("m"))
    fuzzy = rest.join(best, ["title", "object_address"])
    fuzzy = fuzzy.select("tender_id", F.col("m.source_id").alias("source_id"), F.lit("title_fuzzy").alias("strategy"), (-F.col("m.minus")).alias("score")).filter(F.col("score") >= min_score)
    out = tenders.select("tender_id").join(first.unionByName(fuzzy), "tender_id", "left")
    confidence = F.when(F.col("strategy").isNull(), "none").when(F.col("strategy") == "hub_tender_id", "exact").when((F.col("strategy") == "title_fuzzy") & (F.col("score") < 0.75), "medium").otherwise("high")
    return out.withColumns({"strategy": F.coalesce("strategy", F.lit("unmatched")), "score": F.coalesce("score", F.lit(0.0)), "confidence": confidence})


def resolve_links(folders: DataFrame, manual: DataFrame, contracts: DataFrame, selected: DataFrame, auto: DataFrame, auto_categories: list[str]) -> DataFrame:
    """The contract of each tender folder: manual mapping, then an existing link, then a selected one, then a confident match.

    folders: tender_id, folder, category, path, linked_contract_id; manual and selected: tender_id, contract_id;
    auto: tender_id, contract_id of confident matches."""
    known = contracts.select(F.col("source_id").alias("_known"))
    pick = lambda df, name: df.join(known, df["contract_id"] == known["_known"], "left").groupBy("tender_id").agg(F.first("contract_id").alias(f"{name}_id"), F.max(F.col("_known").isNotNull()).alias(f"{name}_ok"))
    df = folders.join(pick(manual, "manual"), "tender_id", "left").join(pick(selected, "selected"), "tender_id", "left").join(auto.select("tender_id", F.col("contract_id").alias("auto_id")), "tender_id", "left")
    linked, open_ = F.coalesce("linked_contract_id", F.lit("")) != "", F.col("category").isin(auto_categories)
    source = (
        F.when(F.col("manual_ok"), "manual")
        .when(linked, "existing")
        .when(F.col("manual_id").isNotNull(), "manual-missing")
        .when(~open_, "none")
        .when(F.col("selected_ok"), "selected")
        .when(F.col("selected_id").isNotNull(), "selected-missing")
        .when(F.col("auto_id").isNotNull(), "auto")
        .otherwise("none")
    )
    df = df.withColumn("link_source", source)
    contract = F.when(source == "manual", F.col("manual_id")).when(source == "existing", F.col("linked_contract_id")).when(source == "selected", F.col("selected_id")).when(source == "auto", F.col("auto_id")).otherwise("")
    return df.select("tender_id", "folder", "category", contract.alias("contract_id"), "link_source")


def plan_totals(plan: DataFrame) -> DataFrame:
    kinds = ("manual", "existing", "selected", "auto", "none", "manual-missing", "selected-missing")
    return plan.agg(F.count("*").alias("folders"), *(F.count_if(F.col("link_source") == k).alias(k.replace("-", "_")) for k in kinds))


def new_links(candidates: DataFrame, existing: DataFrame, key: Column, by: str = "source_id") -> DataFrame:
    """Candidate links of each source whose key it doesn't have yet, each key once (the first by url)."""
    c, e = candidates.withColumn("link_key", key).filter("link_key <> ''"), existing.withColumn("link_key", key).select(by, "link_key").distinct()
    fresh = c.join(e, [by, "link_key"], "left_anti")
    return fresh.groupBy(by, "link_key").agg(F.min("url").alias("url"))
