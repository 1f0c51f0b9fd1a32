"""Price audit: relational price records against amounts in commercial proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.money import DECIMAL, SPACE, compare_money, money_text, price_mentions
from docsift.functions.paths import base_name
from docsift.operators.likeness import contained
from docsift.session import stored

FIELDS = ("total_commercial_material_cost", "total_commercial_work_cost", "material_cost_per_unit", "work_cost_per_unit")


def is_proposal(df: DataFrame) -> Column:
    return (F.col("source_type") == "tender") & (F.coalesce("tender_commercial_proposal", F.lit(False)) | (F.col("tender_document_type") == "commercial_proposal")) & F.coalesce("tender_has_price_signals", F.lit(False))


def tenders_with_registry(tenders: DataFrame, registry: DataFrame) -> DataFrame:
    return tenders.join(registry.select("tender_number", "title", "object_address"), ["tender_number", "title"], "left").fillna("", ["object_address"])


def price_records(items: DataFrame, positions: DataFrame, materials: DataFrame, works: DataFrame) -> DataFrame:
    """Items with their position's costs and the first of material, work and own name."""
    p = positions.select(F.col("id").alias("position_id"), "item_no", "material_cost_per_unit", "work_cost_per_unit")
    m, w = materials.select(F.col("id").alias("material_id"), F.col("name").alias("_m")), works.select(F.col("id").alias("work_id"), F.col("name").alias("_w"))
    df = items.join(p, "position_id", "left").join(m, "material_id", "left").join(w, "work_id", "left")
    zero = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0")).alias(c)
    return df.select(
        "record_id",
        "tender_id",
        F.coalesce("_m", "_w", "description", F.lit("")).alias("position_name"),
        F.coalesce("quote_link", F.lit("")).alias("quote_link"),
        base_name(F.col("quote_link")).alias("supplier"),
        *map(zero, FIELDS),
    )


def comparable(records: DataFrame, keep: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Unpivot the money fields: (keep..., field, value), without empty and "0"."""
    long = records.select(*keep, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(keep, list(fields), "field", "value")
    return long.filter("value is not null and value <> '' and value <> '0'")


def candidates(chunks: DataFrame) -> DataFrame:
    """One row per price mention of each chunk, with its place, supplier (the file's name) and order.

    Chunks are dealt out first: finding mentions costs far more than moving a chunk, and a table may be one row group."""
    return chunks.repartition("chunk_id").select("tender_id", "chunk_id", "path", "title", base_name(F.coalesce("path", "title")).alias("supplier"), F.posexplode(price_mentions(F.col("text"))).alias("ord", "m")).select(
        "tender_id", "chunk_id", "path", "title", "supplier", "ord", F.col("m.amount").alias("amount"), F.col("m.label").alias("label")
    )


def _fold(c: Column) -> Column:
    """Lower case, white space of any kind as one blank, trimmed; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{SPACE}]+", " ")))


#: In the place of a supplier: whichever it is.
_ANY = "\0"


def best_candidates(records: DataFrame, found: DataFrame, guarded: bool = True) -> DataFrame:
    """The best candidate of each record of the same tender, or nulls.

    Linked before positioned before the rest, by score (50 for the quote, 30 for the position, 20 for the supplier),
    then in order. A candidate is linked if its title, path, supplier or label holds the quote's file name, or the
    quote's link holds its supplier (guarded: an empty one proves nothing); it is positioned if its label holds the
    record's position, or that holds the label's first 24 characters. Rows of one record_id are one record.

    Records that look alike are one row, and so are mentions. Which string holds which is found within a tender by that
    piece of the held one which the fewest others have, short ones by a piece of their own length (`operators/likeness`). Of the mentions that a
    link is tied to only the first of each supplier and the first of all count, so records and mentions of one quote
    never meet one by one; the same holds for a tender as a whole. Only positioned pairs are tested each, as the best of
    them may be linked too.

    Not lazy: mentions, and records of tenders that have any, are stored once in the shared folder, as every step starts
    from them; so records are made twice, here and for the result, and mentions once."""
    sides, col = ("tender_id", "_link", "_base", "_own", "_name"), F.col
    hay = F.concat_ws(" ", *(_fold(col(n)) for n in ("title", "path", "supplier", "label")))
    c = found.filter("tender_id is not null").select("tender_id", _fold(col("supplier")).alias("_sup"), _fold(col("label")).alias("_label"), hay.alias("_hay"), F.struct("chunk_id", "ord", "amount", "label").alias("_row"))
    c = stored(c.groupBy("tender_id", "_sup", "_label", "_hay").agg(F.min("_row").alias("_row")).withColumn("_head", F.substr("_label", F.lit(1), F.lit(24))))
    tenders = stored(c.select("tender_id").distinct())
    rows = stored(records.join(tenders, "tender_id", "left_semi").select("record_id", "tender_id", _fold(col("quote_link")).alias("_link"), _fold(base_name(col("quote_link"))).alias("_base"), _fold(col("supplier")).alias("_own"), _fold(col("position_name")).alias("_name")))
    looks = stored(rows.select(*sides).distinct())
    linked, named, labelled = looks.filter("_link <> ''"), looks.filter("_name <> ''"), c.filter("_label <> ''")

    def strings(name: str, *parts: tuple[DataFrame, int, str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.select("tender_id", F.lit(role).alias("role"), col(value).alias(name)) for df, role, value in parts])

    def keyed(held: DataFrame, role: int) -> DataFrame:
        """(tender_id, role, _key of the record's side, _theirs of the mention's), where the record's side is held in `role`."""
        ours = col("role") == role
        return held.select("tender_id", "role", F.when(ours, col("pattern")).otherwise(col("text")).alias("_key"), F.when(ours, col("text")).otherwise(col("pattern")).alias("_theirs"))

    def entry(pool: Column, score: Column, quoted: Column, positioned: Column) -> Column:
        return F.min(F.struct((-pool).alias("pool"), (-score).alias("minus"), "_row.chunk_id", "_row.ord", "_row.amount", "_row.label", quoted.alias("by_quote"), positioned.alias("by_position"))).alias("best")

    # Roles: 0 the quote's file name within a mention, 1 a supplier within the link, 2 the whole tender.
    mentions = lambda role, key: c.select("tender_id", F.lit(role).alias("role"), key.alias("_theirs"), "_sup", "_row")
    quotes = keyed(contained(strings("pattern", (linked, 0, "_base"), (c, 1, "_sup")), strings("text", (c, 0, "_hay"), (linked, 1, "_link")), ("tender_id", "role"), "role", few_patterns=True), 0)
    theirs = mentions(0, col("_hay")).unionByName(mentions(1, col("_sup")).groupBy("tender_id", "role", "_theirs", "_sup").agg(F.min("_row").alias("_row")))
    tied = quotes.join(theirs, ["tender_id", "role", "_theirs"]).drop("_theirs").unionByName(mentions(2, F.lit("")).withColumnRenamed("_theirs", "_key"))
    if not guarded:  # an empty file name is in every mention, an empty supplier in every link
        nameless = c.filter("_sup = ''").groupBy("tender_id").agg(F.min("_row").alias("_row"))
        links = linked.select("tender_id", "_link").distinct().join(nameless, "tender_id")
        tied = tied.unionByName(mentions(0, F.lit("")).withColumnRenamed("_theirs", "_key")).unionByName(links.select("tender_id", F.lit(1).alias("role"), col("_link").alias("_key"), F.lit("").alias("_sup"), "_row"))
    first = tied.withColumn("_whose", F.explode(F.array_compact(F.array(F.nullif("_sup", F.lit("")), F.lit(_ANY))))).groupBy("tender_id", "role", "_key", "_whose").agg(F.min("_row").alias("_row"))
    ask = lambda role, key: F.struct(F.lit(role).alias("role"), key.alias("_key"))
    asks = F.array_compact(F.array(F.when(col("_link") != "", ask(0, col("_base"))), F.when(col("_link") != "", ask(1, col("_link"))), ask(2, F.lit(""))))
    asked = looks.withColumn("_ask", F.explode(asks)).withColumn("_whose", F.explode(F.array_compact(F.array(F.nullif("_own", F.lit("")), F.lit(_ANY))))).select(*sides, "_ask.*", "_whose")
    by_quote, by_name = col("role") < 2, F.when(col("_whose") == _ANY, 0).otherwise(20)
    by_key = asked.join(first, ["tender_id", "role", "_key", "_whose"]).groupBy(*sides).agg(entry(F.when(by_quote, 2).otherwise(0), F.when(by_quote, 50).otherwise(0) + by_name, by_quote, F.lit(False)))

    # Roles: 0 the position within a label, 1 a label's head within the position.
    positions = keyed(contained(strings("pattern", (named, 0, "_name"), (labelled, 1, "_head")), strings("text", (labelled, 0, "_label"), (named, 1, "_name")), ("tender_id", "role"), "role", few_patterns=True), 0)
    of = lambda role, key: labelled.select("tender_id", F.lit(role).alias("role"), col(key).alias("_theirs"), "_sup", "_hay", "_row")
    met = positions.join(of(0, "_label").unionByName(of(1, "_head")), ["tender_id", "role", "_theirs"]).withColumnRenamed("_key", "_name").join(named, ["tender_id", "_name"])
    some = lambda x: F.lit(True) if not guarded else x != ""
    quote = (col("_link") != "") & (F.contains("_hay", col("_base")) & some(col("_base")) | F.contains("_link", col("_sup")) & some(col("_sup")))
    own = F.when((col("_own") != "") & (col("_own") == col("_sup")), 20).otherwise(0)
    positioned = met.groupBy(*sides).agg(entry(F.when(quote, 2).otherwise(1), F.when(quote, 80).otherwise(30) + own, quote, F.lit(True)))

    chosen = by_key.unionByName(positioned).groupBy(*sides).agg(F.min("best").alias("best"))
    best = rows.join(chosen, list(sides)).groupBy("record_id").agg(F.min("best").alias("best"))
    return records.join(best, "record_id", "left")


def findings(records: DataFrame, found: DataFrame, percent: float = 1.0, guarded: bool = True) -> DataFrame:
    """(record_id, tender_id, severity, field, db_value, expected_value, delta, confidence, chunk_id).

    Each record meets its best candidate once; then each of its prices that isn't empty or "0" is a row. A record without
    such a price, or without a candidate, gives one row that asks for a review."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS))
    shown = F.filter(fields, lambda v: v["value"].isNotNull() & ~v["value"].isin("", "0"))
    df = best_candidates(records, found, guarded).withColumn("_text", money_text(F.col("best.amount")))
    df = df.select("record_id", "tender_id", "best", "_text", F.posexplode_outer(shown).alias("_i", "_v")).filter("best is not null or _v is null or _i = 0")
    bare, lone = F.col("_v").isNull(), F.col("best").isNull()
    # Only prices that are compared are parsed.
    df = df.withColumn("_own", F.when(~bare & ~lone, money_text(F.col("_v.value"))))
    df = df.withColumn("_c", compare_money(F.col("_own").try_cast(DECIMAL), F.col("_text").try_cast(DECIMAL), percent))
    sure = F.when(bare, 0.2).when(lone, 0.25).when(F.col("best.by_quote"), 0.9).when(F.col("best.by_position"), 0.75).otherwise(0.55)
    both = lambda c: F.when(~bare & ~lone, c)
    return df.filter(bare | lone | ~F.col("_c.match")).select(
        "record_id",
        "tender_id",
        F.when(bare | lone, "needs_review").when(sure >= 0.8, "error").otherwise("warning").alias("severity"),
        F.coalesce("_v.field", F.lit("record")).alias("field"),
        F.when(lone, F.col("_v.value")).otherwise(F.col("_own")).alias("db_value"),
        both(F.col("_text")).alias("expected_value"),
        both(F.col("_c.delta")).alias("delta"),
        sure.alias("confidence"),
        both(F.col("best.chunk_id")).alias("chunk_id"),
    )


def tender_status(found: DataFrame, tenders: DataFrame, has_records: Column, has_chunks: Column) -> DataFrame:
    """The worst severity of each tender; needs_review without records or chunks."""
    worst = found.groupBy("tender_id").agg(F.max(F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)).alias("_w"))
    df = tenders.join(worst, "tender_id", "left")
    status = F.when(~(has_records & has_chunks), "needs_review").when(F.col("_w") == 3, "error").when(F.col("_w") == 2, "warning").when(F.col("_w") == 1, "needs_review").otherwise("ok")
    return df.withColumn("status", status).drop("_w")


def global_totals(found: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: tenders, findings, high, medium, low, needs_review, status. reports: tender_id, needs_review."""
    f = found.agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "high"), ("warning", "medium"), ("needs_review", "low"))))
    r = reports.agg(F.count("*").alias("tenders_checked"), F.count_if("needs_review").alias("_r"))
    status = F.when(F.col("high") > 0, "error").when((F.col("medium") > 0) | (F.col("low") > 0), "warning").when(F.col("needs_review") > 0, "needs_review").otherwise("ok")
    return r.crossJoin(f).withColumn("needs_review", F.col("_r") + F.col("low")).drop("_r").withColumn("status", status)  # one row each


def record_summary(records: DataFrame, n: int = 20) -> DataFrame:
    """Per tender: records, distinct suppliers and quotes, and its first n positions by record."""
    rank = F.row_number().over(Window.partitionBy("tender_id").orderBy("record_id", "position_name"))
    counts = records.groupBy("tender_id").agg(F.count("*").alias("records"), F.countDistinct(F.nullif("supplier", F.lit(""))).alias("suppliers"), F.countDistinct(F.nullif("quote_link", F.lit(""))).alias("quotes"))
    first = records.withColumn("_n", rank).filter(F.col("_n") <= n).groupBy("tender_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "position_name"))), lambda r: r["position_name"]).alias("positions"))
    return counts.join(first, "tender_id", "left")


def remaining(tenders: DataFrame, checkpoint: int, order: str = "ord") -> DataFrame:
    """What an interrupted audit still has to do."""
    return tenders.filter(F.col(order) > checkpoint)
