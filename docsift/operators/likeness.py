"""Joins of likeness between short strings: containment and overlap of token sets, each by selective keys.

Containment: a text that holds a pattern holds each of its pieces of `GRAM` characters, so a pattern looks under that piece
which the fewest texts have; a shorter pattern is a key as a whole, and texts give pieces of just the lengths that such
patterns have. Overlap: tokens are ordered by how many rows have them; two sets of Jaccard overlap t or more share one of
the first n - ceil(t n) + 1 tokens of each, where rare tokens stand, and their sizes and places bound it further. So a word
that all rows have is a key only of rows that have hardly another. Both compare different strings only, each once.

Defined results: null and empty strings have no partner; a string is like itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import fuzzy_score

GRAM = 8


def word_set(value: Column) -> Column:
    """Different tokens of three characters or more of a lower-case string."""
    return F.array_distinct(F.filter(F.split(value, r"[\s,./-]+"), lambda t: F.length(t) > 2))


def _pieces(text: Column, lengths: Column) -> Column:
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def contained(patterns: DataFrame, texts: DataFrame, within: tuple[str, ...] = (), kind: str | None = None, few_patterns: bool = False) -> DataFrame:
    """(within..., pattern, text): which of the texts hold which of the patterns, among rows equal in the columns of
    `within`. patterns: within..., pattern; texts: within..., text.

    kind: a column of `within` of few values, each with lengths of short patterns of its own. few_patterns: a pattern looks
    under that piece which the fewest patterns have, so that texts aren't counted: where each pattern has a piece of its own,
    there are no more candidates than pieces of texts."""
    key = lambda c: F.xxhash64(*within, c).alias("_k")
    p = patterns.select(*within, "pattern").filter("pattern <> ''").distinct().withColumn("_p", F.xxhash64(*within, "pattern"))
    t = texts.select(*within, "text").filter("text <> ''").distinct().withColumn("_t", F.xxhash64(*within, "text"))
    short = F.length("pattern") < GRAM
    # One row, or one for each kind: at most GRAM lengths.
    ways = F.array_union(F.collect_set(F.when(short, F.length("pattern"))), F.array(F.lit(GRAM))).alias("_n")
    sized = t.crossJoin(F.broadcast(p.agg(ways))) if kind is None else t.join(F.broadcast(p.groupBy(kind).agg(ways)), kind)
    held = sized.select("_t", *within, F.explode(_pieces(F.col("text"), F.col("_n"))).alias("_x")).select("_t", key(F.col("_x")))
    asked = p.select("_p", *within, F.explode(F.when(short, F.array("pattern")).otherwise(_pieces(F.col("pattern"), F.array(F.lit(GRAM))))).alias("_x")).select("_p", key(F.col("_x")))
    counts = (asked if few_patterns else held).groupBy("_k").agg(F.count("*").alias("_held"))
    rarest = asked.join(counts, "_k", "left").groupBy("_p").agg(F.min_by("_k", F.struct(F.coalesce("_held", F.lit(0)), F.col("_k"))).alias("_k"))
    pairs = rarest.join(held, "_k").select("_p", "_t").distinct()
    same = [f"_{i}" for i in range(len(within))]
    back = t.select("_t", "text", *(F.col(w).alias(s) for w, s in zip(within, same)))
    met = pairs.join(p, "_p").join(back, "_t").filter(F.contains("text", F.col("pattern")))
    for w, s in zip(within, same):
        met = met.filter(F.col(w).eqNullSafe(F.col(s)))
    return met.select(*within, "pattern", "text")


def overlapping(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b): strings of both sides, in their column `value`, whose word sets have this Jaccard overlap or more."""
    side = lambda df, n: df.select(F.lit(n).alias("side"), "value").distinct()
    both = side(left, 0).unionByName(side(right, 1)).withColumn("words", word_set(F.col("value")))
    words = both.select("side", "value", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("_df"))
    ordered = words.join(counts, "word").groupBy("side", "value", "n").agg(F.array_sort(F.collect_list(F.struct("_df", "word"))).alias("_o"))
    least = F.ceil(threshold * F.col("n") - 1e-9).cast("int")
    heads = ordered.select("side", "value", "n", F.posexplode(F.slice("_o", F.lit(1), F.col("n") - least + 1)).alias("at", "_w")).withColumn("word", F.col("_w.word")).drop("_w")
    of = lambda n, v: heads.filter(F.col("side") == n).select("word", F.col("value").alias(v), F.col("n").alias(f"n_{v}"), F.col("at").alias(f"at_{v}"))
    a, b = F.col("n_a"), F.col("n_b")
    sizes = (b >= threshold * a - 1e-9) & (a >= threshold * b - 1e-9)
    # The first word that both share stands in both heads: no more can match than it and what is behind it.
    behind = 1 + F.least(a - F.col("at_a"), b - F.col("at_b")) - 1
    met = of(0, "a").join(of(1, "b"), "word").filter(sizes & (behind >= threshold / (1 + threshold) * (a + b) - 1e-9)).select("a", "b").distinct()
    x, y = word_set(F.col("a")), word_set(F.col("b"))
    return met.filter(F.size(F.array_intersect(x, y)) >= threshold * F.size(F.array_union(x, y)) - 1e-12)


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): lower-case, trimmed strings of both sides, in their column `value`, whose likeness (1 if equal, 0.7 if one
    holds the other, else their overlap) is the threshold or more. The threshold is above 0 and at most 0.7."""
    if not 0 < threshold <= 0.7:
        raise ValueError("a threshold above 0 and at most 0.7 is needed")
    of = lambda df, name: df.select(F.col("value").alias(name))
    inner = contained(of(left, "pattern"), of(right, "text")).select(F.col("pattern").alias("a"), F.col("text").alias("b"))
    outer = contained(of(right, "pattern"), of(left, "text")).select(F.col("text").alias("a"), F.col("pattern").alias("b"))
    pairs = inner.unionByName(outer).unionByName(overlapping(left, right, threshold)).distinct()
    return pairs.withColumn("score", fuzzy_score(F.col("a"), F.col("b")).cast("double")).filter(F.col("score") >= threshold)
