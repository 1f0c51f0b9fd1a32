"""Secrets, by an incremental ledger of blobs.

Each historical version of a file is a row with a text; its content address is (sha256, bytes). Equal versions
are one blob, scanned once per rule version; blobs that the ledger holds for this rule version aren't scanned
again. Findings are joined back to every row (path) whose version is that blob. All native expressions.

Defined results: a null text is the empty blob, which has no findings; an empty table gives an empty one. Spans that start
together come in the order of the rules; those of different kinds may overlap. Texts are taken whole whatever their
length. Repeated rows stay as many rows. Extra
columns pass through; those named like a column that is made, or an internal one (leading underscore), are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import find_all, shared_path, spans_text, text_or_empty

RULE_VERSION = "2025-2"


@dataclass(frozen=True)
class Rule:
    """regex finds; keep (of the match) confirms; hint is a literal without which regex can't match."""

    kind: str
    regex: str
    hint: str | None = None


#: Group 2 is what follows the separator; the last alternative of its class is greedy, so the match ends with it.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+"""
#: A private key from its BEGIN line to its END line; one that is cut off runs to the end of the text.
_PEM_NAME = r"(?:[A-Z0-9]+ ){0,4}?PRIVATE KEY(?: BLOCK)?-----"
PEM = rf"-----BEGIN {_PEM_NAME}[\s\S]*?(?:-----END {_PEM_NAME}|\z)"
RULES = (
    Rule("assign", ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", "AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    Rule("slack", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
    Rule("pem", PEM, "-----BEGIN "),
)
BASE = ("assign", "access", "hex")


def _value(match: Column) -> Column:
    """Group 2 of an assignment."""
    return F.regexp_extract(match, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", 1)


def scan_blobs(blobs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, out: str = "findings") -> DataFrame:
    """Add `out`: array of (start, ord, end, kind) structs by start, then by the order of the rules."""
    guards = {r.kind: None if r.hint is None else F.contains(F.col(text), F.lit(r.hint)) for r in rules}
    df = find_all(blobs, text, {r.kind: (r.regex, guards[r.kind]) for r in rules}, "_spans")
    kept = F.filter("_spans", lambda s: (s["kind"] != "assign") | (F.length(_value(s["match"])) >= 6))
    rows = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    return df.withColumn(out, F.array_sort(rows)).drop("_spans")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "blob string, n_bytes int, rule_version string, findings array<struct<start:int,ord:int,end:int,kind:string>>")


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """Add the content address (_blob, _n_bytes) of each version."""
    body = text_or_empty(F.col(text))
    return versions.withColumns({"_blob": F.sha2(body, 256), "_n_bytes": F.octet_length(body)})


#: Unseen addresses up to which they are sent to the texts; beyond it the texts go to them.
FEW = 100_000


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, text: str = "text", rules: tuple[Rule, ...] = RULES, few: int = FEW) -> DataFrame:
    """The ledger's new rows: findings (perhaps none) of each blob that it doesn't hold under this rule version.

    With a ledger, addresses alone are compared with it first. If at most `few` are unseen (counted), they are sent to
    the texts, so that texts of seen blobs are neither moved nor scanned; the rows are the same either way. Copies of a
    blob are merged before the shuffle, so a text with very many copies sends one row per task.
    """
    body = text_or_empty(F.col(text))
    seen = addressed(versions.select(text), text).select("_blob", "_n_bytes", body.alias("_body"))
    keys = ["_blob", "_n_bytes"]
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select(F.col("blob").alias("_blob"), F.col("n_bytes").alias("_n_bytes"))
        unseen = seen.select(*keys).distinct().join(known, keys, "left_anti")
        if unseen.limit(few + 1).count() <= few:
            seen = seen.join(F.broadcast(unseen), keys, "left_semi")
            known = None
    blobs = seen.groupBy(*keys).agg(F.first("_body").alias("_body"))
    if ledger is not None and known is not None:
        blobs = blobs.join(known, keys, "left_anti")
    return scan_blobs(blobs, "_body", rules).select(
        F.col("_blob").alias("blob"), F.col("_n_bytes").alias("n_bytes"), F.lit(rule_version).alias("rule_version"), "findings"
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored ledger, or None where none is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, text: str = "text", rules: tuple[Rule, ...] = RULES, keep_text: bool = True) -> DataFrame:
    """Every version with its `findings`: those of the ledger, and of the blobs that it doesn't hold, scanned now."""
    versions = versions.drop(*(c for c in ("findings", "_key", "_size", "_blob", "_n_bytes") if c != text))
    fresh = update_ledger(versions, ledger, rule_version, text, rules)
    if ledger is not None:
        fresh = fresh.unionByName(ledger.filter(F.col("rule_version") == rule_version).select(*fresh.columns))
    return join_findings(versions, fresh, text, keep_text)


def join_findings(versions: DataFrame, ledger: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every version with the findings that a ledger of one rule version has for its blob.

    Only blobs with findings are joined back, on a turned key, so that each side gets an exchange of its own and
    adaptive execution may split a blob that very many rows share."""
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    found = ledger.filter(F.size("findings") > 0).groupBy("blob", "n_bytes").agg(F.max("findings").alias("findings"))
    found = found.select(F.reverse("blob").alias("_key"), F.col("n_bytes").alias("_size"), "findings")
    rows = addressed(versions, text).withColumns({"_key": F.reverse("_blob"), "_size": F.col("_n_bytes")}).drop("_blob", "_n_bytes")
    rows = rows if keep_text else rows.drop(text)
    return rows.join(found, ["_key", "_size"], "left").withColumn("findings", F.coalesce("findings", none)).drop("_key", "_size")


def redact(text: Column, findings: Column) -> Column:
    """The text with each found span, overlapping ones merged, replaced by [SECRET]."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        cut = F.array(F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("[SECRET]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(findings, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1)))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def op5_secrets(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row per document with its counts, the digest of the base spans, and all spans.

    ledger: the folder of the stored ledger. Blobs that it doesn't hold under RULE_VERSION are scanned and added to it;
    then its findings are joined back. None starts a new one in the shared folder."""
    spark = documents.sparkSession
    versions = documents.select("doc_id", "text")
    path = ledger or shared_path(spark, "ledger")
    update_ledger(versions, read_ledger(spark, path)).write.mode("append").parquet(path)
    found = join_findings(versions, spark.read.parquet(path).filter(F.col("rule_version") == RULE_VERSION), keep_text=False)
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))
