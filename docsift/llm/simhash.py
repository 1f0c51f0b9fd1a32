"""SimHash near-duplicates, with candidates filtered by the pigeonring principle.

Fingerprint: A-Z lower-cased, words between ASCII white space, three-word shingles with repeats, XXH64 (seed 42)
of each; a bit is set if over half of the hashes have it. Two fingerprints link at `3` or fewer differing bits.

Candidates: cut 64 bits, as a ring, into 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, some
segment starts a chain whose first k segments differ in at most floor(3k/8) bits for every k from 1 to 8. So two
whole segments agree and the next three differ in one bit at most, of which one half of 12 bits agrees: 28 equal
bits are the key of a candidate, under 16 keys for each fingerprint. The other links of the chain are checked in
the join, before the full distance. Where more than `cap` different fingerprints share a key (a group of many near
copies), its members are dealt anew: the bits not yet fixed hold at most three differences, so of four parts one
agrees, which makes a longer key; and so on until keys leave so few bits free that few fingerprints can share one.
No link is lost by that, and no bucket makes more than its share of pairs.

Equal fingerprints are one node from the start. Components come from alternating large-star and small-star steps
on the links, all as DataFrames, with a reliable checkpoint after each round.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any other;
rows without a doc_id get a component_id from the others, null if there are none; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import checkpointed, ddl, passing, ship, slices

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Free bits before each further deal, and the bits that it fixes in each of four disjoint parts.
DEALS = ((36, 9), (27, 6), (21, 5), (16, 4), (12, 3))
CAP = 96
_BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add _fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    df = docs.withColumn("_text", F.col(text).cast("string"))
    fields = passing(docs, text, keep_text, "_fp")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [_signed(fingerprint(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"_fp": pa.array(fps, pa.int64())})

    return df.mapInArrow(run, ddl(fields, "_fp long"))


def _rotated(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def chain_ok(a: Column, b: Column, turn: Column) -> Column:
    """The chain from segment `turn` stays within floor(3k/8) differing bits at each k, up to the whole ring."""
    x = a.bitwiseXOR(b)
    by = (turn * 8).cast("int")
    y = F.when(by == 0, x).otherwise(F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(64) - by)))
    ok = F.bit_count(y) <= MAX_DISTANCE
    for k in range(3, 8):
        ok = ok & (F.bit_count(F.shiftrightunsigned(y, 64 - 8 * k)) <= MAX_DISTANCE * k // 8)
    return ok


def first_keys(fps: DataFrame) -> DataFrame:
    """(_fp, turn, key, free): 16 keys of 28 bits each, and the 36 bits left free, in an order that depends on the key."""
    keys = []
    for turn in range(8):
        y = _rotated(F.col("_fp"), 8 * turn)
        head, a, b, tail = F.shiftrightunsigned(y, 48), _low(F.shiftrightunsigned(y, 36), 12), _low(F.shiftrightunsigned(y, 24), 12), _low(y, 24)
        for half, (own, other) in enumerate(((a, b), (b, a))):
            key = F.shiftleft(F.lit(turn * 2 + half).cast("long"), 28).bitwiseOR(F.shiftleft(head, 12)).bitwiseOR(own)
            keys.append(F.struct(F.lit(turn).alias("turn"), key.alias("key"), F.shiftleft(other, 24).bitwiseOR(tail).alias("free")))
    return fps.select("_fp", F.inline(F.array(*keys)))


def next_keys(crowded: DataFrame, free: int, fixed: int) -> DataFrame:
    """Deal the members of crowded keys anew: four longer keys for each."""
    keys = []
    for part in range(4):
        by = part * fixed
        y = F.col("free") if by == 0 else _low(F.shiftleft(F.col("free"), by), free).bitwiseOR(F.shiftrightunsigned(F.col("free"), free - by))
        key = F.xxhash64("key", F.lit(part), F.shiftrightunsigned(y, free - fixed))
        keys.append(F.struct(key.alias("key"), _low(y, free - fixed).alias("free")))
    return crowded.select("_fp", "turn", F.inline(F.array(*keys)))


def _pairs(keys: DataFrame) -> DataFrame:
    a, b = keys.select("key", "turn", F.col("_fp").alias("a")), keys.select("key", F.col("_fp").alias("b"))
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & chain_ok(F.col("a"), F.col("b"), F.col("turn")), "inner").select("a", "b")


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Every pair (a < b) of the different fingerprints in fps._fp within MAX_DISTANCE, checkpointed."""
    keys, parts = first_keys(fps), []
    for level in range(len(DEALS) + 1):
        crowded = None
        if level < len(DEALS):
            hot = checkpointed(keys.groupBy("key").count().filter(F.col("count") > cap).select("key"))
            crowded = None if hot.isEmpty() else hot
        if crowded is None:
            parts.append(_pairs(keys))
            break
        parts.append(_pairs(keys.join(crowded, "key", "left_anti")))
        free, fixed = DEALS[level]
        keys = checkpointed(next_keys(keys.join(crowded, "key", "left_semi"), free, fixed))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return checkpointed(found.distinct())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: u, v. One large-star or small-star step; returns edges with u > v.

    The join's key is a turned u, so both sides get exchanges that adaptive execution may split: the centre of a
    star has as many edges as its component has members."""
    if not small:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(edges).select(F.concat(F.lit("n"), F.col("w").cast("string")).alias("k"), F.col("m"))
    both = edges.withColumn("k", F.concat(F.lit("n"), F.col("u").cast("string"))).join(least, "k")
    m = F.least("u", "m")
    if small:
        out = both.select(F.inline(F.array(F.struct(F.col("v").alias("p"), m.alias("q")), F.struct(F.col("u").alias("p"), m.alias("q")))))
    else:
        out = both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("p"), m.alias("q"))
    return out.filter("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the pairs (a, b); root is the least node of its component."""
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    state = None
    for _ in range(max_rounds):
        edges = checkpointed(_star(_star(edges, False), True))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components: no fixed point")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", cap: int = CAP) -> DataFrame:
    """(key, _fp, component_id) of each row: the smallest key that links lead to, its own included."""
    rows = checkpointed(with_fingerprints(docs.select(key, text), text))
    nodes = checkpointed(rows.groupBy("_fp").agg(F.min(key).alias("_rep")))
    pairs = links(nodes, cap)
    label = nodes.withColumn("component_id", F.col("_rep"))
    if not pairs.isEmpty():
        roots = components(pairs)
        linked = nodes.join(roots, nodes["_fp"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_fp"))
        best = linked.groupBy("_root").agg(F.min("_rep").alias("component_id")).withColumn("_k", F.hex("_root"))
        label = linked.select("_fp", F.hex("_root").alias("_k")).join(best, "_k").select("_fp", "component_id")
    # Joined on the text form: both sides are dealt anew, and a fingerprint that very many rows share can be split.
    label = checkpointed(label.select(F.hex("_fp").alias("_hex"), "component_id"))
    return rows.withColumn("_hex", F.hex("_fp")).join(label, "_hex").drop("_hex")


def op8_simhash(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and its component."""
    found = near_duplicates(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """What op8_simhash returns, by a plain fingerprint and by comparing all pairs; for tests."""
    import re

    def plain(text: str | None) -> int:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        least[root] = min(least.get(root, doc_id), doc_id)
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]
