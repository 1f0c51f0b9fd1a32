"""Prefix trie of conversations: each distinct beginning is a node.

A turn is named by the SHA-256 of its role and text; texts move nowhere. Polynomial rolling fingerprints of all prefixes
come from numpy scans over blocks of conversations (see blocks.py: a long conversation lies in several, whose sums
add up). A conversation's beginning may be taken from another one: the sums of the two parts are put together by
shifting one of them. Prefixes of one length and fingerprint are a group, whose representative is that with the
smallest conv_id; every member's last turn and the fingerprint of the prefix before it are held against the
representative's, which verifies groups turn by turn, as the shorter prefixes are verified likewise. Members that
differ get a split number of their own, summed up along the conversation, and groups are formed anew by (length,
fingerprint, splits), until all members agree. So nodes are right whatever collides.

Rollup: a node's weight is booked at its representative, and summed from a conversation's end backwards; the sum over the
members of a node is then that of its subtree, at any depth, by two scans and one aggregate.

Defined results: null roles and texts are empty, null turns come first; rows of one turn are in the order of that SHA-256,
repeated rows beside each other; rows without a conv_id are one conversation that takes nothing from others, counts as a
member, and has no id to show; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm import blocks as B
from docsift.llm.common import checkpointed, ship
from docsift.llm.conversations import address

#: Two primes below 2^31 and a base for each: products of residues stay within 64 bits.
MODULI = ((2147483647, 1103515245), (2147483629, 692873211))
#: A head is at most so many turns.
HEAD = 8
_EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "fp", "split"]


def powers(base: int, modulus: int, n: int, first: int = 0) -> np.ndarray:
    """base^first, base^(first+1), ... modulo modulus, by doubling."""
    out = np.array([pow(base, first, modulus)], np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), modulus)) % np.uint64(modulus)))
    return out[:n]


def scan(addresses: list[bytes], first: int, moduli: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each modulus the prefix sums of residue * base^place, places counted from first."""
    words = np.frombuffer(b"".join(a[:16] for a in addresses), ">u8").reshape(-1, 2)
    out = []
    for k, (modulus, base) in enumerate(moduli):
        terms = words[:, k].astype(np.uint64) % np.uint64(modulus) * powers(base, modulus, len(words), first) % np.uint64(modulus)
        out.append(np.cumsum(terms) % np.uint64(modulus))
    return out


class _Turns:
    def __init__(self, t: pa.Table) -> None:
        self.addr, self.n_bytes = t.column("addr").to_pylist(), t.column("n_bytes").to_pylist()


def places(rows: DataFrame, moduli: tuple[tuple[int, int], ...]) -> DataFrame:
    """(conv_id, i, addr, n_bytes, f, e): the place of each turn, and the fingerprints' parts with and without it."""
    blocks = B.sorted_blocks(rows.withColumn("_at", F.monotonically_increasing_id()), "conv_id", ["turn", "addr", "_at"])
    ends = B.edges(blocks, "conv_id", _Turns, lambda t, s, e: [e - s, *(int(x[-1]) for x in scan(t.addr[s:e], 0, moduli))])
    before: dict[int, tuple[int, ...]] = {}
    for chain in B.chains(ends):
        at, sums = 0, [0] * len(moduli)
        for number, (n, *own) in chain:
            if at:  # where it goes on, it is the block's first one
                before[number] = (at, *sums)
            sums = [(a + x * pow(base, at + 1, m)) % m for a, x, (m, base) in zip(sums, own, moduli)]
            at += n
    fresh = (0, *(0 for _ in moduli))

    def work(number: int, conv: int | None, first: bool, last: bool, t: _Turns, s: int, e: int) -> list[tuple]:
        at, *sums = before.get(number, fresh) if first else fresh
        f = [((x + np.uint64(b)) % np.uint64(m)).tolist() for x, b, (m, _) in zip(scan(t.addr[s:e], at + 1, moduli), sums, moduli)]
        held = list(zip(*f))
        return [(conv, at + 1 + k, t.addr[s + k], t.n_bytes[s + k], list(x), list(held[k - 1]) if k else sums) for k, x in enumerate(held)]

    schema = "conv_id long, i long, addr binary, n_bytes long, f array<long>, e array<long>"
    arrow = pa.schema([("conv_id", pa.int64()), ("i", pa.int64()), ("addr", pa.binary()), ("n_bytes", pa.int64()), ("f", pa.list_(pa.int64())), ("e", pa.list_(pa.int64()))])
    return B.each_group(blocks, "conv_id", _Turns, work, schema, arrow)


def rebuilt(turns: DataFrame, moduli: tuple[tuple[int, int], ...] = MODULI) -> DataFrame:
    """(conv_id, depth, addr, n_bytes, fp, up, last): every prefix of every conversation after its first turns were taken from
    another one; up is the fingerprint without the last turn; last: it is the whole conversation."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        address(F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("addr"),
        F.octet_length(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).cast("long").alias("n_bytes"),
    )
    own = places(rows, moduli)
    turn = F.struct("i", "addr", "n_bytes", "f", "e")
    heads = own.groupBy("conv_id").agg(F.max("i").alias("n_own"), F.array_sort(F.collect_list(F.when(F.col("i") <= HEAD, turn))).alias("head"))
    heads = checkpointed(heads)  # a row for each conversation
    h = F.coalesce(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (HEAD + 1), F.lit(0)).cast("int")
    nothing = F.array().cast(heads.schema["head"].dataType)
    zero = F.array(*(F.lit(0).cast("long") for _ in moduli))
    last_f = lambda a, n: F.when(n > 0, F.get(a, n - 1)["f"]).otherwise(zero)
    base = heads.select(F.col("conv_id").alias("_base"), F.col("head").alias("_head"))
    plan = (
        heads.withColumn("h", h)
        .join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base"), "left")
        .withColumn("taken", F.slice(F.coalesce(F.col("_head"), nothing), F.lit(1), F.col("h")))
        .select(
            "conv_id",
            "h",
            "taken",
            F.size("taken").alias("m"),
            last_f(F.col("taken"), F.size("taken")).alias("f_taken"),
            last_f(F.col("head"), F.least(F.col("h"), F.size("head"))).alias("f_left"),
            (F.size("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"),
        )
    )
    plan = checkpointed(plan)
    joined = lambda a: F.concat_ws(":", *(F.get(a, F.lit(k)).cast("string") for k in range(len(moduli))))

    def shifted(f: Column) -> Column:
        """Own sums behind the head, put behind the taken turns: a move of m - h places, none of them forward."""
        out = []
        for k, (m, b) in enumerate(moduli):
            back = F.array(*(F.lit(pow(b, -j, m)).cast("long") for j in range(HEAD + 1)))
            out.append((F.get("f_taken", F.lit(k)) + F.get(back, F.col("h") - F.col("m")) * F.pmod(F.get(f, F.lit(k)) - F.get("f_left", F.lit(k)), F.lit(m))) % m)
        return F.array(*out)

    plan_of = plan.withColumnRenamed("conv_id", "_conv").drop("taken")
    own_part = own.join(plan_of, F.col("conv_id").eqNullSafe(F.col("_conv"))).filter(F.col("i") > F.col("h"))
    own_part = own_part.select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "addr", "n_bytes", joined(shifted(F.col("f"))).alias("fp"), joined(shifted(F.col("e"))).alias("up"), "length")
    taken = plan.select("conv_id", "length", F.inline("taken")).select("conv_id", F.col("i").alias("depth"), "addr", "n_bytes", joined(F.col("f")).alias("fp"), joined(F.col("e")).alias("up"), "length")
    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("addr"), F.lit(0).cast("long").alias("n_bytes"), joined(zero).alias("fp"), F.lit("").alias("up"), "length")
    out = own_part.unionByName(taken).unionByName(root)
    return out.withColumn("last", F.col("depth") == F.col("length")).drop("length").withColumns({"split": F.lit(0).cast("long"), "_up_split": F.lit(0).cast("long")})


def grouped(rows: DataFrame) -> DataFrame:
    """Add the node of each prefix: rep (conv_id of its representative), n (members), n_ends (whole conversations), and ok:
    the last turn and what stands before it are the representative's."""
    sample = F.struct(F.isnull("conv_id").alias("no_id"), F.col("conv_id").alias("id"), F.col("addr"), F.col("up"), F.col("_up_split"))
    nodes = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in KEY)).agg(F.min(sample).alias("_rep"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    nodes = checkpointed(nodes)  # so that both sides are dealt out for the join alone, and Spark can split a frequent beginning
    same = (F.col("_rep")["addr"] == F.col("addr")) & (F.col("_rep")["up"] == F.col("up")) & (F.col("_rep")["_up_split"] == F.col("_up_split"))
    joined = rows.join(nodes, [F.col(c) == F.col(f"_{c}") for c in KEY])
    return joined.select(*rows.columns, F.col("_rep")["id"].alias("rep"), "n", "n_ends", same.alias("ok"))


class _Sums:
    """A block's columns for the rollup."""

    def __init__(self, t: pa.Table) -> None:
        col = lambda c: t.column(c).combine_chunks()
        rep, conv = col("rep"), col("conv_id")
        self.rep = rep.to_pylist()
        same = pa.compute.fill_null(pa.compute.equal(rep, conv), False).to_numpy(zero_copy_only=False)
        self.own = same | pa.compute.and_(rep.is_null(), conv.is_null()).to_numpy(zero_copy_only=False)
        n, ends, last = col("n").to_numpy(), col("n_ends").to_numpy(), col("last").to_numpy(zero_copy_only=False)
        self.saved = np.where(self.own, (n - 1) * col("n_bytes").to_numpy(), 0)
        self.leaf = (self.own & last & (n == ends)).astype(np.int64)


def _running(blocks: DataFrame, value: str, out: str) -> DataFrame:
    """Add the sum of value over the conversation's rows up to this one, and without it."""
    column = lambda t: t.column(value).to_numpy()
    before: dict[int, int] = {}
    for chain in B.chains(B.edges(blocks, "conv_id", column, lambda x, s, e: int(x[s:e].sum()))):
        total = 0
        for k, (number, own) in enumerate(chain):
            if k:  # where it goes on, it is the block's first one
                before[number] = total
            total += own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = B.whole(batches)
        if t is not None:
            number, x, found = TaskContext.get().partitionId(), column(t), B.runs(t, "conv_id")
            sums = np.empty(len(x), np.int64)
            for k, (_, s, e) in enumerate(found):
                sums[s:e] = np.cumsum(x[s:e]) + (0 if k else before.get(number, 0))
            yield from t.append_column(out, pa.array(sums)).append_column(f"_up_{out}", pa.array(sums - x)).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{fields}, {out} long, _up_{out} long")


def verified(rows: DataFrame) -> DataFrame:
    """The rows with their nodes, in blocks by conversation; groups are split until every member is its representative's equal."""
    turn = 0
    while True:
        blocks = B.sorted_blocks(grouped(rows), "conv_id", ["depth"])
        if blocks.filter(~F.col("ok")).limit(1).count() == 0:
            return blocks
        turn += 1
        # What differs from its representative, and from what else differs, gets a number of its own; 31 bits, so that sums fit.
        own = F.xxhash64(F.lit(turn), "depth", "addr", "up", "_up_split").bitwiseAND(F.lit((1 << 31) - 1))
        more = blocks.withColumn("_v", F.col("split") - F.col("_up_split") + F.when(F.col("ok"), F.lit(0).cast("long")).otherwise(own + 1))
        more = _running(B.sorted_blocks(more.drop("split", "_up_split", "rep", "n", "n_ends", "ok"), "conv_id", ["depth"]), "_v", "split")
        rows = checkpointed(more.drop("_v"))


def trie(blocks: DataFrame) -> DataFrame:
    """A row for each node of verified prefixes."""

    def summary(t: _Sums, s: int, e: int) -> list:
        return [int(t.saved[s:e].sum()), int(t.leaf[s:e].sum()), bool(t.own[s]), t.rep[e - 1]]

    after: dict[tuple[int, bool], tuple[int, int, int]] = {}
    above: dict[int, int | None] = {}
    for chain in B.chains(B.edges(blocks, "conv_id", _Sums, summary)):
        saved = leaf = head = 0
        for k in range(len(chain) - 1, -1, -1):
            after[chain[k][0], k == 0] = (saved, leaf, head)
            saved, leaf, head = saved + chain[k][1][0], leaf + chain[k][1][1], int(chain[k][1][2])
        for (_, said), (number, _) in zip(chain, chain[1:]):
            above[number] = said[3]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = B.whole(batches)
        if table is None:
            return
        number, t, found = TaskContext.get().partitionId(), _Sums(table), B.runs(table, "conv_id")
        n = table.num_rows
        saved, leaves, child = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        parent: list[int | None] = [None, *t.rep[:-1]]
        child[:-1] = t.own[1:]
        for k, (_, s, e) in enumerate(found):
            more = after.get((number, False), (0, 0, 0)) if k == 0 else (0, 0, 0)
            more = after.get((number, True), more) if k == len(found) - 1 else more
            saved[s:e] = np.cumsum(t.saved[s:e][::-1])[::-1] + more[0]
            leaves[s:e] = np.cumsum(t.leaf[s:e][::-1])[::-1] + more[1]
            child[e - 1] = more[2]
            parent[s] = above.get(number) if k == 0 and (number, False) in after else None
        out = table.append_column("saved", pa.array(saved)).append_column("leaves", pa.array(leaves)).append_column("child", pa.array(child))
        yield from out.append_column("parent", pa.array(parent, pa.int64())).select([*KEY, "rep", "parent", "saved", "leaves", "child"]).to_batches()

    rows = blocks.mapInArrow(add, "depth long, fp string, split long, rep long, parent long, saved long, leaves long, child long")
    same = lambda c: F.min(c).alias(c)
    nodes = rows.groupBy(*KEY).agg(same("rep"), same("parent"), F.count("*").alias("n"), F.sum("child").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.join(digests(blocks.filter("last")), KEY, "left").select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def digests(ends: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the comma-joined conv_ids of each node. Ids are joined where a range of them lies, into
    pieces; only those meet, and stream through the digest."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    dealt = ends.filter(F.col("conv_id").isNotNull()).select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def streamed(start: Callable[[], Any], put: Callable[[Any, dict], Any], size: Callable[[Any], int], out: Callable[[tuple, dict, Any], tuple], arrow: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, first, held, done = None, None, None, []
            for batch in batches:
                for r in batch.to_pylist():
                    own = tuple(r[c] for c in KEY)
                    if key is not None and (own != key or size(held) >= piece):
                        done.append(out(key, first, held))
                        key = None
                    if key is None:
                        key, first, held = own, r, start()
                    held = put(held, r)
                if done:
                    yield B.batch_of(done, arrow)
                    done = []
            if key is not None:
                yield B.batch_of([out(key, first, held)], arrow)

        return run

    key = [("depth", pa.int64()), ("fp", pa.string()), ("split", pa.int64())]
    pieces = streamed(list, lambda held, r: held.append(r["conv_id"]) or held, len, lambda k, first, held: (*k, first["conv_id"], ",".join(map(str, held))), pa.schema([*key, ("first", pa.int64()), ("ids", pa.string())]))

    def feed(held: list, r: dict) -> list:
        held[0].update(("," * held[1] + r["ids"]).encode())
        held[1] = True
        return held

    whole = streamed(lambda: [hashlib.sha256(), False], feed, lambda held: 0, lambda k, first, held: (*k, held[0].hexdigest()), pa.schema([*key, ("ends_sha256", pa.string())]))
    parts = dealt.mapInArrow(pieces, "depth long, fp string, split long, first long, ids string")
    return parts.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(whole, "depth long, fp string, split long, ends_sha256 string")


def op12_prefix_trie(conversations: DataFrame, moduli: tuple[tuple[int, int], ...] = MODULI) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    ship(conversations.sparkSession)
    return trie(verified(checkpointed(rebuilt(conversations, moduli))))
