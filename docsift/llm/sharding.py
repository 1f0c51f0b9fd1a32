"""Sharding by fixed virtual slots.

A record is hashed into one of `slots` virtual slots, for good. Bytes are summed per slot, and a versioned map
says which shard holds each slot. Rebalancing edits the map: it moves as few slots as bring the shards' bytes
together, and writes the next version. Only the slot table (thousands of rows, a constant) reaches the driver.

Defined results: a null text counts no bytes (size 1); equal rows share a virtual slot, and which of them has which place
in it is open; an empty table gives an empty result; very long texts count whole. Extra columns pass through; those named like
a column that is made, or an internal one (leading underscore), are replaced.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import shared_path, text_or_empty

SLOTS = 4096
SEED = 0x51A7


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] under a version number; 0 is the map that no bytes have shaped."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(0, shards, tuple(s % shards for s in range(slots)))

    def loads(self, bytes_of: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += bytes_of[slot]
        return out

    def rebalanced(self, bytes_of: list[int], shards: int | None = None) -> SlotMap:
        """The next version: slots leave shards above the mean, largest first where they fit, for the lightest shard.

        More shards than before start empty; fewer give all their slots away. Where moving brings nothing, all stay."""
        shards = shards or self.shards
        mean = sum(bytes_of) / shards
        held: list[list[int]] = [[] for _ in range(shards)]
        loose: list[int] = []
        for slot, shard in enumerate(self.shard_of):
            (held[shard] if shard < shards else loose).append(slot)
        load = [0] * shards
        for shard, own in enumerate(held):
            own.sort(key=lambda s: (-bytes_of[s], s))
            kept = []
            for slot in own:
                if load[shard] + bytes_of[slot] <= mean or not kept and bytes_of[slot] > mean:
                    load[shard] += bytes_of[slot]
                    kept.append(slot)
                else:
                    loose.append(slot)
            held[shard] = kept
        shard_of = [0] * len(self.shard_of)
        for shard, own in enumerate(held):
            for slot in own:
                shard_of[slot] = shard
        lightest = [(b, shard) for shard, b in enumerate(load)]
        heapq.heapify(lightest)
        for slot in sorted(loose, key=lambda s: (-bytes_of[s], s)):
            b, shard = heapq.heappop(lightest)
            shard_of[slot] = shard
            heapq.heappush(lightest, (b + bytes_of[slot], shard))
        after = SlotMap(self.version + 1, shards, tuple(shard_of))
        spread = lambda m: max(m.loads(bytes_of)) - min(m.loads(bytes_of))
        return after if shards != self.shards or spread(after) < spread(self) else SlotMap(after.version, shards, self.shard_of)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "vslot int, shard int, shards int")

    def save(self, spark: SparkSession, path: str) -> bool:
        """Store this version in the table of maps at path: written beside it, then published by a rename. A version that is
        stored already stays as it is, and False says so."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        staged, target = f"_staged-{uuid.uuid4().hex}", at(f"version={self.version}")
        fs = target.getFileSystem(conf)
        if fs.exists(target):
            return False
        self.frame(spark).coalesce(1).write.parquet(f"{path}/{staged}")
        # Where another writer was first, a rename of folders fails, or puts the staged one inside the other, whence it goes.
        done = bool(fs.rename(at(staged), target)) and not fs.exists(at(f"version={self.version}/{staged}"))
        fs.delete(at(f"version={self.version}/{staged}"), True)
        fs.delete(at(staged), True)
        return done

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        table = spark.read.parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.filter(F.col("version") == version).select("vslot", "shard", "shards").collect()
        return cls(int(version), rows[0]["shards"], tuple(s for _, s in sorted((r["vslot"], r["shard"]) for r in rows)))

    @classmethod
    def latest(cls, spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> SlotMap:
        """The latest stored map; where none is stored yet, version 0."""
        from pyspark.errors import AnalysisException

        try:
            return cls.load(spark, path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return cls.initial(shards, slots)


def with_slots(df: DataFrame, key: list[Column], slots: int = SLOTS) -> DataFrame:
    """Add vslot, the fixed slot of each record."""
    return df.withColumn("vslot", F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(slots)).cast("int"))


def slot_bytes(df: DataFrame, size: str, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot."""
    n_bytes, n_rows = [0] * slots, [0] * slots
    for r in df.groupBy("vslot").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        n_bytes[r["vslot"]], n_rows[r["vslot"]] = r["b"], r["n"]
    return n_bytes, n_rows


#: Copies of a row that one task numbers.
_COPIES = 1 << 16


def shard_rows(df: DataFrame, size: str, order: list[str], slot_map: SlotMap, n_rows: list[int]) -> DataFrame:
    """Add shard and slot, the row's place in its shard: those of the virtual slots before its own, then its place
    in its virtual slot. So numbering needs thousands of small windows instead of one for each shard.

    Equal rows are one row with a count until the end, which combines before the shuffle; a row with very many copies is
    dealt in pieces over the tasks when they are numbered."""
    spark = df.sparkSession
    df = df.drop("shard", "slot", "_start", "_own", "_n", "_at")
    start, at = [0] * slot_map.shards, []
    for vslot, shard in enumerate(slot_map.shard_of):
        at.append((vslot, shard, start[shard]))
        start[shard] += n_rows[vslot]
    place = spark.createDataFrame(at, "vslot int, shard int, _start long")  # as many rows as there are slots
    names = [c for c in df.columns if c != "vslot"]
    kinds = df.groupBy("vslot", *(F.col(f"`{c}`") for c in names)).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("vslot").orderBy(*order, *(F.col(f"`{c}`") for c in names if c not in order))
    before = F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = kinds.withColumn("_own", before).join(F.broadcast(place), "vslot").withColumn("slot", F.col("_start") + F.col("_own")).drop("_start", "_own")
    few = kinds.filter(F.col("_n") <= _COPIES).withColumn("_at", F.lit(0).cast("long"))
    many = kinds.filter(F.col("_n") > _COPIES).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_COPIES).cast("long")))).repartition("vslot", "slot", "_at")
    rows = few.unionByName(many)
    last = F.least(F.col("_n"), F.col("_at") + _COPIES) - 1
    return rows.withColumn("_at", F.explode(F.sequence(F.col("_at"), last))).withColumn("slot", F.col("slot") + F.col("_at")).drop("_n", "_at")


def op4_sharding(documents: DataFrame, shards: int = 8, maps: str | None = None) -> DataFrame:
    """Every document with its shard under the law `bytes`, its place there, and its virtual slot and map version.

    maps: the folder of the stored maps, whose latest is edited for the bytes of these documents and stored as the next
    version; None starts a new one in the shared folder."""
    spark = documents.sparkSession
    body = F.encode(text_or_empty(F.col("text")), "UTF-8")
    rows = documents.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    path = maps or shared_path(spark, "slotmap")
    stored = SlotMap.latest(spark, path, shards)
    rows = with_slots(rows, [F.col("doc_id"), F.col("text_crc32")], len(stored.shard_of))
    n_bytes, n_rows = slot_bytes(rows, "size", len(stored.shard_of))
    stored.save(spark, path)  # the first one; a later one is there
    stored.rebalanced(n_bytes, shards).save(spark, path)
    slot_map = SlotMap.load(spark, path)  # the next one, whoever published it
    out = shard_rows(rows, "size", ["doc_id", "text_crc32"], slot_map, n_rows)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(slot_map.version).alias("map_version"),
    )
