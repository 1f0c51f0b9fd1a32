"""Benchmark decontamination by one Aho-Corasick automaton.

Test questions and answers are normalised to words (A-Z lower-cased; letters, digits and anything outside ASCII),
and each window of ten consecutive words of an item, or the whole item if it is shorter, is a pattern. One
automaton over all patterns reads each normalised text once; hits are word ranges, mapped back to offsets of the
original text. The items are held by every worker, so they are bounded: if the benchmark has more than `max_bytes` of
text, it is cut into slices of about that size. Slices read the texts one after the other, with a checkpoint between
them, and add to the same hits, so a worker holds one automaton and the driver the texts of one slice.

Defined results: a null or empty text has no words and isn't contaminated; items without words have no windows;
repeated items count once, by item_id; null item_ids count as one item, written "null", which isn't the item of that
name; an empty benchmark hits nothing; an empty table gives an empty one. Repeated rows are scanned alike, and texts are
taken whole whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import checkpointed, ship, slices

WINDOW = 10
#: Bytes outside words become blanks, A-Z becomes a-z; bytes of characters outside ASCII stay.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RUNS = "array<struct<start:int,end:int>>"


#: Stands for a null item_id until the end.
_NO_ID = "\0null"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Matcher:
    """The automaton, and which items have each of its patterns."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        self.automaton = ahocorasick.Automaton()
        for p, items in patterns.items():
            # Latin-1 maps bytes to characters one to one; the blanks make patterns match whole words only.
            self.automaton.add_word(f" {p.decode('latin-1')} ", (len(p) + 2, p.count(b" ") + 1, items))
        if patterns:
            self.automaton.make_automaton()
        self.shortest = min((p.count(b" ") + 1 for p in patterns), default=None)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ranges of hit words, in order, and the items that hit."""
        if self.shortest is None or len(words) < self.shortest:
            return [], set()
        norm = b" " + b" ".join(words) + b" "
        found = [(end - size + 1, n, items) for end, (size, n, items) in self.automaton.iter(norm.decode("latin-1"))]
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        starts = np.searchsorted(blanks, [x[0] for x in found])
        return merged([(int(s), int(s) + x[1]) for s, x in zip(starts, found)]), {i for x in found for i in x[2]}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of its words."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[s][0], places[e - 1][1]) for s, e in runs]


def _patterns(rows: list, size: int) -> dict[bytes, list[str]]:
    out: dict[bytes, list[str]] = {}
    for item, text in rows:
        for w in windows_of(words_of(text), size):
            owners = out.setdefault(w, [])
            name = _NO_ID if item is None else str(item)
            if name not in owners:
                owners.append(name)
    return out


def _scanner(shared, size: int, names: list[str], first: bool, spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(_patterns(shared.value, size))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            n_words, hits, items, places = [], [], [], []
            old = [None, None] if first else [batch.column("_runs").to_pylist(), batch.column("_items").to_pylist()]
            for k, text in enumerate(batch.column("_text").to_pylist()):
                words = words_of(text)
                runs, own = matcher.scan(words)
                if not first:
                    runs = merged(runs + [(r["start"], r["end"]) for r in old[0][k]])
                    own |= set(old[1][k])
                n_words.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in runs])
                items.append(sorted(own))
                places.append([{"start": s, "end": e} for s, e in original_spans(text, runs)] if spans and runs else [])
            columns = {n: batch.column(n) for n in names}
            columns |= {
                "_n_words": pa.array(n_words, pa.int64()),
                "_runs": pa.array(hits, kind),
                "_items": pa.array(items, pa.list_(pa.string())),
                "_spans": pa.array(places, kind),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, max_bytes: int = 32 << 20, spans: bool = True, keep_text: bool = True) -> DataFrame:
    """Add n_words, n_hit, hit_items (sorted), hit_runs (word ranges) and hit_spans (offsets in the text)."""
    spark = docs.sparkSession
    ship(spark)
    source = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    total = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    made = ("n_words", "n_hit", "hit_items", "hit_runs", "hit_spans", "_n_words", "_runs", "_items", "_spans")
    df = docs.drop(*(c for c in made if c != text)).withColumn("_text", F.col(text).cast("string"))
    for k in range(parts):
        own = source.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else source
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in own.collect()])  # about max_bytes
        names = [f.name for f in df.schema if f.name not in ("_n_words", "_runs", "_items", "_spans") and (keep_text or f.name != text) and not (f.name == "_text" and k + 1 == parts)]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names), "_n_words long", f"_runs {_RUNS}", "_items array<string>", f"_spans {_RUNS}"])
        df = df.mapInArrow(_scanner(shared, size, names, k == 0, spans and k + 1 == parts), schema)
        if k + 1 < parts:
            df = checkpointed(df)
            shared.unpersist()
    ids = F.array_sort(F.transform("_items", lambda i: F.when(i == _NO_ID, "null").otherwise(i)))
    n_hit = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["end"] - r["start"]).cast("long")
    return df.withColumns({"n_hit": n_hit, "_items": ids}).withColumnsRenamed({"_n_words": "n_words", "_runs": "hit_runs", "_items": "hit_items", "_spans": "hit_spans"})


def op3_decontam(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: how many of its words lie in a benchmark window, and the items that these are of."""
    found = scan_benchmark(documents.select("doc_id", "text"), benchmark, spans=False, keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], size: int = WINDOW) -> list[tuple]:
    """What op3_decontam returns, by comparing every window with every window; for tests."""
    word = lambda t: _WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, own = word(text), set(), set()
        for item_id, t in items:
            v = word(t)
            n = min(size, len(v))
            for j in range(len(v) - n + 1) if v else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        own.add((item_id is None, "null" if item_id is None else str(item_id)))
        digest = hashlib.sha256(",".join(sorted(x for _, x in own)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(own), digest, bool(hit)))
    return out
