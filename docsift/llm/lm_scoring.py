"""Language-model scores from a weighted backoff automaton.

Model: n-grams of words, the counts of each order smoothed by the next shorter one: with c the count of a history h and a
word w, P(w | h) = (c(h w) + S * P(w | h')) / (c(h) + S), where h' is h without its first word and S the strength of that
order; at the end stands (c(w) + 0.1) / (N + 0.1 * (V + 1)). As an automaton: a state for each history, an arc for
each n-gram with its log-probability, and from each state a failure arc to the shorter history, with the log of
S / (c(h) + S). A text is one walk from the state of a text's begin: a word takes its arc if there is one, else failure
arcs until there is; weights add up.

The corpus's automaton is in no one place. Documents that are read together are dealt into blocks of some megabytes by a hash. A task of the first
pass counts the n-grams of the documents that it reads (0 for those that aren't learnt from), for each block, and packs them as
sorted arrays of 64-bit keys for each slice of the key space (words: 80 bits, so that the base's counts are those of words). A
slice adds up what all blocks say of its keys, and tells each block the counts that aren't the block's own, by the
keys' places among the block's keys in that slice: one bit a key and the count. The second pass brings a block's documents and
those answers together: own counts and answers make the part of the automaton that the block's texts can reach, which is
walked. So what moves grows with the corpus, keys move once for each block that has them (a frequent word as often as
there are blocks), texts once, and nothing but N and V reaches the driver.

Defined results: a null text is empty, one end; a null doc_id is held out; without training rows base and score are 0 for each
token; repeated rows are merged before they move, and come back as often; an empty table gives an empty result; texts are taken
whole; other columns are not looked at. Two n-grams of one 64-bit key would share a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.blocks import batch_of
from docsift.llm.common import checkpointed, lean, ship, slices, text_or_empty

#: Strength of the prior of each order above the first.
STRENGTHS = (24.0, 6.0, 3.0)
#: Bytes of text of a block; keys that a task holds before it packs them; keys of a slice; bytes of text that a task holds
#: before it sends them to their blocks.
BLOCK_BYTES, HELD, PER_SLICE, SENT = 9 << 20, 6 << 20, 2 << 20, 8 << 20
#: Words that are walked in one go; many pieces are walked side by side.
PIECE = 2048
#: The begin and end of a text; no word has a space.
BEGIN, END = b" begin", b" end"
_U = np.uint64
_DIGEST = np.dtype([("low", "<u8"), ("high", "<u2"), ("rest", "V6")])


def words_of(text: str) -> list[bytes]:
    """The begin, the words of a text with A-Z lower-cased, and the end. bytes.lower and bytes.split know ASCII only."""
    return [BEGIN, *text.encode("utf-8", "surrogatepass").lower().split(), END]


def digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits of the hash of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), _DIGEST)
    return both["low"].copy(), both["high"].copy()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Laid:
    """Texts laid end to end: ids of their words in order of appearance, those words, and each word's place in its text."""

    def __init__(self, texts: list[str], known: dict[bytes, int] | None = None) -> None:
        known = {} if known is None else known
        ids, ends = [], []
        number = known.setdefault
        for text in texts:
            ids += [number(w, len(known)) for w in words_of(text)]
            ends.append(len(ids))
        self.known, self.ids = known, np.array(ids, np.int32)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), self.ends[:-1])) if len(ends) else self.ends
        self.place = (np.arange(len(ids)) - np.repeat(self.starts, self.ends - self.starts)).astype(np.int32)

    def ngrams(self, low: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 2 to order words: where n-grams end, and their keys."""
        words = key = low[self.ids]
        for k in range(2, order + 1):
            key = np.concatenate((key[:1], mixed(mixed(key[:-1] + _U(0x9E3779B97F4A7C15)) ^ words[1:])))
            at = np.flatnonzero(self.place >= k - 1).astype(np.int32)
            yield k, at, key[at]


def _counts(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs, and that number before them."""
    size = next(n for n in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * n))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _uncounted(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


_PACK_DDL = "slice int, kind int, blocks binary, lengths binary, keys binary, highs binary, counts binary"
_SAID_DDL = "block long, kind int, slice int, n_keys long, told binary, counts binary, n long, v long"
_PACK, _SAID = _arrow(_PACK_DDL), _arrow(_SAID_DDL)


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before; the first one does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _ranges(*columns: np.ndarray) -> list[tuple[int, int]]:
    at = _cuts(*columns).tolist()
    return list(zip(at, [*at[1:], len(columns[0])]))


def _slice_of(key: np.ndarray, n_slices: int) -> np.ndarray:
    """Slices are ranges of keys."""
    return ((key >> _U(32)) * _U(n_slices) >> _U(32)).astype(np.int32)


def packed(kind: int, entries: list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]], n_slices: int) -> list[tuple]:
    """Rows of _PACK from (block, keys, highs, counts), each sorted by key."""
    pieces: dict[int, list] = {}
    for block, key, high, count in entries:
        where = _slice_of(key, n_slices)
        for s, e in _ranges(where):
            pieces.setdefault(int(where[s]), []).append((block, key[s:e], None if high is None else high[s:e], count[s:e]))
    out = []
    for where, own in pieces.items():
        blocks, keys, highs, counts = zip(*own)
        high = np.concatenate(highs).astype("<u2").tobytes() if kind == 1 else None
        out.append((where, kind, np.array(blocks, "<i8").tobytes(), np.array([len(k) for k in keys], "<i4").tobytes(), np.concatenate(keys).astype("<u8").tobytes(), high, _counts(np.concatenate(counts))))
    return out


def _by_block(blocks: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(blocks, kind="stable")
    blocks, columns = blocks[order], tuple(c[order] for c in columns)
    for s, e in _ranges(blocks) if len(blocks) else []:
        yield int(blocks[s]), *(c[s:e] for c in columns)


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and how often they are learnt from."""
    kinds = np.unique(keys)
    learnt, n = np.unique(keys[learn], return_counts=True)
    count = np.zeros(len(kinds), np.int64)
    count[np.searchsorted(kinds, learnt)] = n
    return kinds, count


def requests(rows: DataFrame, n_slices: int, order: int) -> DataFrame:
    """What the tasks count in rows that are learnt from, packed; keys of the others are asked for with a count of 0."""

    def packs(laid: list[Laid], blocks: list[np.ndarray], learn: list[np.ndarray], number: dict[int, int]) -> Iterator[tuple]:
        low, high = digests(list(laid[0].known))
        name = list(number)
        entries = []
        for block, ids, own in _by_block(np.concatenate(blocks), np.concatenate([x.ids for x in laid]), np.concatenate(learn)):
            ids, count = _counted(ids, own)
            by = np.lexsort((high[ids], low[ids]))
            entries.append((name[block], low[ids][by], high[ids][by], count[by]))
        yield from packed(1, entries, n_slices)
        del entries, by, ids, count
        for grams in zip(*(x.ngrams(low, order) for x in laid)):
            k, places, keys = grams[0][0], [at for _, at, _ in grams], [key for _, _, key in grams]
            del grams
            of, own = (np.concatenate([x[at] for x, at in zip(xs, places)]) for xs in (blocks, learn))
            del places
            key = np.concatenate(keys)
            keys.clear()
            entries = [(block, *_counted(mine, learnt)) for block, mine, learnt in _by_block(of, key, own)]
            del of, own, key
            yield from packed(k, [(name[block], mine, None, count) for block, mine, count in entries], n_slices)
            del entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        laid, blocks, learn, n = [], [], [], 0
        number: dict[int, int] = {}  # small numbers of the blocks that this task meets
        for batch in slices(batches):
            laid.append(Laid(batch.column("text").to_pylist(), laid[0].known if laid else None))
            each = laid[-1].ends - laid[-1].starts
            blocks.append(np.repeat(np.array([number.setdefault(b, len(number)) for b in batch.column("block").to_pylist()], np.int32), each))
            learn.append(np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), each))
            n += len(blocks[-1]) * order
            if n > HELD:
                yield from _batches(packs(laid, blocks, learn, number), _PACK)
                laid, blocks, learn, n = [], [], [], 0
        if laid:
            yield from _batches(packs(laid, blocks, learn, number), _PACK)
        del laid, blocks, learn
        lean()

    return rows.select("block", "held_out", "text").mapInArrow(run, _PACK_DDL)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 128) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def _answered(where: int, kind: int, packs: list[dict]) -> Iterator[tuple]:
    """Of one slice and kind: for each block the counts of keys of which it doesn't have all occurrences, and the slice's N and V."""
    column = lambda c, t: np.concatenate([np.frombuffer(p[c], t) for p in packs])
    block, key = np.repeat(column("blocks", "<i8"), column("lengths", "<i4")), column("keys", "<u8")
    count = np.concatenate([_uncounted(p["counts"]) for p in packs])
    high = column("highs", "<u2") if kind == 1 else np.zeros(len(key), "<u2")
    order = np.lexsort((block, high, key)) if kind == 1 else np.lexsort((block, key))
    block, key, high, count = block[order], key[order], high[order], count[order]
    at = _cuts(key, high)
    total = np.add.reduceat(count, at)
    if kind == 1:
        low, check = digests([BEGIN])
        token = (key[at] != low[0]) | (high[at] != check[0])
        yield 0, 0, where, None, None, None, int(total[token].sum()), int((total[token] > 0).sum())
    mine = _cuts(key, high, block)  # a block's own count may come from several tasks
    own, total = np.add.reduceat(count, mine), np.repeat(total, np.diff(np.append(np.searchsorted(mine, at), len(mine))))
    for b, own, total in _by_block(block[mine], own, total):
        tell = own != total
        if tell.any():
            yield b, kind, where, len(own), np.packbits(tell).tobytes(), _counts(total[tell]), None, None


def answers(packs: DataFrame) -> DataFrame:
    """(block, kind, slice, n_keys, told, counts): of the block's n_keys keys in the slice, in order, which ones have other
    counts than the block's own, and those counts; kind 0 has the slice's tokens (n) and different words (v)."""

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lean()
        at, held = None, []
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if at is not None and at != (r["slice"], r["kind"]):
                    yield from _answered(*at, held)
                    held = []
                at = r["slice"], r["kind"]
                held.append(r)
        if held:
            yield from _answered(*at, held)

    n = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packs.repartition(n, "slice").sortWithinPartitions("slice", "kind").mapInArrow(lambda batches: _batches(said(batches), _SAID), _SAID_DDL)


def with_answers(own: np.ndarray, key: np.ndarray, kind: int, said: list[dict], n_slices: int) -> np.ndarray:
    """Counts in the corpus of a block's keys, which are sorted."""
    out = own.copy()
    starts = np.searchsorted(_slice_of(key, n_slices), np.arange(n_slices + 1))
    for r in said:
        if r["kind"] == kind:
            s, e = int(starts[r["slice"]]), int(starts[r["slice"] + 1])
            if r["n_keys"] != e - s:
                raise ValueError("the documents changed between two reads of them")
            out[s:e][np.unpackbits(np.frombuffer(r["told"], np.uint8), count=e - s).astype(bool)] = _uncounted(r["counts"])
    return out


class Automaton:
    """The states and arcs that a block's texts can reach.

    States and words have small numbers; state 0 has no history and an arc for every word. arcs are sorted by state * n_words +
    word, with weights and targets beside them; fail_weight and fail lead to the state of the shorter history. A history
    without a count is no state: the walk stands in the longest one that has a count."""

    def __init__(self, laid: Laid, learn: np.ndarray, said: list[dict], order: int, n: int, v: int, n_slices: int, strengths: tuple[float, ...]) -> None:
        """learn: how often each word of the texts is learnt from."""
        low, high = digests(list(laid.known))
        by = np.lexsort((high, low))
        own = np.bincount(laid.ids, weights=learn, minlength=len(low)).astype(np.int64)
        self.word_counts = np.empty(len(low), np.int64)
        self.word_counts[by] = with_answers(own[by], low[by], 1, said, n_slices)
        self.n_words = max(1, len(low))
        one = (self.word_counts + 0.1) / (n + 0.1 * (v + 1))
        self.base = np.log10(one)
        strength = lambda k: strengths[min(k, len(strengths)) - 1]
        # Of words and histories so far: the state and count after each word of the texts, and each word's probability.
        is_state = (self.word_counts > 0) & (order > 1)
        of_word = np.where(is_state, np.cumsum(is_state), 0)
        fail_weight, fail = [np.zeros(1), np.log10(strength(1) / (self.word_counts[is_state] + strength(1)))], [np.zeros(1 + int(is_state.sum()), np.int64)]
        n_states = len(fail[0])
        codes, weights, targets = [np.arange(len(low))], [self.base], [of_word]
        state, count, p = of_word[laid.ids], self.word_counts[laid.ids], one[laid.ids]
        for k, at, key in laid.ngrams(low, order):
            key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            inverse = inverse.ravel().astype(np.int32)
            total = with_answers(np.bincount(inverse, weights=learn[at], minlength=len(key)).astype(np.int64), key, k, said, n_slices)
            before = np.where(laid.place[at] == 0, 0, count[at - 1])
            here, s = total[inverse], strength(k - 1)
            p[at] = np.where(before > 0, (here + s * p[at]) / (before + s), p[at])
            longest, place = state.copy(), at[first]
            if k < order:
                is_state = total > 0
                number = np.where(is_state, n_states - 1 + np.cumsum(is_state), 0)
                longest[at] = np.where(is_state[inverse], number[inverse], state[at])
                fail_weight.append(np.log10(strength(k) / (total[is_state] + strength(k))))
                fail.append(state[place[is_state]])
                n_states += int(is_state.sum())
            seen = place[total > 0]
            codes.append(state[seen - 1] * self.n_words + laid.ids[seen])
            weights.append(np.log10(p[seen]))
            targets.append(longest[seen])
            count = np.zeros(len(count), np.int64)
            count[at] = here
            state = longest
            del key, first, inverse, total, before, here, longest, place, seen
        code = np.concatenate(codes)
        by = np.argsort(code)
        self.arcs, self.weights, self.targets = code[by], np.concatenate(weights)[by], np.concatenate(targets)[by]
        self.fail_weight, self.fail = np.concatenate(fail_weight), np.concatenate(fail)
        self.state_after = state

    def walk(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The log-probabilities of ids[start:end], each walked from its state, all side by side."""
        order = np.argsort(starts - ends, kind="stable")
        at, length, state = starts[order], (ends - starts)[order], state[order].copy()
        total = np.zeros(len(at))
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step))  # so many have a word left
            word, todo = ids[at[:n] + step], np.arange(n)
            while len(todo):
                code = state[todo] * self.n_words + word[todo]
                arc = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
                hit = self.arcs[arc] == code
                there, none = todo[hit], todo[~hit]
                total[there] += self.weights[arc[hit]]
                state[there] = self.targets[arc[hit]]
                total[none] += self.fail_weight[state[none]]
                state[none] = self.fail[state[none]]
                todo = none
        out = np.empty(len(at))
        out[order] = total
        return out

    def scores(self, laid: Laid) -> np.ndarray:
        """The log-probability of each text. Where the walk stands after a word is known from the words before it, so that long
        texts are walked in pieces at once."""
        n = np.maximum(-(-(laid.ends - laid.starts - 1) // PIECE), 1)
        first = np.repeat(laid.starts + 1, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PIECE
        last = np.minimum(first + PIECE, np.repeat(laid.ends, n))
        return np.add.reduceat(self.walk(laid.ids, first, last, self.state_after[first - 1]), np.cumsum(n) - n) if len(n) else np.zeros(0)


def scores_of(texts: list[str], training: np.ndarray, said: list[dict], order: int, n: int, v: int, n_slices: int, strengths: tuple[float, ...]) -> list[tuple[int, int, float, float]]:
    """(tokens, known tokens, base, score) of a block's texts. training: how often each one is learnt from."""
    if not texts:
        return []
    laid = Laid(texts)
    automaton = Automaton(laid, np.repeat(training, laid.ends - laid.starts), said, order, n, v, n_slices, strengths)
    word = laid.place > 0
    known = np.add.reduceat((word & (automaton.word_counts[laid.ids] > 0)).astype(np.int64), laid.starts)
    base = np.add.reduceat(np.where(word, automaton.base[laid.ids], 0.0), laid.starts)
    return list(zip((laid.ends - laid.starts - 1).tolist(), known.tolist(), base.tolist(), automaton.scores(laid).tolist()))


def _sent(rows: DataFrame) -> DataFrame:
    """(block, body): rows for a block from one task, compressed; equal ones as one with a count."""

    def bodies(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        own = [c for c in table.column_names if c != "block"]
        table = table.group_by(["block", *own]).aggregate([([], "count_all")]).rename_columns(["block", *own, "copies"]).sort_by("block").combine_chunks()
        for s, e in _ranges(table.column("block").to_numpy()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(s, e - s))
            yield pa.RecordBatch.from_pydict({"block": [table.column("block")[s].as_py()], "body": [sink.getvalue().to_pybytes()]}, schema=_arrow("block long, body binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            held.append(batch)
            size += batch.nbytes
            if size > SENT:
                yield from bodies(held)
                held, size = [], 0
        if held:
            yield from bodies(held)

    return rows.mapInArrow(run, "block long, body binary")


def score(docs: DataFrame, held_out: Column, order: int = 2, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, near: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows that aren't held out are learnt.

    near: rows that are read together, such as those of a piece of a file, so that a block's rows are counted by one task and its
    keys leave that task once. It must be the same whenever docs is read."""
    spark = docs.sparkSession
    ship(spark)
    near = F.lit(0) if near is None else near
    rows = docs.select("doc_id", held_out.alias("held_out"), text_or_empty(F.col("text")).alias("text"), F.xxhash64(near).alias("near"))
    # The length in characters bounds the work well enough; a begin and an end count too.
    size, n_near = rows.agg(F.coalesce(F.sum(F.length("text").cast("long") + 8), F.lit(0)), F.count_distinct("near")).first()
    n_blocks = max(1, -(-size // (block_bytes * max(1, n_near))))  # of the rows that are near each other
    n_slices = max(1, -(-size * order // 6 // PER_SLICE))
    rows = rows.withColumn("block", F.xxhash64("near", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))).drop("near")
    said = checkpointed(answers(requests(rows, n_slices, order)))
    n, v = said.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        own = pa.concat_tables([pa.ipc.open_stream(b.as_py()).read_all() for b in left.column("body")])
        held, copies = own.column("held_out").to_numpy(zero_copy_only=False).astype(bool), own.column("copies").to_numpy()
        found = scores_of(own.column("text").to_pylist(), np.where(held, 0, copies), right.to_pylist(), order, n, v, n_slices, strengths)
        lean()
        tokens, known, base, score = map(list, zip(*found))
        made = [own.column("doc_id"), own.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(found), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), own.column("copies")]
        return pa.Table.from_arrays(made, names=[*names, "copies"])

    fields = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, copies long"
    sent = _sent(rows.select("doc_id", "held_out", "text", "block"))
    out = sent.groupBy("block").cogroup(said.filter("kind > 0").groupBy("block")).applyInArrow(walk, fields)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*names)


def op13_lm_scoring(documents: DataFrame) -> DataFrame:
    """Score of every whole text under the automaton of those whose id isn't held out."""
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0, F.lit(True))
    return score(documents, held, near=F.struct(F.input_file_name(), F.input_file_block_start()))
