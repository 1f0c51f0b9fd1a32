"""Conversation structure repair by a rank-compressed dynamic program.

A conversation is repaired by edits (Keep, Rerole, Delete, Insert) so that its roles read `(s?(ua)+)?`, at the least
cost and, among those, with the least audit string (one letter an edit). An edit script is a row of macro edits, one for
each turn: a run of inserts and what happens to the turn (`IIK`, `D`, ...). No macro's letters begin another's, so
two scripts over the same turns compare like their macros one by one, and a layer of the program needs no strings: each of
four states (nothing yet, after s, after u, after a) has its cost, its rank among the states' scripts and a pointer to
the state and macro that it came by. States that another one beats whatever follows are dropped, so layers, their
costs taken from the least, are few, and each step is one look-up in a table that fills as layers are met. Scripts are
reconstructed from the pointers afterwards.

Texts move once, when the repaired texts are hashed; all else works on the turn's place, its class and the SHA-256 of
(role, text). Equal turns are one row with a count, merged before the shuffle. A long conversation lies in several blocks
(see blocks.py): for each state that a block may be entered by, a pass gives the costs and ranks of the states it
may be left by; these compose, and a second pass writes the script of each block.

Defined results: null roles and texts are one space, and so are nulls in the damage's key; a null conv_id is one
conversation, null turns come first; rows of one turn are in the order of the SHA-256 of their role and text, repeated rows
beside each other; an empty table gives an empty result; texts of any length are hashed as they stream; other columns are not looked at.
Differences of turns beyond a long wrap around.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm import blocks as B
from docsift.llm.common import ship, slices

WHITE = "\x09\x0a\x0b\x0c\x0d\x20"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. An insert writes u, or a after u.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_INSERTED = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
#: Macros in the order of their letters. A third insert in a run leads where one leads, so two are enough.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
#: What ends a script in each state, and its cost.
TAIL = {START: ("", 0), AFTER_S: ("II", 2 * INSERT), AFTER_U: ("I", INSERT), AFTER_A: ("", 0)}
#: (beaten, by, least difference of costs from which that holds): the second one reaches what the first does for so much more.
_BEATEN = ((START, AFTER_A, DELETE), (AFTER_S, AFTER_A, 0), (AFTER_U, AFTER_A, INSERT), (AFTER_A, AFTER_U, INSERT), (AFTER_A, START, 0), (AFTER_U, START, INSERT), (AFTER_U, AFTER_S, INSERT))
#: Turns as symbols: 3 * (place of the role's initial in "sua", or 3) + (0 sound, 1 truncated); one more for turns that must go.
MUST_GO = 2
_ROLE = {AFTER_U: "user", AFTER_A: "assistant"}


def _moves(symbol: int) -> list[tuple[int, int, int, int]]:
    """(from, macro, to, cost) of every macro edit of such a turn."""
    initial, kind = divmod(symbol, 3)
    out = []
    for code, letters in enumerate(CODES):
        for start in range(4):
            at, cost = start, INSERT * (len(letters) - 1)
            for _ in letters[:-1]:
                at = _INSERTED[at]
            if letters[-1] == "D":
                out.append((start, code, at, cost + DELETE))
            elif kind != MUST_GO:
                to = _INSERTED[at]
                if letters[-1] == "R":
                    out.append((start, code, to, cost + REROLE + TRUNCATED * kind))
                elif initial == 0 and at == START:
                    out.append((start, code, AFTER_S, cost + KEEP + TRUNCATED * kind))
                elif initial in (1, 2) and to == (AFTER_U, AFTER_A)[initial - 1]:
                    out.append((start, code, to, cost + KEEP + TRUNCATED * kind))
    return out


class Program:
    """Layers met so far, as numbers, and the steps between them."""

    def __init__(self) -> None:
        self.layers: list[tuple[tuple[int, int, int], ...]] = []
        self._known: dict[tuple[tuple[int, int, int], ...], int] = {}
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.pointers: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        self._moves = {s: _moves(s) for s in range(12)}
        self.entries = [self._number(((state, 0, 0),)) for state in range(4)]

    def _number(self, layer: tuple[tuple[int, int, int], ...]) -> int:
        if layer not in self._known:
            self._known[layer] = len(self.layers)
            self.layers.append(layer)
            self.steps.append({})
        return self._known[layer]

    def _step(self, number: int, symbol: int) -> tuple[int, int]:
        """The next layer and what its costs are taken from."""
        before = {state: (cost, rank) for state, cost, rank in self.layers[number]}
        best: dict[int, tuple[int, int, int, int]] = {}
        for start, code, to, cost in self._moves[symbol]:
            if start in before:
                own = (before[start][0] + cost, before[start][1], code, start)
                best[to] = min(best.get(to, own), own)
        costs = {state: x[0] for state, x in best.items()}
        for state, by, least in _BEATEN:
            if state in costs and by in costs and costs[state] > costs[by] + least:
                del best[state], costs[state]
        order = sorted(best, key=lambda state: best[state][1:3])
        low = min(costs.values())
        layer = tuple(sorted((state, costs[state] - low, rank) for rank, state in enumerate(order)))
        out = self.steps[number][symbol] = (self._number(layer), low)
        self.pointers[number, symbol] = {state: (x[3], x[2]) for state, x in best.items()}
        return out

    def run(self, symbols: bytes, entry: int) -> tuple[np.ndarray, int]:
        """The layers before each turn and after the last, and the cost that the last one's costs are to be added to."""
        at, total, path = self.entries[entry], 0, []
        for s in symbols:
            path.append(at)
            step = self.steps[at].get(s) or self._step(at, s)
            at = step[0]
            total += step[1]
        path.append(at)
        return np.asarray(path, np.int32), total

    def exits(self, symbols: bytes, entry: int) -> dict[int, tuple[int, int]]:
        """State after the last turn -> (cost, rank)."""
        path, total = self.run(symbols, entry)
        return {state: (total + cost, rank) for state, cost, rank in self.layers[path[-1]]}

    def script(self, symbols: bytes, entry: int, last: int | None) -> tuple[list[int], list[int], int, int]:
        """Macro of each turn, state before each, the state at the end and the cost; last: the state to end in, or None
        for the best one, whose tail then counts."""
        path, total = self.run(symbols, entry)
        ends = {state: (total + cost, rank) for state, cost, rank in self.layers[path[-1]]}
        if last is None:
            last = min(ends, key=lambda s: (ends[s][0] + TAIL[s][1], ends[s][1]))
        state, macros, states = last, [], []
        for k in range(len(symbols) - 1, -1, -1):
            state, code = self.pointers[int(path[k]), symbols[k]][state]
            macros.append(code)
            states.append(state)
        return macros[::-1], states[::-1], last, ends[last][0]


def compose(reached: dict[int, tuple[int, int]], exits: dict[int, dict[int, tuple[int, int]]]) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """What a block's exits make of the states reached before it: state -> (cost, rank), and state -> entry."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for entry, (cost, rank) in reached.items():
        for state, (more, place) in exits[entry].items():
            own = (cost + more, rank, place, entry)
            best[state] = min(best.get(state, own), own)
    order = sorted(best, key=lambda state: best[state][1:3])
    return {state: (best[state][0], order.index(state)) for state in best}, {state: x[3] for state, x in best.items()}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the damage that the query asks for; rows with no copies are dropped ones."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def address(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _kinds(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, addr, n, initial, fault, again): equal rows of a turn as one. fault: 0 none, 1 truncated, 2 blank;
    again: role and text stand in an earlier turn. A conversation's dropped rows are left as rows with n = 0."""
    here = F.col("copies") > 0
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    kinds = (
        rows.select(
            "conv_id",
            F.when(here, F.col("turn")).alias("turn"),
            F.when(here, F.col("addr")).alias("addr"),
            F.col("copies"),
            F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
            F.when(body == "", 2).when(~F.substring(body, -1, 1).isin(".", "!", "?"), 1).otherwise(0).alias("fault"),
        )
        .groupBy("conv_id", "turn", "addr")
        .agg(F.sum("copies").alias("n"), F.min("initial").alias("initial"), F.min("fault").alias("fault"))
    )
    firsts = kinds.filter("n > 0").groupBy(F.col("conv_id").alias("_c"), F.col("addr").alias("_a")).agg(F.min(F.struct("turn")).alias("_first"))
    joined = kinds.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("addr") == F.col("_a")), "left")
    again = F.coalesce(~F.col("_first")["turn"].eqNullSafe(F.col("turn")), F.lit(False))
    return joined.select("conv_id", "turn", "addr", "n", "initial", "fault", F.when(F.col("_first").isNull(), False).otherwise(again).alias("again"))


class _Block:
    """A block's columns."""

    def __init__(self, t: pa.Table) -> None:
        self.n, self.initial, self.fault = (t.column(c).to_numpy() for c in ("n", "initial", "fault"))
        self.again = t.column("again").to_numpy(zero_copy_only=False)
        self.turn, self.addr = t.column("turn").to_pylist(), t.column("addr").to_pylist()

    def rows(self, s: int, e: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of s to e: symbols, initials, the kind that each is of, and its fault as counted (0 none, 1
        truncated, 2 blank, 3 duplicate)."""
        of = np.repeat(np.arange(s, e), self.n[s:e])
        copy = np.zeros(len(of), bool)
        copy[1:] = of[1:] == of[:-1]
        fault, initial = self.fault[of], self.initial[of]
        own = np.where(fault == 2, 2, np.where(copy | self.again[of], 3, fault))
        symbols = np.where(own >= 2, MUST_GO, 3 * initial + own).astype(np.uint8)
        return symbols.tobytes(), initial, of, own

    def turns(self, s: int, e: int) -> list[int]:
        """The different turns, ascending."""
        return list(dict.fromkeys(t for t in self.turn[s:e] if t is not None))


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True
_PROGRAM = None


def _program() -> Program:
    """One for each worker: layers met in one conversation serve the next."""
    global _PROGRAM
    if _PROGRAM is None:
        _PROGRAM = Program()
    return _PROGRAM


def _block_summary(block: _Block, s: int, e: int) -> dict[str, Any]:
    """What a block of a conversation is to its neighbours."""
    symbols, initial, _, _ = block.rows(s, e)
    exits = [list(_program().exits(symbols, entry).items()) for entry in range(4)]
    return {"exits": exits, "last": int(initial[-1]) if len(initial) else None, "turn": max(block.turns(s, e), default=None)}


def _entries(found: list[tuple[int, list[tuple[Any, Any]]]]) -> dict[tuple[int, bool], tuple[int, int | None, int | None, int | None]]:
    """(block, whether it is the conversation's first) -> state before the block, state after it (None: its end), the
    initial before it and the turn before it."""
    out = {}
    for chain in B.chains(found):
        reached, back, before = {START: (0, 0)}, [], []
        last, turn = None, None
        for _, said in chain:
            before.append((last, turn))
            reached, came = compose(reached, {e: {s: tuple(x) for s, x in exits} for e, exits in enumerate(said["exits"])})
            back.append(came)
            last = said["last"] if said["last"] is not None else last
            turn = said["turn"] if said["turn"] is not None else turn
        state = min(reached, key=lambda s: (reached[s][0] + TAIL[s][1], reached[s][1]))
        leave: int | None = None
        for k in range(len(chain) - 1, -1, -1):
            entry = back[k][state]
            out[chain[k][0], k == 0] = (entry, leave, *before[k])
            state = leave = entry
    return out


_STEP = pa.schema(
    [("conv_id", pa.int64()), ("grp", pa.int32()), ("block", pa.int32()), ("turn", pa.int64()), ("addr", pa.binary()), ("tag", pa.int32()), ("role", pa.string()), ("text", pa.string())]
    + [("audit", pa.string()), ("after", pa.string())]
    + [(c, pa.int64()) for c in ("n_turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "cost")]
)
_STEP_DDL = "conv_id long, grp int, block int, turn long, addr binary, tag int, role string, text string, audit string, after string, n_turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, cost long"


def _scripts(entries: dict[tuple[int, bool], tuple[int, int | None, int | None, int | None]]):
    """For each conversation of a block: its summary (grp 0), and for turns that stay or have inserts beside them what to
    write (grp 1): text holds the roles to insert before it, role its own (null: as it is; empty: it goes), after those behind it."""

    def work(number: int, conv: int | None, first: bool, last: bool, block: _Block, s: int, e: int) -> list[tuple]:
        alone = (START, None, None, None)
        entry, leave, initial_before, turn_before = entries.get((number, False), alone) if first else alone
        if last and (number, True) in entries:
            entry, leave, initial_before, turn_before = entries[number, True]
        symbols, initial, of, own = block.rows(s, e)
        macros, states, end, cost = _program().script(symbols, entry, leave)
        tail, more = ("", 0) if leave is not None else TAIL[end]
        turns = block.turns(s, e)
        chain = initial if initial_before is None else np.concatenate(([initial_before], initial))
        faults = np.bincount(own, minlength=4).tolist()
        illegal = int((~_LEGAL[chain[:-1], chain[1:]]).sum()) if len(chain) > 1 else 0
        audit = "".join([CODES[m] for m in macros]) + tail
        n_turns = len(turns) - bool(turns and turns[0] == turn_before)
        out = [(conv, 0, number, None, None, 0, None, None, audit, _inserts(end, len(tail))[0], n_turns, min(turns, default=None), max(turns, default=None), faults[2], faults[3], faults[1], illegal, cost + more)]
        kinds: dict[int, list] = {}
        for k, code in enumerate(macros):
            letters = CODES[code]
            if letters != "D":
                put, at = _inserts(states[k], len(letters) - 1)
                before, role, after = kinds.get(int(of[k]), ("", "", ""))
                if role == "":
                    before = "\n".join(filter(None, (before, put)))
                    role = "" if letters[-1] == "D" else None if letters[-1] == "K" else _ROLE[_INSERTED[at]]
                else:
                    after = "\n".join(filter(None, (after, put)))
                kinds[int(of[k])] = (before, role, after)
        nothing = (None,) * 8
        out += [(conv, 1, 0, block.turn[i], block.addr[i], 0, role, before, None, after, *nothing) for i, (before, role, after) in kinds.items()]
        return out

    return work


def _inserts(state: int, n: int) -> tuple[str, int]:
    """The roles of n inserts, one a line, and the state behind them."""
    roles = []
    for _ in range(n):
        state = _INSERTED[state]
        roles.append(_ROLE[state])
    return "\n".join(roles), state


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class _Writer:
    """The result of one conversation, as its summaries, steps and texts come by in order."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.audit, self.counts = conv, [], dict.fromkeys(_COUNTS, 0)
        self.n_turns, self.low, self.high, self.tail = 0, None, None, ""
        self.hash, self.lines = hashlib.sha256(), 0
        self.pending: tuple[Any, Any] | None = None

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserted(self, roles: str | None) -> None:
        for role in roles.split("\n") if roles else ():
            self.line(role, "")

    def summary(self, r: dict[str, Any]) -> None:
        self.audit.append(r["audit"])
        for c in _COUNTS:
            self.counts[c] += r[c]
        self.n_turns += r["n_turns"]
        self.low = r["low"] if self.low is None else self.low
        self.high = r["high"] if r["high"] is not None else self.high
        self.tail = r["after"] or self.tail

    def step(self, r: dict[str, Any]) -> None:
        self.close()
        self.inserted(r["text"])
        self.pending = (r["turn"], r["addr"]), r["role"], r["after"]
        if r["role"] == "":
            self.close()

    def close(self) -> None:
        if self.pending:
            after, self.pending = self.pending[2], None
            self.inserted(after)

    def text(self, r: dict[str, Any]) -> None:
        if self.pending and self.pending[0] == (r["turn"], r["addr"]):
            self.line(r["role"] if self.pending[1] is None else self.pending[1], r["text"])
            self.close()

    def row(self) -> tuple:
        self.close()
        self.inserted(self.tail)
        gaps = 0 if self.low is None else _wrapped(self.high - self.low + 1 - self.n_turns)
        return (self.conv, gaps, *self.counts.values(), "".join(self.audit), self.hash.hexdigest(), self.lines)


def repair(rows: DataFrame) -> DataFrame:
    """Faults and repair of each conversation of (conv_id, turn, role, text, copies)."""
    ship(rows.sparkSession)
    rows = rows.withColumn("addr", address(F.col("role"), F.col("text")))
    stored = B.sorted_blocks(_kinds(rows), "conv_id", ["turn", "addr"])
    entries = _entries(B.edges(stored, "conv_id", _Block, _block_summary))
    steps = B.each_group(stored, "conv_id", _Block, _scripts(entries), _STEP_DDL, _STEP)
    texts = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("grp"), F.lit(0).alias("block"), "turn", "addr", F.lit(1).alias("tag"), "role", "text")
    order = ("conv_id", "grp", "block", "turn", "addr", "tag")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = steps.unionByName(texts, allowMissingColumns=True).repartition(n, "conv_id").sortWithinPartitions(*order)
    names = [c.split()[0] for c in _OUT.split(", ")]
    arrow = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in slices(batches):
            for r in batch.to_pylist():
                if writer is None or writer.conv != r["conv_id"]:
                    if writer is not None:
                        done.append(writer.row())
                    writer = _Writer(r["conv_id"])
                (writer.summary if r["grp"] == 0 else writer.text if r["tag"] else writer.step)(r)
            if done:
                yield B.batch_of(done, arrow)
                done = []
        if writer is not None:
            yield B.batch_of([writer.row()], arrow)

    return streamed.mapInArrow(write, _OUT)


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    """Damage, faults and cheapest repair of every conversation."""
    return repair(damaged(conversations))
