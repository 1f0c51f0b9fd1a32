"""Repair and prefix trie of conversations against plain versions that hold strings and whole prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from docsift.llm import blocks, conversation_sql, conversations, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def ordered(own):
    return sorted(own, key=lambda q: (q[0] is not None, q[0] or 0, hashlib.sha256(f"{len(q[1])}:{q[1]}{q[2]}".encode()).digest()))


INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}


def plain_repair(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        own = by[c]
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            own += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return {c: plain_script(ordered(own)) for c, own in by.items()}


def plain_script(own):
    seen, faults = set(), []
    for _, r, x in own:
        body = x.strip(WHITE)
        faults.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    best = {0: (0, "", ())}

    def with_inserts(q, v):
        for _ in range(4):
            yield q, v
            q = INSERTED[q]
            v = (v[0] + 2, v[1] + "I", v[2] + (NAMES[q] + ":",))

    for (_, r, x), fault in zip(own, faults):
        found = defaultdict(list)
        for q0, v0 in best.items():
            for q, (c, s, o) in with_inserts(q0, v0):
                found[q].append((c + 3, s + "D", o))
                if fault not in ("b", "d"):
                    more, to = fault == "t", INSERTED[q]
                    found[to].append((c + 2 + more, s + "R", o + (NAMES[to] + ":" + x,)))
                    if r[:1] == "s" and q == 0 or r[:1] == "u" and q != 2 or r[:1] == "a" and q == 2:
                        found[1 if r[:1] == "s" else to].append((c + more, s + "K", o + (r + ":" + x,)))
        best = {q: min(v) for q, v in found.items()}
    c, s, o = min(v for q0, v0 in best.items() for q, v in with_inserts(q0, v0) if q in (0, 3))
    turns = {t for t, _, _ in own if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), "cost": c, "audit": s, "repaired_sha256": hashlib.sha256("\n".join(o).encode()).hexdigest(),
    }


def made(seed, n, convs):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "", "tool", None, "User", "u", "a"]
    return [(rnd.choice(convs), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(["Hi.", "Yes", "No!", "ok? ", " ", "", None, "é.\n", "x "])) for _ in range(n)]


@pytest.fixture()
def many_blocks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def check_repair(spark, rows):
    got = {r["conv_id"]: r.asDict() for r in conversations.op11_conversation_repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_repair(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert {k: got[c][k] for k in w} == w, c


def test_repair_against_strings(spark):
    check_repair(spark, made(5, 1500, [None, *range(-5, 200)]))
    check_repair(spark, [])


def test_repair_of_a_long_conversation(many_blocks):
    """One conversation over most blocks, with others before and behind it; a text of a megabyte."""
    rnd = random.Random(2)
    long = [(1, i if i % 50 else None, rnd.choice(["user", "assistant", "system", "tool"]), f"{rnd.choice(['Hi', 'Yes.'])}{rnd.randrange(300)}{rnd.choice(['.', ''])}") for i in range(1200)]
    check_repair(many_blocks, long + made(3, 120, [0, 2, 3]) + [(4, 0, "user", "word " * 200_000 + ".")])


def test_programs_compose():
    """A conversation cut anywhere gives what it gives whole."""
    program, rnd = conversations.Program(), random.Random(1)
    for _ in range(300):
        symbols = bytes(rnd.choice([0, 1, 3, 4, 6, 7, 9, 2]) for _ in range(rnd.randrange(1, 30)))
        cut = rnd.randrange(len(symbols) + 1)
        reached, _ = conversations.compose({0: (0, 0)}, {e: program.exits(symbols[:cut], e) for e in range(4)})
        reached, _ = conversations.compose(reached, {e: program.exits(symbols[cut:], e) for e in range(4)})
        state, whole = min(reached, key=lambda s: (reached[s][0] + conversations.TAIL[s][1], reached[s][1])), program.script(symbols, 0, None)
        assert (state, reached[state][0]) == whole[2:]
    assert len(program.layers) < 500


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in ordered(v)] for c, v in by.items()}
    members = defaultdict(list)
    for c, path in own.items():
        if c is not None:
            h = zlib.crc32(str(c).encode()) % 9
            path = own.get(c - int(math.fmod(c, 5)), [])[:h] + path[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, m in members.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1].encode()) if key else 0
            leaves[key[:d]] += key not in kids
    least = lambda m: min((c for c, _ in m if c is not None), default=None)
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, whole in m if whole and c is not None))).encode()).hexdigest()
    return [(least(m), len(k), least(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(m)) for k, m in list(members.items())]


def check_trie(spark, rows, **parameters):
    got = sorted((tuple(r) for r in prefix_trie.op12_prefix_trie(spark.createDataFrame(rows, SCHEMA), **parameters).collect()), key=str)
    assert got == sorted(plain_trie(rows), key=str)


def test_trie_against_prefixes(spark):
    check_trie(spark, made(6, 1200, [None, *range(-20, 150)]))
    check_trie(spark, [])


def test_trie_splits_what_collides(spark):
    """Fingerprints of a few bits collide nearly always."""
    check_trie(spark, made(7, 400, list(range(50))), moduli=((7, 3), (5, 2)))


def test_trie_of_long_and_equal_conversations(many_blocks):
    long = [(c, i, "user", f"t{i if c < 4 or i < 100 else i * c}") for c in (0, 1, 2, 5, 6) for i in range(160)]
    same = [(c, i, "user", "same") for c in range(100, 300) for i in range(3)]
    check_trie(many_blocks, long + same + made(3, 60, [11, 12, 13]))


def test_blocks_hold_groups_in_order(many_blocks):
    rows = blocks.sorted_blocks(many_blocks.createDataFrame([(1, i) for i in range(300)] + [(None, 1), (2, 5)], "g long, x long"), "g", ["x"])
    found = blocks.edges(rows, "g", lambda t: t.column("x").to_pylist(), lambda x, s, e: x[s:e])
    (chain,) = blocks.chains(found)
    assert len(chain) > 2 and [x for _, own in chain for x in own] == list(range(300))


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for op, sql in ((conversations.op11_conversation_repair, conversation_sql.REPAIR_SQL), (prefix_trie.op12_prefix_trie, conversation_sql.TRIE_SQL)):
        got = op(table)
        names = ", ".join(got.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(f"select {names} from ({sql})").fetchall()))


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(0, 1, "user", "Hi.", "a", 1, 2), (0, 2, "assistant", "Ho.", "b", 1, 2)], SCHEMA + ", addr string, n long, depth long")
    assert conversations.op11_conversation_repair(df).count() == 1
    assert prefix_trie.op12_prefix_trie(df).count() == 3
