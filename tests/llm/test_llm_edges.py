"""Completeness, stored state, edges of every operator, and plain versions beside them."""

from __future__ import annotations

import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import bpe, decontam, langid, license_scan, mpeg_media, pii, secrets, sharding, simhash, url_filter
from docsift.session import shared_root

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Empty tables, nulls in every column, long texts


def operators(spark):
    benchmark = spark.createDataFrame([(1, "two words"), (None, "nulls here"), (2, None)], "item_id int, text string")
    return {
        "op1": pii.op1_pii,
        "op2": lambda d: url_filter.op2_url_filter(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))),
        "op3": lambda d: decontam.op3_decontam(d, benchmark),
        "op4": sharding.op4_sharding,
        "op5": secrets.op5_secrets,
        "op6": bpe.op6_bpe,
        "op7": langid.op7_langid,
        "op8": simhash.op8_simhash,
        "op9": license_scan.op9_license,
        "op10": mpeg_media.op10_mpeg_media,
    }


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_edges(spark, name):
    op = operators(spark)[name]
    long = "x" * 300_000 + " " + "word " * 60_000
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, "two words", None, "s", 9), (1, "two words", None, "s", 9), (2, long, "en", "s", len(long)), (3, "two words", "en", "s", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert op(docs.limit(0)).count() == 0
    got = op(docs)
    assert got.count() == len(rows) and len(set(got.columns)) == len(got.columns)


def test_pipeline_stages_on_empty_and_unlabelled(spark):
    import corpus_pipeline

    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    rows = [(1, "one two three", None, "s", 13), (1, "something else entirely", None, "s", 23), (None, "and a third text", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 3, name
    last = corpus_pipeline.encode(spark, docs.withColumns({"_text": F.lit("mine"), "n_tokens": F.lit("old")}).drop("lang"), SF)
    assert last.columns == ["doc_id", "source", "n_chars", "_text", "n_tokens", "token_ids"]
    assert {(r["_text"], r["n_chars"]) for r in last.collect()} == {("mine", 13), ("mine", 23), ("mine", None)}


# op1, op5


def test_context_on_both_sides(spark):
    texts = ["123-45-6789 is my social security number", "123-45-6789 " + "x " * 40 + "social", "social " + "x " * 40 + "123-45-6789", "a@b.co mail", "mail a@b.co"]
    got = {r["doc_id"]: r["pii"] for r in pii.scan_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(got[i]) for i in range(5)] == [1, 0, 0, 1, 1]
    assert got[3][0]["score"] == 0.7 and got[4][0]["score"] == 1.0


def test_second_run_scans_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(0, "token = abcdef1"), (1, "nothing"), (2, "token = abcdef1"), (3, None)], "doc_id long, text string")
    a = sorted(rows_of(secrets.op5_secrets(first, path)))
    assert spark.read.parquet(path).count() == 3
    assert sorted(rows_of(secrets.op5_secrets(first, path))) == a and spark.read.parquet(path).count() == 3
    more = first.unionByName(spark.createDataFrame([(4, "password: abcdef1")], first.schema))
    got = sorted(rows_of(secrets.op5_secrets(more, path)))
    assert got[:4] == a and got[4][1] == 1 and spark.read.parquet(path).count() == 4
    ledger = secrets.read_ledger(spark, path)
    assert secrets.update_ledger(more, ledger, "next", few=0).count() == secrets.update_ledger(more, ledger, "next").count() == 4
    assert secrets.update_ledger(more, ledger, few=0).isEmpty()


# op2


def test_join_path_equals_inline(spark):
    rnd = random.Random(7)
    words = ["ads", "x1", "casino", "spam-farm", "en", "de", "com", "img"]
    urls = [None, "", "x"] + [f"http://{rnd.choice(words)}.{rnd.choice(words)}.com/{rnd.choice(words)}/{rnd.choice(words)}?q" for _ in range(150)]
    rules = [url_filter.UrlRule(p, "block") for p in ("ads", "*img*", "||com^", "/x1/", "spam-farm.")]
    rules += [url_filter.UrlRule(f"/{a}/{b}", rnd.choice(["block", "allow"]), rnd.randrange(3)) for a in words for b in words]
    pages = spark.createDataFrame([(rnd.choice([1, 2, None]), u) for u in urls * 2], "page_id long, url string")
    inline = url_filter.judge_urls(pages, tuple(rules))
    joined = url_filter.judge_urls(pages, tuple(rules), max_inline=1)
    key = lambda df: sorted(((r["page_id"], r["url"], r["match"] and r["match"]["name"]) for r in df.collect()), key=repr)
    assert key(inline) == key(joined) and sum(k[2] is not None for k in key(inline)) > 50


def test_rule_files(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! a comment\n/ads/\n@@||good.com/ads/\n\n/ads/\n")
    rules = url_filter.read_rules(spark, str(tmp_path / "rules.txt"))
    pages = spark.createDataFrame([(0, "http://a.com/ads/1"), (1, "http://www.good.com/ads/1"), (2, "http://good.com/")], "page_id long, url string")
    got = {r["page_id"]: r["match"] and r["match"]["action"] for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {0: "block", 1: "allow", 2: None} and len(rules) == 2


# op3


def test_slices_and_null_items(spark):
    docs = [(0, "nulls here and two words"), (1, "two words"), (2, None), (3, "item one is here now")]
    items = [(None, "nulls here"), ("null", "two words"), ("1", "item one")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = decontam.brute_force(docs, items)
    assert sorted(rows_of(decontam.op3_decontam(d, b))) == sorted(want) and want[0][3] == 2
    sliced = decontam.scan_benchmark(d, b, max_bytes=12).select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long"))
    assert sorted(rows_of(sliced)) == sorted(r[:4] for r in want)


# op4


def test_stored_maps(spark, tmp_path):
    path = str(tmp_path / "maps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shard = lambda df: {r["doc_id"]: (r["vslot"], r["shard"], r["map_version"]) for r in df.collect()}
    first = shard(sharding.op4_sharding(docs, maps=path))
    again = shard(sharding.op4_sharding(docs, maps=path))
    assert {v[2] for v in first.values()} == {1} and {v[2] for v in again.values()} == {2}
    assert all(first[i][0] == again[i][0] for i in first) and sum(first[i][1] != again[i][1] for i in first) < len(first) / 20
    grown = shard(sharding.op4_sharding(docs, 9, maps=path))
    moved = [i for i in again if again[i][1] != grown[i][1]]
    assert sum(grown[i][1] == 8 for i in moved) > len(moved) / 2 and 0 < len(moved) < len(first) / 3
    m = sharding.SlotMap(7, 5, (0, 1, 2, 0))
    m.save(spark, path)
    m.save(spark, path)
    assert sharding.SlotMap.load(spark, path, 7) == m and sharding.SlotMap.load(spark, path) == m


def test_many_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES", 7)
    docs = spark.createDataFrame([(1, "same")] * 40 + [(2, "b"), (3, None)], "doc_id long, text string")
    got = sharding.op4_sharding(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 42 and all(sorted(s) == list(range(len(s))) for s in by.values())


# op6


def test_other_vocabularies_are_refused():
    good = {"model": {"type": "BPE", "end_of_word_suffix": "</w>"}, "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": bpe.SPLIT}}, {"type": "ByteLevel"}]}}
    bpe.check_shape(good)
    for bad in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "WordPiece"}}, {"decoder": {"type": "ByteLevel"}}):
        with pytest.raises(ValueError):
            bpe.check_shape(good | bad)


# op7: plain interpolated Kneser-Ney with dictionaries


def plain_kneser_ney(texts, order, letters):
    words = Counter(w for t in texts for w in langid.words_of(t))
    raw = [Counter() for _ in range(order + 1)]
    for w, c in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    raw[n][s[i - n + 1 : i + 1]] += c
    counts = [None] * (order + 1)
    counts[order] = dict(raw[order])
    for n in range(1, order):
        own = Counter()
        for g in raw[n + 1]:
            own[g[1:]] += 1  # different characters before it
        for w, c in words.items():  # n-grams that begin with the word's first blank keep their count
            s = f" {w} "
            if len(s) >= n and n > 1:
                own[s[:n]] += c
        counts[n] = dict(own)
    discount = {}
    for n in range(1, order + 1):
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        discount[n] = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(g):
        n = len(g)
        if n == 0:
            return 1.0 / (letters + 1)
        own = {h: v for h, v in counts[n].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        return max(counts[n].get(g, 0) - discount[n], 0) / total + min(1.0, discount[n] * len(own) / total) * p(g[1:])

    return lambda word: [p(f" {word} "[max(0, i - order + 1) : i + 1]) for i in range(1, len(word) + 2)]


def test_kneser_ney_against_plain():
    samples = {"a": ["abra cadabra abba bar bar"] * 3, "b": ["ola hola lola all hall"] * 3}
    model = langid.fit(samples)
    letters = len(set("".join(t for own in samples.values() for t in own)))
    for i, lang in enumerate(model.langs):
        plain = plain_kneser_ney(samples[lang], langid.ORDER, letters)
        for word in ("abra", "hola", "bar", "x", "zzz", "abrahall", "l"):
            codes, inside, _ = langid._layout([word])
            got = np.exp(model.char_logs(codes, inside))[1:, i]
            assert np.allclose(got, plain(word)), (lang, word)
    for i in range(2):
        for before in ("", "a", "ab", "hol"):
            plain = plain_kneser_ney(samples[model.langs[i]], langid.ORDER, letters)
            every = sorted(set("abracdhol "))
            total = sum(np.exp(model.char_logs(*langid._layout([before + c])[:2]))[len(before) + 1, i] for c in every if c != " ")
            blank = np.exp(model.char_logs(*langid._layout([before or "a"])[:2]))[-1, i] if before else 0.0
            assert total + blank <= 1 + 1e-9 and plain is not None


def test_letters_and_long_words(spark):
    assert langid.words_of("½ ² Ⅷ _ 12 é東x9y") == ["é東x", "y"]
    model = langid.fit({"a": ["abra cadabra"] * 6, "b": ["hola lola"] * 6})
    word = "abrahola" * 5000
    assert np.allclose(model.long_word_score(word, 777), model.word_scores([word])[0])
    assert langid.Scorer(model).predictions(["½ ²", None, "12"]) == [("und", 0.0, None, True)] * 3
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("der hund und", "de")] * 20 + [("zu lang " * 40, "xx")] * 3)]
    fitted = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_chars=50)
    assert fitted.langs == ["de", "en", "xx"]
    many = spark.createDataFrame([(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} text", f"l{i:03d}") for i in range(230)], "doc_id long, text string, lang string")
    assert len(langid.train(many).langs) == 230


# op9


def test_every_notice_of_a_row(spark):
    short = [(n, t) for n, t in license_scan.TEMPLATES if len(t) < 95]
    rnd = random.Random(3)
    rows, want = [], []
    for i in range(60):
        picks = [rnd.choice(short) for _ in range(rnd.randrange(1, 6))]
        gap = ["", "\n", " so it said. ", " x y z "][i % 4]
        rows.append((i, gap.join([" start. ", *(f" {t} " for _, t in picks), " end."])))
        want.append([n for n, _ in picks])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in license_scan.scan_licenses(docs).collect():
        assert [h["license"] for h in r["licenses"]] == want[r["doc_id"]], r["text"]
        assert all(h["coverage"] == 1.0 for h in r["licenses"])
        spans = [(h["start"], h["end"]) for h in r["licenses"]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_siblings_and_insertions():
    index = license_scan.Index()
    names = lambda t: [h.license for h in index.scan(license_scan.words_of(t))]
    for name, text in license_scan.TEMPLATES:
        assert names(f"x {text} y") == [name] and names(f"{text} {text}") == [name] * 2
    words = license_scan.TEMPLATES[1][1].split()
    broken = lambda n: " ".join(words[:35] + ["other"] * n + words[35:])
    assert names(broken(12)) == ["MIT"] and names(broken(license_scan.MAX_GAP)) == ["MIT"] and names("nothing of the kind here") == []
    few = index.scan(license_scan.words_of(" ".join(w for i, w in enumerate(words) if i % 9)))
    assert len(few) == 1 and 0.8 < few[0].coverage < 1


# op10


def frames(n, bits=9):
    head = bytes((0xFF, 0xFB, bits << 4, 0xC0))
    return [head + bytes(mpeg_media.parse_header(head).length - 4) for _ in range(n)]


def test_vbri_table():
    sound = frames(10)
    size = len(sound[0])
    entries = [2 * size] * 5
    info = bytearray(frames(1)[0])
    table = struct.pack(">4s3H2I4H", b"VBRI", 1, 0, 0, size * 11, 10, 5, 1, 2, 2) + struct.pack(">5H", *entries)
    info[36 : 36 + len(table)] = table
    s = mpeg_media.parse_stream(bytes(info) + b"".join(sound))
    assert (s.vbr, s.vbr_frames, s.vbr_bytes, len(s.offsets)) == ("VBRI", 10, size * 11, 10)
    assert s.seek_points == [size * (1 + 2 * k) for k in range(1, 6)] and s.seek_ok
    wrong = bytearray(info)
    wrong[62:64] = struct.pack(">H", 9 * size)
    assert mpeg_media.parse_stream(bytes(wrong) + b"".join(sound)).seek_ok is False


def test_xing_table_and_layer_one():
    data = mpeg_media.write_stream(mpeg_media.padded("some text " * 9000)[1])
    s = mpeg_media.parse_stream(data)
    assert s.seek_ok and len(s.seek_points) == 100 and s.samples == 1152 * len(s.offsets)
    at = data.index(b"Xing") + 16 + 50
    assert mpeg_media.parse_stream(data[:at] + b"\x01" + data[at + 1 :]).seek_ok is False
    head = bytes((0xFF, 0xFE, 0x90, 0xC0))  # MPEG-1 Layer I, checksum, mono
    f = mpeg_media.parse_header(head)
    side = bytes(range(16))
    body = head + struct.pack(">H", mpeg_media.crc16(head[2:4] + side)) + side
    frame = body + bytes(f.length - len(body))
    good = mpeg_media.parse_stream(frame * 3)
    assert (f.layer, good.checked, good.bad, good.samples) == (1, 3, 0, 3 * 384)
    assert mpeg_media.parse_stream(frame + frame[:8] + b"\xee" + frame[9:] + frame).bad == 1
    assert mpeg_media.allocation_bytes(f, 0xC0) == 16


def test_shared_root_is_required_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        shared_root(Session())
    assert shared_root(spark)


def test_broken_notices_keep_their_names():
    """Every notice of 30 words and more, broken at three places with words put in, is found once by its own name."""
    index = license_scan.Index()
    names = lambda words: [h.license for h in index.scan(license_scan.words_of(" ".join(words)))]
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        if len(words) < 30:
            continue
        for gap in (4, 10, 24, license_scan.MAX_GAP):
            for share in (0.25, 0.5, 0.75):
                at = int(len(words) * share)
                assert names(["intro", *words[:at], *(f"w{i}" for i in range(gap)), *words[at:], "end"]) == [name], (name, gap, share)
        halves = names([*words[: len(words) // 2], *["x"] * 60, *words[len(words) // 2 :]])
        # GPL notices begin alike: a half tells the family only. Two halves of BSD-3-Clause hold a BSD-2-Clause notice.
        assert halves in ([], [name], ["GPL"], ["BSD-2-Clause"]), (name, halves)
    assert names("Licensed under the GNU Affero General Public License as published, or no GPL at all".split()) == []


def test_language_without_letters_is_not_learnt(spark):
    model = langid.fit({"a": ["123", "45 6"], "b": ["hello world", "hello there"]})
    assert model.langs == ["b"] and langid.Scorer(model).predictions(["bonjour", "123", None])[0][0] == "b"
    assert langid.fit({"a": ["123"]}).langs == []
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("123", "a"), ("7 8", "a"), ("9", "a"), ("hello world", "b"), ("hello there", "b"), ("good hello", "b")] * 4)], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).select("text", "lang_pred").distinct().collect()
    assert {r["lang_pred"] for r in got} == {"b", "und"}
    none = langid.identify(docs, langid.train(docs.filter("lang = 'a'")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
