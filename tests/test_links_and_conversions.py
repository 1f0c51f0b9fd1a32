"""Anchors of pages against a plain parser and resolver; conversions kept by content."""

from __future__ import annotations

import os
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from docsift.operators.page_links import page_links, resolved
from docsift.plans import ingest
from docsift.sources.conversions import Conversions


class Plain(HTMLParser):
    """Anchors of well-formed pages: (href, label)."""

    def __init__(self):
        super().__init__()
        self.links, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            found = {}
            for k, v in attrs:
                found.setdefault(k, v)
            self.links.append([found.get("href"), found.get("aria-label"), ""])
            self.open = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.links[-1][2] += data


def test_resolved_addresses(spark):
    bases = ["http://h.org/a/b/c.html?q=1#f", "https://h.org", "http://h.org/", "http://h.org/x/"]
    hrefs = ["/r", "r", "./r", "../r", "../../../r", "r/../s/./t", "?z=1", "#top", "//o.org/p", "https://k.org/../l", "mailto:a@b.c", "r?x=/../y#z", "..", ".", "a/..", "/a/b/../../c"]
    df = spark.createDataFrame([(h, b) for h in hrefs for b in bases], "h string, b string")
    for r in df.withColumn("u", resolved(F.col("h"), F.col("b"))).collect():
        want = r["h"] if ":" in r["h"] else urljoin(r["b"], r["h"])
        assert r["u"].rstrip("/") == want.rstrip("/"), r
    assert [r[0] for r in spark.createDataFrame([("x", ""), ("http://a.b/c", "")], "h string, b string").select(resolved(F.col("h"), F.col("b"))).collect()] == ["x", "http://a.b/c"]


def test_anchors_against_a_plain_parser(spark):
    rng = random.Random(3)
    attributes = [' href="/a&amp;b"', " href='x/y'", " HREF=plain", ' title="a > b href=no"', ' data-href="no"', ' aria-label="named  by&lt;aria"', " hidden", ' href = "?q=2"']
    pieces = ["text ", "<b>bold</b> ", "&amp;", "\n  ", "Ж", "<br>", "1 < 2 "]
    html = []
    for _ in range(60):
        page = ""
        for _ in range(rng.randrange(6)):
            page += rng.choice(["<p>", "<!-- <a href='no'>no</a> -->", "<script>'<a href=no>no</a>'</script>", "<article>", "<abbr>x</abbr>"])
            page += f"<{rng.choice('aA')}{''.join(rng.sample(attributes, rng.randrange(5)))}>{''.join(rng.choice(pieces) for _ in range(rng.randrange(4)))}</a>"
        html.append(page)
    url = "http://h.org/d/p.html"
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id int, url string, html string")
    got = {}
    for r in page_links(df).collect():
        got[r["page_id"], r["url"]] = (r["position"], r["label"])
    want = {}
    for i, h in enumerate(html):
        p = Plain()
        p.feed(h)
        for n, (href, aria, text) in enumerate(p.links):
            label = " ".join((aria or text).split())
            if href is not None and label:
                want.setdefault((i, urljoin(url, href)), (n, label))
    assert got == want and len(want) > 60


def test_broken_pages(spark):
    rows = [
        (0, "http://h.org/", "<a href=/one>one<a href='/two'>two <i>x"),
        (1, "http://h.org/", '<a href="/open>lost</a> <a href=/next>next</a>'),
        (2, "http://h.org/", "<!-- <a href=/no>no</a>"),
        (3, None, "<a href=x>rel</a>"),
        (4, "http://h.org/", None),
        (5, "http://h.org/", ""),
        (6, "http://h.org/", '<base href="http://o.org/k/"><a href=x>based</a><a href=x>again</a><a>none</a><a href=/e> </a>'),
        (7, "http://h.org/", "<a href='https://docs.google.com/spreadsheets/d/S1/edit#gid=5'>" + "long " * 50_000 + "</a>"),
        (7, "http://h.org/", "<a " + "x='1' " * 20_000 + "href=/far>far</a>"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("label", F.lit("clash"))
    got = {}
    for r in page_links(df).collect():
        got.setdefault(r["page_id"], []).append((r["url"], r["label"][:9], r["kind"], r["link_key"]))
    assert sorted(got[0]) == [("http://h.org/one", "one", "link", "url:http://h.org/one"), ("http://h.org/two", "two x", "link", "url:http://h.org/two")]
    assert ("http://h.org/next", "next", "link", "url:http://h.org/next") in got[1]
    assert got[3] == [("x", "rel", "link", "x")] and got[6] == [("http://o.org/k/x", "based", "link", "url:http://o.org/k/x")]
    assert sorted(x[2] for x in got[7]) == ["link", "spreadsheet"] and not {2, 4, 5} & got.keys()
    assert page_links(df.limit(0)).isEmpty()


def counting(folder):
    """A converter that leaves a mark for each call."""

    def convert(ext, content):
        if content == b"bad":
            raise ValueError("bad")
        with open(os.path.join(folder, f"{len(content)}-{os.urandom(8).hex()}"), "w"):
            return content.decode() + ext

    return convert


def test_equal_contents_are_converted_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    kept, how = Conversions(spark, str(tmp_path / "kept")), counting(str(calls))
    schema = "file_id string, extension string, content binary, address string"
    a = spark.createDataFrame([("1", ".txt", b"same", "x"), ("2", ".txt", b"same", "x"), ("3", ".md", b"same", "x"), ("4", ".txt", b"bad", "x"), ("5", ".txt", None, "x"), ("6", ".txt", b"", "x")], schema)
    rows = {r["file_id"]: (r["markdown"], r["error"], r["fresh"]) for r in kept.convert(a, how, "v1").collect()}
    assert rows == {"1": ("same.txt", None, True), "2": ("same.txt", None, False), "3": ("same.md", None, True), "4": (None, "ValueError: bad", True), "5": (None, "no content", False), "6": (".txt", None, True)}
    assert len(os.listdir(calls)) == 3
    b = spark.createDataFrame([("9", ".txt", b"same", "x"), ("8", ".txt", b"new", "x"), ("7", ".txt", b"bad", "x")], schema)
    rows = {r["file_id"]: (r["markdown"], r["error"], r["fresh"]) for r in kept.convert(b, how, "v1").collect()}
    assert rows == {"9": ("same.txt", None, False), "8": ("new.txt", None, True), "7": (None, "ValueError: bad", True)} and len(os.listdir(calls)) == 4
    assert kept.convert(b, how, "v2").filter("fresh").count() == 3 and len(os.listdir(calls)) == 6
    repeated = spark.createDataFrame([("1", ".txt", b"p", "x"), ("1", ".txt", b"q", "x")], schema)
    assert sorted(r["markdown"] for r in kept.convert(repeated, how, "v1").collect()) == ["p.txt", "q.txt"]
    assert kept.convert(a.limit(0), how, "v1").isEmpty() and kept.kept("v1").count() == 6


def test_two_sources_share_conversions(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    for source in ("one", "two"):
        (tmp_path / source).mkdir()
        for i in range(4):
            (tmp_path / source / f"{source}{i}.txt").write_text(f"The same words of file number {i} in either source. " * 20)
    (tmp_path / "two" / "own.txt").write_text("Only here. " * 50)
    kept, index = Conversions(spark, str(tmp_path / "kept")), str(tmp_path / "index")
    run = lambda source, version: ingest.index_source(spark, index, source, [str(tmp_path / source)], counting(str(calls)), force=True, conversions=kept, versions=(version, ""))
    assert run("one", "c-1")["files"] == 4 and len(os.listdir(calls)) == 4
    assert run("two", "c-1")["files"] == 5 and len(os.listdir(calls)) == 5
    assert run("two", "c-1")["chunks"] == run("two", "c-2")["chunks"] > 0 and len(os.listdir(calls)) == 10
    with pytest.raises(ValueError):
        ingest.index_source(spark, index, "one", [str(tmp_path / "one")], conversions=kept)
