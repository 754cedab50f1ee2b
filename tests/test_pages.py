"""Titles, days, links and tables of pages against the standard library's parser."""

import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from leadlens.catalog import queries
from leadlens.sources.pages import RAW, read_page, read_pages


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.cells, self.lang, self.stack, self.link, self.cell = None, [], [], None, [], None, None

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang") or None
        if tag == "a":
            self.link = None
            if attrs.get("href"):
                self.links.append([attrs["href"], ""])
                self.link = self.links[-1]
        if tag in ("td", "th"):
            self.cells.append("")
            self.cell = True
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag in ("td", "th", "tr", "table"):
            self.cell = None
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title":
            self.title = (self.title or "") + data
        elif not (self.stack and self.stack[-1] in RAW):
            if self.link:
                self.link[1] += data
            if self.cell:
                self.cells[-1] += data


def test_all_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = read_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert len(got) == len(pages)
    plain = lambda s: None if s is None else " ".join(s.split())
    for r in got:
        p = Plain()
        p.feed(pages[r.page_id] or "")
        p.close()
        assert r.title == plain(p.title) and r.lang == p.lang
        assert [(x.href, x.text) for x in r.links] == [(h, plain(t)) for h, t in p.links]
        assert [c for t in r.tables for row in t for c in row] == [plain(c) for c in p.cells]
    assert queries()["html_reader"](spark, sf_dir).count() == len(pages)


def test_fields():
    page = """<html lang='en'><head><title> A &amp; B
    </title><meta property="article:published_time" content="2024-05-06T10:00"><meta name=date content=2020-01-01></head>
    <script>var a = "<a href='/no'>x</a>";</script><!-- <a href="/c">c</a> --><a href="/x?a=1&amp;b=2" title="5 > 3">one <b>two</b></a><a name=q>no</a>
    <table><tr><th>H<td>1</tr><tr><td><table><tr><td>in</td></tr></table>out</td></table> 1 < 2 <time datetime="2021-02-03">x</time><a href=/last>end"""
    got = read_page(page)
    assert (got["title"], got["published"], got["lang"]) == ("A & B", "2024-05-06", "en")
    assert got["links"] == [{"href": "/x?a=1&b=2", "text": "one two"}, {"href": "/last", "text": "end"}]
    assert got["tables"] == [[["in"]], [["H", "1"], ["out"]]]
    assert read_page("")["links"] == [] and read_page("plain < text")["title"] is None


def test_linear_and_null(spark):
    began = time.perf_counter()
    for bad in ("<a href=\"", "<", "<a '", "<table><tr><td>", "<!--", "<title>", "<script>"):
        read_page(bad * 50_000)
    assert time.perf_counter() - began < 15
    row = read_pages(spark.createDataFrame([(1, None)], "page_id long, html string")).first()
    assert row.title is None and row.links == [] and row.tables == []
    assert read_pages(spark.createDataFrame([], "page_id long, html string")).select(F.explode("links")).count() == 0
