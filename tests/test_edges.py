"""Edge rules against literal results (from the standard library's parsers), not against the oracle's patterns."""

import html
import random
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from hitweave.functions import text, timefn, web
from hitweave.functions.entities import html_unescape
from hitweave.operators import filters
from hitweave.sources import landed

from conftest import rows


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column("x")).first()[0]


def test_links_with_href_only(spark):
    for html, n in (('<a href="x">a</a>', 1), ("<a data-href=x>a</a>", 0), ("<a href>a</a>", 1), ("<a class=c HREF = 'x'>", 1),
                    ("<abbr href=x>", 0), ("<!-- <a href=x> -->", 0), ("<a\nhref=x>", 1)):
        assert one(spark, web.link_count, html) == n, html


def test_hosts(spark):
    for url, host in (("//cdn.x.com/a", "cdn.x.com"), ("http://u:p@Ex.com:80/x", "u:p@Ex.com:80"), ("x.com/a", ""), (None, ""),
                      ("https://h?q", "h"), ("mailto:a@b", "")):
        assert one(spark, web.url_host, url) == host, url


def test_unicode_spaces_split_words(spark):
    assert one(spark, text.query_words, "a b c d　") == ["a", "b", "c", "d"]
    assert one(spark, text.strip_ws, "  x ") == "x"
    assert one(spark, web.visible_text, "<p>a&nbsp;b</p> <p>c") == "a b c"


def test_dates(spark):
    meta = '<meta name="date" content="2024-01-02">'
    assert one(spark, web.meta_published_date, f"<!-- {meta} --><p>") is None
    assert one(spark, web.meta_published_date, f"<script>{meta}</script>{meta.replace('-02', '-03')}") == "2024-01-03"
    assert one(spark, timefn.parse_published, "12:30:00") is None
    assert one(spark, timefn.parse_published, "2024-01-02T03:04:05Z").isoformat() == "2024-01-02T03:04:05"


def test_requests_are_answered_or_rejected(spark):
    df = spark.createDataFrame([(" q ", "day"), ("q", "decade"), (" ", ""), (None, "day"), ("q", None)], "query string, time_filter string")
    assert rows(filters.clean_queries(df), "cache_key") == [("q",), ("q:day",)]
    assert rows(filters.request_rejects(df), "query", "reason") == [("", "blank query"), ("", "blank query"), ("q", "unknown time filter")]


def test_one_fetch_per_url(spark):
    hits = spark.createDataFrame([("q", 0, "u"), ("q", 1, "v"), ("q", 2, None)], "query string, pos int, link string")
    fetched = spark.createDataFrame([("u", 200, "old", 1), ("u", 200, "new", 2), ("u", 404, "no", 3), ("v", 404, "no", 1), (None, 200, "x", 1)],
                                    "url string, status int, html string, fetch_id int")
    assert rows(landed.attach_pages(hits, fetched), "pos", "html") == [(0, "new"), (1, ""), (2, "")]
    assert F is not None


def test_versions(spark):
    from hitweave.session import scratch_path
    from hitweave.sources import versions
    root = scratch_path(spark, "versions")
    assert versions.versions(spark, root) == []
    assert versions.write_version(spark.range(3), root) == 1 and versions.write_version(spark.range(5), root) == 2
    spark.range(9).write.parquet(f"{root}/v3/unfinished")  # not a version
    assert versions.read_version(spark, root).count() == 5 and versions.read_version(spark, root, 1).count() == 3
    assert versions.write_version(versions.read_version(spark, root, 1), root) == 4 and versions.versions(spark, root) == [1, 2, 4]


def test_two_writers(spark, monkeypatch):
    """Two updates of one base give one version and an error; two writers without a base give two versions."""
    from hitweave.session import scratch_path
    from hitweave.sources import versions
    root = scratch_path(spark, "writers")
    base = versions.write_version(spark.range(3), root)
    assert versions.write_version(spark.range(4), root, base=base) == 2
    with pytest.raises(versions.VersionConflict):
        versions.write_version(spark.range(5), root, base=base)
    assert versions.versions(spark, root) == [1, 2] and versions.read_version(spark, root).count() == 4
    real, stale = versions._listed, [([1, 2], 2)]
    monkeypatch.setattr(versions, "_listed", lambda *a: stale.pop() if stale else real(*a))  # listed before the other one's version was there
    other = versions.pending(root)
    spark.range(6).write.parquet(other)
    assert versions.publish(spark, other, root, 3)
    assert versions.write_version(spark.range(7), root) == 4
    assert versions.read_version(spark, root, 3).count() == 6 and versions.read_version(spark, root, 4).count() == 7
    stale.append(([1, 2, 3, 4], 4))
    other = versions.pending(root)
    spark.range(8).write.parquet(other)
    assert versions.publish(spark, other, root, 5)
    with pytest.raises(versions.VersionConflict):
        versions.write_version(spark.range(9), root, base=4)
    assert versions.read_version(spark, root).count() == 8


def test_every_reference_is_decoded_as_the_standard_library_does(spark):
    rnd = random.Random(1)
    texts = [f"{a}&{n}{b}" for n in html5 for a, b in (("", ""), ("x", "y &amp;lt; z"))]
    texts += [f"&#{n};" for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFE, 0x1FFFF, 0x10FFFE, 0x10FFFF, 0x110000, 8217, 10**12]]
    texts += [f"&#x{n:x};" for n in (0, 9, 0x41, 0x80, 0x9F, 0x1F600, 0x110000)] + ["&#X41;b", "&#x41g", "&#65b", "&#;", "&#x;", "&", "&&", "&;", "&notit;",
              "&notin;", "&#0000000000065;", "& amp;", "&unknown;", "&CounterClockwiseContourIntegral;", "&a\tb;", "", "plain"]
    parts = ["&", "#", "x", "amp", "lt", ";", "é", " ", "1", "not", "in", "&#39;", "&copy", "\n"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_unescape(F.col("t")).alias("u"))
    assert not [(r.t, r.u) for r in df.collect() if r.u != html.unescape(r.t)]
    assert one(spark, lambda c: html_unescape(F.col(c)), None) is None


PAGES = [
    ('<a title="x > y" href="/1">one</a> two', "one two", 1),
    ("<p data-x='a>b' class=c>text</p>", "text", 0),
    ('<a href="/1"title=x>one</a><a title="href=no">two</a>', "one two", 1),
    ("before <script>if (a < b) { '<a href=x>' }", "before", 0),
    ("a<script>x</script >b<SCRIPT type='a>b'>y</ScRiPt>c", "a b c", 0),
    ("a <style>p > b {}", "a", 0),
    ("a <!-- <a href=x> --> b <!-- open <a href=y>", "a b", 0),
    ("a <!doctype html> b <?php x ?> c </> d </ e>f", "a b c d f", 0),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2", 0),
    ("caf&eacute; &copy; &#8217; a&nbsp;b &lt;p&gt;", "café © ’ a b <p>", 0),
    ("<template><a href=x>t</a></template>v", "v", 0),
    ('<a href="&quot;">q</a><abbr href=x>r</abbr>', "q r", 1),
    ('<a href="unclosed>x</a> y', "x y", 1),
    ("", "", 0), (None, "", 0), ("<", "<", 0), ("a<b", "a<b", 0),
]


def test_pages_token_by_token(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(PAGES)], "i int, html string")
    got = df.select("i", web.visible_text("html").alias("t"), web.link_count("html").alias("n"), web.word_count(web.visible_text("html")).alias("w")).orderBy("i").collect()
    assert [(PAGES[r.i][0], r.t, r.n) for r in got] == PAGES
    assert [r.w for r in got] == [len(t.split()) for _, t, _ in PAGES]


def test_pages_against_the_standard_parser(spark):
    """Pages of random pieces: the text and the links that html.parser finds."""
    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.pieces, self.links, self.hidden = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.pieces.append(" ")
            self.hidden = tag if tag in ("script", "style") else self.hidden
            self.links += tag == "a" and "href" in dict(attrs)

        def handle_endtag(self, tag):
            self.pieces.append(" ")
            self.hidden = 0

        def handle_comment(self, data):
            self.pieces.append(" ")

        def handle_data(self, data):
            self.pieces.append("" if self.hidden else data)

    pieces = ["<p>", "</p>", '<a href="/x?a=1&amp;b=2">', "</a>", "<a name='n > m'>", "<A\nHREF = x>", '<img alt="a > b" src=\'c\'>', "<br/>",
              "<!-- <a href=x> > -->", "<script>var a = '<p>';</script>", "<style>a > b {}</style>", "word", " &eacute;t&eacute; ", "&lt;b&gt;", " ", "\n",
              "x &amp;&amp; y", "1 > 0", "&#8217;", "日本"]
    rnd = random.Random(2)
    pages = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    for r in df.select("html", web.visible_text("html").alias("t"), web.link_count("html").alias("n")).collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        assert (r.t, r.n) == (" ".join("".join(reader.pieces).split()), reader.links), r.html


def test_meta_dates_with_quotes(spark):
    for page, date in (('<meta content="a > name=date" name=x><meta name="date" content="2024-01-02 &gt;">', "2024-01-02 >"),
                       ("<meta name=date content='2024'>", "2024"), ("<META NAME=date CONTENT=x>", "x"), ('<meta name="Date" content="x">', None),
                       ('<meta title=\'name="date"\' content="x">', None), ('<meta name=date><meta name=date content=y>', None)):
        assert one(spark, web.meta_published_date, page) == date, page


def test_rows_without_position_stay_in_the_filter(spark):
    hits = spark.createDataFrame([("q", None, "http://a/", "w " * 60), ("q", 1, "http://b/", "w " * 60), (None, 2, "http://c/", "w " * 70), ("q", 3, "http://d/", "w")],
                                 "query string, pos int, link string, html string")
    out = filters.content_filter(hits, spark.createDataFrame([("x",)], "host string"))
    assert sorted(((r.link, r.final_rank) for r in out.collect())) == [("http://a/", 1), ("http://b/", 2), ("http://c/", 1)]
    assert "html" not in out.columns
