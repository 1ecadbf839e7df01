"""Scalar expressions against hand-made boundary rows (FIXTURES.md §5)."""

import datetime as dt

from pyspark.sql import functions as F

from hitweave.functions import text as tx
from hitweave.functions import timefn as tf
from hitweave.functions import web


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr).collect()[0][0]


def test_age_score_boundaries(spark):
    now = "2024-01-31 00:00:00"
    cases = {
        "2024-01-24 00:00:01": 1.0,   # 6 days 23:59:59 old
        "2024-01-24 00:00:00": 0.9,   # exactly 7 days: not < 7 days
        "2024-01-01 00:00:00": 0.8,   # exactly 30 days
        "2023-11-02 00:00:00": 0.7,   # exactly 90 days
        "2023-01-31 00:00:00": 0.6,   # exactly 365 days
        "2025-01-01 00:00:00": 1.0,   # future
        "not a date": 0.5,
        None: 0.5,
    }
    data = [(k,) for k in cases]
    df = spark.createDataFrame(data, "d string").select(
        "d", tf.age_score(tf.parse_published(F.col("d")), now).alias("s"))
    got = {r.d: r.s for r in df.collect()}
    assert got == cases


def test_iso_offsets_and_z(spark):
    df = spark.createDataFrame([("2024-01-01T05:00:00+02:00",), ("2024-01-01T00:00:00Z",), ("2024-01-05",)], "d string")
    got = [r[0] for r in df.select(tf.parse_published(F.col("d")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5)]


def test_unknown_time_filter_raises():
    import pytest
    assert tf.window_days("") is None and tf.window_days(None) is None
    assert tf.window_days("month") == 30
    with pytest.raises(ValueError):
        tf.window_days("week")


def test_summary_boundaries(spark):
    # exactly 20 chars joined -> fallback; 21 chars -> kept
    s20 = "alpha bravo charlie."  # 19 chars + '.', sentence 'alpha bravo charlie' = 19
    ctx20 = "aaaa bbbb cccc ddddd. other text"   # first sentence is exactly 20 chars
    ctx21 = "aaaa bbbb cccc dddddd. other text"  # 21 chars
    f = lambda q, c: one(spark, tx.extractive_summary(F.col("q"), F.col("c")), q=q, c=c)
    assert f("aaaa", ctx20) == ctx20[:200] + "..."
    assert f("aaaa", ctx21) == "aaaa bbbb cccc dddddd"
    assert f("zzz", "short context") == "short context..."          # no match
    assert f("anything", "") == "..."                               # empty context
    assert f("", "Some sentence here. Another one!") == "Some sentence here. Another one!..."  # empty query
    # first two matching sentences, case-insensitive substring
    assert f("KEY", "a key one is here. nothing. second KEYword here! third key.") == \
        "a key one is here second KEYword here"
    assert s20


def test_url_host(spark):
    f = lambda u: one(spark, web.url_host(F.col("u")), u=u)
    assert f("http://u:p@Ex.com:80/x") == "u:p@Ex.com:80"
    assert f("www.example.com/path") == ""
    assert f("HTTPS://WWW.Example.ORG?q=1") == "WWW.Example.ORG"
    assert f(None) == ""


def test_html_stats_edges(spark):
    html = ('<html><head><script>var a="<a href=x>";</script><style>p{}</style></head>'
            '<body><!-- <a href="c"> --><a href="/1">one</a> <a name="n">two</a> <A HREF="/2">three</A>'
            '<p title="x">four five</p></body></html>')
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(web.word_count(web.visible_text(F.col("html"))).alias("w"),
                  web.link_count(F.col("html")).alias("l")).collect()[0]
    assert (r.w, r.l) == (5, 2)  # script/style/comment not counted; <a> without href not a link


def test_meta_dates(spark):
    cases = [
        ('<meta content="2024-01-02" property="article:published_time">', "2024-01-02"),
        ('<meta name="date" content="2024-02-03">', "2024-02-03"),
        ("<meta NAME='publish-date' content='2024-03-04'>", "2024-03-04"),
        ('<meta property="og:published_time_x" content="2024">', None),
        ('<meta charset="utf-8">', None),
        ('<meta name="date" content="">', None),
        ('<meta data-name="date" content="2020-01-01">', None),
    ]
    df = spark.createDataFrame([(h,) for h, _ in cases], "html string")
    got = [r[0] for r in df.select(web.meta_published_date(F.col("html"))).collect()]
    assert got == [e for _, e in cases]


def test_tokens_and_stop_words(spark):
    got = one(spark, tx.tokens(F.col("t")), t="The Café-au-lait, a x_y 42 9 ü and naïve")
    assert got == ["café", "au", "lait", "x_y", "42", "naïve"]


def test_score_text_rounds_binary_value(spark):
    df = spark.createDataFrame([(0.145,), (0.225,), (0.125,), (1.005,), (0.0,), (2.675,)], "x double")
    got = [r[0] for r in df.select(tx.score_text(F.col("x"))).collect()]
    assert got == ["%.2f" % v for v in (0.145, 0.225, 0.125, 1.005, 0.0, 2.675)]


def test_host_suffixes(spark):
    got = one(spark, web.host_suffixes(F.col("h")), h="ads.x.example.com")
    assert got == ["ads.x.example.com", "x.example.com", "example.com", "com"]


def test_url_host_matches_stdlib_urlsplit(spark):
    """Against the standard library's URL splitting, on every page URL and on
    generated edge cases, in one DataFrame."""
    import random
    from urllib.parse import urlsplit

    from hitweave.sources.tables import read_table
    urls = [r.url for r in read_table(spark, "/root/testdata/sf0.01", "pages").select("url").collect()]
    rnd = random.Random(7)
    parts = ["http", "https", "HTTP", "ftp", "a+b.c-d", "", "1x"]
    hosts = ["ex.com", "Ex.COM:8080", "u:p@h.org", "[::1]:80", "h_o.st", "", "a.b.c.d"]
    tails = ["", "/", "/p?q=1", "?x", "#f", "/a/b#c?d", "//double"]
    for _ in range(300):
        p, h, t = rnd.choice(parts), rnd.choice(hosts), rnd.choice(tails)
        urls.append(f"{p}://{h}{t}" if rnd.random() < 0.8 else f"{p}:{h}{t}")
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [(r.u, r.h) for r in df.select("u", web.url_host(F.col("u")).alias("h")).collect()]
    bad = [(u, h, urlsplit(u).netloc) for u, h in got if h != urlsplit(u).netloc]
    assert not bad, bad[:5]


def test_page_counts_match_stdlib_html_parser(spark):
    """Word and link counts against the standard library's HTML parser on every
    page of the sf0.01 table (text outside script/style/template, <a> with href)."""
    from html.parser import HTMLParser

    from hitweave.sources.tables import read_table

    class Counter(HTMLParser):
        HIDDEN = {"script", "style", "template"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.pieces, self.links = 0, [], 0

        def handle_starttag(self, tag, attrs):
            if tag in self.HIDDEN:
                self.depth += 1
            if tag == "a" and any(k == "href" for k, _ in attrs):
                self.links += 1

        def handle_endtag(self, tag):
            if tag in self.HIDDEN and self.depth:
                self.depth -= 1

        def handle_data(self, data):
            if not self.depth:
                self.pieces.append(data)

    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    got = pages.select("page_id", "html", web.word_count(web.visible_text(F.col("html"))).alias("w"),
                       web.link_count(F.col("html")).alias("l")).collect()
    bad = []
    for r in got:
        c = Counter()
        c.feed(r.html)
        c.close()
        words = len(" ".join(p.strip() for p in c.pieces if p.strip()).split())
        if (words, c.links) != (r.w, r.l):
            bad.append((r.page_id, words, r.w, c.links, r.l))
    assert not bad, bad[:5]


def test_nbsp_separates_words(spark):
    html = "<p>a&nbsp;b&#160;c&#xA0;d e</p><p>f</p>"
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(web.visible_text(F.col("html")).alias("t"), web.word_count(web.visible_text(F.col("html"))).alias("w"))
    row = r.collect()[0]
    assert (row.t, row.w) == ("a b c d e f", 6)
    assert row.w == len("a b c d e f".split())
