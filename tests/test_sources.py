"""File sources: landed API responses (S1) and the blocklist file."""

import json

from hitweave.session import scratch_path
from hitweave.sources import landed
from hitweave.operators import filters as flt

from conftest import rows


def test_responses_json(spark):
    path = scratch_path(spark, "responses")
    lines = [
        {"query": "q", "start": 1, "status": 200, "items": [
            {"title": "T &amp; A", "link": "http://a.example.com/1", "snippet": "s1"},
            {"title": "", "link": "http://b.example.com/2", "snippet": "no title"},
            {"link": "http://c.example.com/3"}]},
        {"query": "q", "start": 11, "status": 200, "items": [{"title": "T11", "link": "http://d/11", "snippet": ""}]},
        {"query": "q", "start": 21, "status": 500, "items": [{"title": "x", "link": "http://e/", "snippet": ""}]},
        {"query": "r", "start": 1, "status": 200},                     # no items: no hits
    ]
    text = "\n".join(json.dumps(x) for x in lines) + "\n{not json\n"
    spark.sparkContext.parallelize([text], 1).saveAsTextFile(path)
    hits = landed.scan_items(landed.read_responses(spark, path))
    assert rows(hits, "query", "pos", "link") == [
        ("q", 0, "http://a.example.com/1"), ("q", 1, "http://b.example.com/2"),
        ("q", 2, "http://c.example.com/3"), ("q", 10, "http://d/11")]
    valid = landed.valid_items(hits)
    assert rows(valid, "pos", "title") == [(0, "T & A"), (10, "T11")]
    assert rows(landed.result_page(hits, 11, 10), "pos") == [(10,)]


def test_blocklist_file_and_matching(spark):
    path = scratch_path(spark, "blocklist")
    spark.sparkContext.parallelize(["  ads.example.com \n\n   \nexample.org\nads.example.com\n"], 1).saveAsTextFile(path)
    bl = landed.read_blocklist(spark, path)
    assert rows(bl) == [("ads.example.com",), ("example.org",)]
    assert landed.read_blocklist(spark, path + "-missing").count() == 0
    hits = spark.createDataFrame([("q", 0, "http://ads.example.com/x"), ("q", 1, "http://www.example.org/y"),
                                  ("q", 2, "http://example.org:8080/z"), ("q", 3, "http://ok.example.net/")],
                                 "query string, pos int, link string")
    assert rows(flt.blocklist_filter(hits, bl), "pos") == [(1,), (2,), (3,)]   # exact host; port kept
    assert rows(flt.blocklist_filter(hits, bl, match="suffix"), "pos") == [(2,), (3,)]
