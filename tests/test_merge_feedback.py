"""Merge/rank edge cases (stored + fresh list semantics) and the feedback fold."""

import datetime as dt


from hitweave.operators import feedback as fb
from hitweave.operators import merge as mg

HIT = "query string, pos long, title string, link string, snippet string, ml_rank double, rag_summary string, " \
      "click_count long, relevance boolean"


def test_merge_scores_dedup_and_one_sided(spark):
    stored = spark.createDataFrame([
        ("q", 0, "A", "a", "", 0.2, "", 4, True),
        ("q", 1, "B", "b", "", 0.4, "", 2, False),
        ("s", 0, "S", "s1", "", 0.0, "", 0, False),      # query with no fresh side
    ], HIT)
    fresh = spark.createDataFrame([
        ("q", 0, "B2", "b", "", 1.0, "", 0, False),      # same link as stored: stored row wins
        ("q", 1, "C", "c", "", 1.0, "", 0, False),
        ("f", 0, "F1", "f1", "", 1.0, "", 0, False),     # query with no stored side
        ("f", 1, "F2", "f2", "", 1.0, "", 0, False),
    ], HIT)
    out = {(r.query, r.link): r for r in mg.merge_rank(stored, fresh).collect()}
    assert out[("q", "b")].title == "B" and out[("q", "b")].source == "db"
    # a: 2 + 4/4 + 0.2/1.0 = 3.2 ; b: 0 + 2/4 + 0.4 = 0.9 ; c: 0 + 0 + 1.0 = 1.0
    assert abs(out[("q", "a")].rank_score - 3.2) < 1e-12
    assert [r.link for r in sorted((v for k, v in out.items() if k[0] == "q"), key=lambda r: r.rank)] == ["a", "c", "b"]
    assert out[("f", "f1")].rank == 1 and out[("f", "f2")].rank == 2 and out[("f", "f1")].rank_score is None
    assert out[("s", "s1")].rank == 1 and out[("s", "s1")].rank_score is None


def test_merge_zero_normalisers_and_ties(spark):
    stored = spark.createDataFrame([("q", 0, "A", "a", "", 0.0, "", 0, False),
                                    ("q", 1, "B", "b", "", 0.0, "", 0, False)], HIT)
    fresh = spark.createDataFrame([("q", 0, "C", "c", "", 0.0, "", 0, False)], HIT)
    got = sorted((r.rank, r.link, r.rank_score) for r in mg.merge_rank(stored, fresh).collect())
    # all scores 0: ties closed by source (stored first), then position, then link
    assert got == [(1, "a", 0.0), (2, "b", 0.0), (3, "c", 0.0)]


def test_format_defaults(spark):
    df = spark.createDataFrame([("q", 2, None, "http://x", None, None)],
                               "query string, rank long, title string, url string, description string, score double")
    r = mg.format_results(df).collect()[0]
    assert (r.rank, r.title, r.link, r.snippet, r.ml_rank, r.click_count, r.relevance) == \
        (1, "Untitled", "http://x", "No description available", 0.0, 0, False)


EV = "event_id long, ts timestamp, query string, link string, title string, snippet string, ml_rank double, " \
     "rag_summary string, rank int"
RES = "query string, link string, title string, snippet string, rank int, created timestamp, relevance boolean, " \
      "ml_rank double, rag_summary string, click_count int, last_clicked timestamp"


def _t(h):
    return dt.datetime(2024, 1, 1, h)


def test_feedback_fold_and_replay(spark):
    results = spark.createDataFrame([("q", "a", "A", "", 3, _t(0), False, 0.1, "", 5, None),
                                     ("q", "z", "Z", "", 1, _t(0), False, 0.0, "", 0, None)], RES)
    events = spark.createDataFrame([
        (1, _t(5), "q", "a", "A new", "s", 0.7, "", None),
        (2, _t(6), "q", "a", "A newer", None, None, None, 1),
        (3, _t(7), "q", "n", "N", "sn", 0.3, "", 4),
        (4, _t(8), "q", "n", "N2", "", 0.2, "", 9),
        (5, _t(9), "q", None, "bad", "", 0.0, "", 1),        # rejected: no link
    ], EV)
    out = {r.link: r for r in fb.feedback_upsert(results, events).collect()}
    a, n, z = out["a"], out["n"], out["z"]
    assert (a.click_count, a.relevance, a.title, a.snippet, a.ml_rank, a.rank, a.created, a.last_clicked) == \
        (7, True, "A newer", "", 0.0, 3, _t(0), _t(6))
    assert (n.click_count, n.rank, n.created, n.title, n.last_clicked) == (2, 4, _t(7), "N2", _t(8))
    assert (z.click_count, z.relevance) == (0, False)
    assert [r.reason for r in fb.feedback_rejects(events).collect()] == ["missing link"]
    # the same batch folded into the same base gives the same table (idempotent per batch)
    again = {r.link: tuple(r) for r in fb.feedback_upsert(results, events).collect()}
    assert again == {k: tuple(v) for k, v in out.items()}
    audit = fb.constraint_audit(fb.feedback_upsert(results, events)).collect()[0]
    assert (audit.n_rows, audit.dup_keys, audit.null_link) == (3, 0, 0)


def test_results_replace_last_wins(spark):
    results = spark.createDataFrame([("q", "a", "A", "", 3, _t(0), True, 0.1, "", 5, _t(1))], RES)
    values = spark.createDataFrame([("q", "a", "A1", 1, 1), ("q", "a", "A2", 2, 2), ("q", "b", None, 1, 3)],
                                   "query string, link string, title string, rank int, seq int")
    out = {r.link: r for r in fb.results_replace(results, values, "2024-02-01 00:00:00", seq_col="seq").collect()}
    assert set(out) == {"a"}  # 'b' lacks a title and is rejected
    a = out["a"]
    assert (a.title, a.rank, a.click_count, a.relevance, a.last_clicked) == ("A2", 2, 0, False, None)
    assert a.created == dt.datetime(2024, 2, 1)


def test_conform_results_defaults(spark):
    df = spark.createDataFrame([("q", "l", "t", 2)], "query string, link string, title string, rank long")
    r = fb.conform_results(df, "2024-02-01 00:00:00").collect()[0]
    assert (r.created, r.relevance, r.ml_rank, r.click_count, r.snippet, r.last_clicked) == \
        (dt.datetime(2024, 2, 1), False, 0.0, 0, None, None)
    assert fb.conform_results(df, "2024-02-01").schema.names == list(fb.RESULT_COLUMNS)


def test_feedback_echo_changed_keys_only(spark):
    results = spark.createDataFrame([("q", "a", "A", "", 3, _t(0), False, 0.1, "", 5, None),
                                     ("q", "z", "Z", "", 1, _t(0), False, 0.0, "", 0, None)], RES)
    events = spark.createDataFrame([(1, _t(5), "q", "a", "A new", "", 0.7, "", 1),
                                    (2, _t(6), "q", "n", "N", "", 0.3, "", 4)], EV)
    got = sorted(map(tuple, fb.feedback_echo(results, events).collect()))
    assert got == [("q", "a", "A new", 6, True), ("q", "n", "N", 1, True)]
