"""Physical-plan checks: broadcast where bounded, pushdown, no Python in native paths, top-k limits."""

import contextlib
import io

from hitweave.plans.registry import QUERIES

from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def test_blocklist_is_broadcast_anti_join(spark):
    p = final_plan(QUERIES["blocklist_filter"](spark, SMALL))
    assert "BroadcastHashJoin LeftAnti" in p or ("LeftAnti" in p and "Broadcast" in p)


def test_native_paths_have_no_python(spark):
    for k in ("search_hits", "content_filter", "tfidf_rank", "merge_rank", "feedback_upsert", "page_dates"):
        p = final_plan(QUERIES[k](spark, SMALL))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p, k


def test_topk_moves_no_pairs(spark):
    """Scores are summed where the documents' postings lie: nothing is dealt out by document, and what is
    dealt out by query has been cut to the best before."""
    p = plan(QUERIES["semantic_topk"](spark, SMALL))
    exchanges = [line.split("Exchange ")[1] for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all(e.startswith("hashpartitioning(query_id") for e in exchanges), exchanges
    assert "Bucketed: true" in p or "SelectedBucketsCount" in p
    below = p[p.index("Exchange hashpartitioning(query_id"):]
    assert "WindowGroupLimit" in below.splitlines()[1], below[:300]
    p = plan(QUERIES["semantic_scores"](spark, SMALL))
    assert "Exchange hashpartitioning" not in p


def test_topk_uses_window_group_limit(spark):
    df = QUERIES["semantic_topk"](spark, SMALL)
    df._jdf.queryExecution().executedPlan()  # plan only
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in QUERIES["vocabulary"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scan_prunes_columns_and_pushes_filters(spark):
    text = formatted(QUERIES["page_stats"](spark, SMALL))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text
    text = formatted(QUERIES["time_window_month"](spark, SMALL))
    assert "GreaterThanOrEqual(created," in text[text.index("PushedFilters"):]
    text = formatted(QUERIES["feedback_rejects"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)" in text
