"""The streaming fold equals the batch fold, and a replayed source changes nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitweave.operators import feedback as fb
from hitweave.session import scratch_path
from hitweave.sources import fixtures as fx
from hitweave.streaming import feedback_stream as fs
from hitweave.streaming import snapshot_stream as ss

from conftest import SMALL, rows


def test_stream_equals_batch_and_replay_is_noop(spark):
    ev = fx.feedback(spark, SMALL).select(*[f.name for f in fs.FEEDBACK_SCHEMA.fields])
    stored = fx.stored(spark, SMALL)
    root = scratch_path(spark, "test-stream")
    mid = F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    ev.filter(F.col("ts") < mid).write.parquet(f"{root}/src/a")
    ev.filter(F.col("ts") >= mid).write.parquet(f"{root}/src/b")
    # two clicks delivered twice: once within the late batch, once as a late redelivery
    ev.filter(F.col("event_id") % 5 == 0).write.parquet(f"{root}/src/c")

    def run():
        q = spark.readStream  # noqa: F841 - placeholder to keep the session warm
        for part in ("a", "b", "c"):
            spark.read.parquet(f"{root}/src/{part}").write.mode("append").parquet(f"{root}/in")
            s = fs.start_feedback_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=100)
            s.awaitTermination(300)
            assert s.exception() is None

    run()
    streamed = fs.results_from_stream(spark, stored, f"{root}/out")
    batch = fb.feedback_upsert(stored, ev)
    assert rows(streamed) == rows(batch)
    # restarting the stream on the same checkpoint with no new files folds nothing new
    s = fs.start_feedback_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=100)
    s.awaitTermination(300)
    assert rows(fs.results_from_stream(spark, stored, f"{root}/out")) == rows(batch)


def test_late_click_counts_and_late_copy_does_not(spark):
    root = scratch_path(spark, "test-late")
    day = "timestamp'2024-01-10 12:00:00'"

    def deliver(*events):
        rows_ = spark.createDataFrame([(i, h) for i, h in events], "event_id bigint, hours int").selectExpr(
            "event_id", f"{day} - make_interval(0, 0, 0, 0, hours) AS ts", "'q' AS query", "'l' AS link", "'t' AS title",
            "'s' AS snippet", "CAST(0.5 AS double) AS ml_rank", "'' AS rag_summary", "1 AS rank")
        rows_.write.mode("append").parquet(f"{root}/in")
        s = fs.start_feedback_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=100)
        s.awaitTermination()
        assert s.exception() is None

    deliver((1, 0))
    deliver((2, 24 * 9), (1, 0))      # a click nine days late, and a copy of the first
    deliver((2, 24 * 9), (2, 24 * 9))  # its copies
    got = fs.read_rollup(spark, f"{root}/out").collect()
    assert [(r.query, r.link, r.clicks) for r in got] == [("q", "l", 2)]


def test_deliveries_have_as_many_files_as_partitions(spark, monkeypatch, tmp_path):
    """The registered job writes each delivery by Spark's own partitioning, and folds it as one micro-batch."""
    from hitweave.plans import registry
    paths = iter([str(tmp_path / "stream")])
    real = registry.scratch_path
    monkeypatch.setattr(registry, "scratch_path", lambda s, name: next(paths) if name == "feedback_stream" else real(s, name))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        registry.q_feedback_stream(spark, "/root/testdata/sf0.001").count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "stream" / "source").glob("*.parquet"))) > 5
    assert sorted(p.name for p in (tmp_path / "stream" / "rollup").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
    assert [p.name for p in (tmp_path / "stream" / "rollup").glob("gen*")] == ["gen1"]


def click(i, hours=0, link="l"):
    return (i, dt.datetime(2024, 1, 10, 12) - dt.timedelta(hours=hours), "q", link, f"t{hours}", "s", 0.5, "", 1)


def delivery(spark, root, events, **more):
    spark.createDataFrame(events, fs.FEEDBACK_SCHEMA).write.mode("append").parquet(f"{root}/in")
    s = fs.start_feedback_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=None, **more)
    s.awaitTermination()
    assert s.exception() is None


def clicks(spark, root):
    return {r.link: r.clicks for r in fs.read_rollup(spark, f"{root}/out").collect()}


def test_events_without_an_id_all_count(spark):
    root = scratch_path(spark, "test-no-id")
    delivery(spark, root, [click(None), click(None), click(None, 3), click(7), click(7)])
    assert clicks(spark, root) == {"l": 4}
    delivery(spark, root, [click(None, 3), click(7), click(8)])
    assert clicks(spark, root) == {"l": 6}


def test_compaction_changes_nothing_and_bounds_what_is_read(spark):
    root = scratch_path(spark, "test-compact")
    out = f"{root}/out"
    for i in range(7):
        delivery(spark, root, [click(i, i), click(100 + i, i, f"l{i}"), click(0)], compact=3)
        assert clicks(spark, root) == {"l": i + 1, **{f"l{j}": 1 for j in range(i + 1)}}
        assert len(fs._partials(spark, out)) < 3 and len(fs._parts(spark, out)) <= 3
    assert [r.latest.title for r in fs.read_rollup(spark, out).collect() if r.link == "l"] == ["t0"]
    assert fs.versions.versions(spark, out, "gen") == [2, 5] and fs._batches(spark, out) == [3, 4, 5, 6]


def test_crash_during_compaction(spark, monkeypatch):
    root = scratch_path(spark, "test-crash")
    out = f"{root}/out"
    for i in range(3):
        delivery(spark, root, [click(i, i)], compact=99)
    with monkeypatch.context() as m:  # before the generation has its number
        m.setattr(fs.versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            fs.compact_rollup(spark, out)
    assert clicks(spark, root) == {"l": 3} and len(fs._parts(spark, out)) == 3
    with monkeypatch.context() as m:  # after it, before anything is deleted
        m.setattr(fs, "_delete", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        fs.compact_rollup(spark, out)
    assert clicks(spark, root) == {"l": 3} and fs._parts(spark, out) == [f"{out}/gen2"]
    # the batch that made the generation is run again: its partial is written, but not read
    fs.partial_rollup(spark.createDataFrame([click(2, 2)], fs.FEEDBACK_SCHEMA)).write.mode("overwrite").parquet(f"{out}/batch=2")
    assert clicks(spark, root) == {"l": 3}
    assert fs.compact_rollup(spark, out) == 2
    delivery(spark, root, [click(50, 9), click(1)], compact=99)
    assert clicks(spark, root) == {"l": 4}


def test_snapshot_stream_in_any_order(spark):
    """The same drops whatever the order and the turns of delivery; timers follow the clock alone."""
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    writes = [("a", "final", 1, t(1), t(9)), ("a", "final", 2, t(2), t(9)), ("a", "final", 3, t(2), t(3)), ("a", "fresh", 1, t(1), t(5)),
              ("b:day", "final", 1, t(1), t(9)), ("b", "final", 2, t(4), t(9)), ("c", "final", 1, t(1), t(2)), ("c", "final", 1, t(1), t(2)),
              ("d", "final", 1, t(1), t(6)), ("d", "final", 2, t(3), t(5))]
    events = [("b", t(2)), ("b", t(1, 30)), (None, t(8)), ("zz", t(8))]
    want = {("a", "final", 1, "replaced"), ("a", "final", 2, "replaced"), ("a", "final", 3, "expired"), ("a", "fresh", 1, "expired"),
            ("b:day", "final", 1, "feedback"), ("c", "final", 1, "expired"), ("d", "final", 1, "replaced"), ("d", "final", 2, "expired")}
    for turns in ([(writes, events, [t(0)]), (None, None, [t(5)])], [(writes[::-1][:5], None, [t(0)]), (writes[::-1][5:], None, None), (None, events, None),
                                                                    (None, None, [t(4)]), (None, None, [t(5)])]):
        root = scratch_path(spark, "test-snapshot-stream")
        schemas = dict(zip(("writes", "clicks", "clock"), (ss.WRITE_SCHEMA, ss.CLICK_SCHEMA, ss.CLOCK_SCHEMA)))
        for name, schema in schemas.items():
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
        for turn in turns:
            for (name, schema), rows_ in zip(schemas.items(), turn):
                if rows_:
                    data = [(x,) for x in rows_] if name == "clock" else rows_
                    spark.createDataFrame(data, schema).write.mode("append").parquet(f"{root}/{name}")
            q = ss.start_snapshot_stream(spark, *(f"{root}/{p}" for p in ("writes", "clicks", "clock", "drops", "state")))
            q.awaitTermination()
            assert q.exception() is None
        got = [(r.cache_key, r.kind, r.version, r.reason) for r in ss.read_drops(spark, f"{root}/drops").collect()]
        assert len(got) == len(set(got))
        assert {g[:3] for g in got} == {w[:3] for w in want}
        assert {g for g in got if g[0] != "d"} == {w for w in want if w[0] != "d"}
        table = spark.createDataFrame(writes, ss.WRITE_SCHEMA)
        assert [(r.cache_key, r.version) for r in ss.live_snapshots(table, ss.read_drops(spark, f"{root}/drops")).collect()] == [("b", 2)]
