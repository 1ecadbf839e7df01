import datetime as dt

from pyspark.sql import functions as F

from hitweave.operators import snapshots as snap

LIST = "cache_key string, rank long, title string, link string, snippet string, ml_rank double, " \
       "rag_summary string, click_count long, relevance boolean"


def test_write_read_expiry_and_versions(spark):
    lists = spark.createDataFrame([("k", r, f"t{r}", f"l{r}", "", 0.5, None, 0, False) for r in range(1, 251)], LIST)
    v1 = snap.snapshot_write(lists, "2024-01-01 00:00:00", ttl_seconds=0)        # 0 means the default 600 s
    assert v1.count() == 3  # 250 ranks in chunks of 100
    row = v1.filter("chunk = 0").collect()[0]
    assert row.expires_at - row.cached_at == dt.timedelta(seconds=600)
    v2 = snap.snapshot_write(lists.filter("rank <= 5"), "2024-01-01 00:05:00", ttl_seconds=60)
    table = v1.unionByName(v2)
    keys = spark.createDataFrame([("k",)], "cache_key string")
    # latest valid version wins
    assert snap.snapshot_read(table, keys, "2024-01-01 00:05:30").count() == 5
    # at exactly expires_at the newer version is gone, and the older one stays replaced
    assert snap.snapshot_read(table, keys, "2024-01-01 00:06:00").count() == 0
    assert snap.snapshot_read(table, keys, "2024-01-01 00:10:00").count() == 0
    assert [r.status for r in snap.snapshot_reuse(keys, table, "2024-01-01 00:10:00").collect()] == ["miss"]
    assert snap.snapshot_purge(table, "2024-01-01 00:06:00").count() == 0
    assert snap.snapshot_purge(table, "2024-01-01 00:05:30").count() == 1
    assert snap.snapshot_purge(table, "2024-01-01 00:01:00").count() == 4
    decoded = snap.snapshot_read(table, keys, "2024-01-01 00:01:00").orderBy("rank").collect()
    assert [r.link for r in decoded[:3]] == ["l1", "l2", "l3"] and decoded[0].ml_rank == 0.5


def test_invalidate_keys_and_times(spark):
    lists = spark.createDataFrame([(k, 1, "t", "l", "", 0.0, None, 0, False)
                                   for k in ("q", "q:day", "q:month", "q:year", "p")], LIST)
    table = snap.snapshot_write(lists, "2024-01-01 00:00:00")
    ev = spark.createDataFrame([("q", dt.datetime(2024, 1, 1, 1))], "query string, ts timestamp")
    assert sorted(r.cache_key for r in snap.snapshot_invalidate(table, ev).collect()) == ["p"]
    early = spark.createDataFrame([("q", dt.datetime(2023, 12, 31))], "query string, ts timestamp")
    assert snap.snapshot_invalidate(table, early).count() == 5           # cached after the feedback: kept
    assert snap.snapshot_invalidate(table, early, ts_col=None).count() == 1
    assert F is not None


def test_answer_then_refresh_serves_from_cache(spark):
    from conftest import SMALL
    from hitweave.plans import registry as R
    from hitweave.plans.answer import answer_requests, refresh_snapshots
    from hitweave.sources import fixtures as fx
    stored, items, fetched = fx.stored(spark, SMALL), fx.items(spark, SMALL), fx.page_fetch(spark, SMALL)
    snaps = R._fixture_snapshots(spark, SMALL, stored=stored, items=items, fetched=fetched)
    reqs = fx.requests(spark, SMALL)
    first = answer_requests(reqs, stored, items, fetched, snaps, R.READ_NOW)
    assert first.filter(~F.col("from_cache")).count() > 0
    table = refresh_snapshots(snaps, first, R.READ_NOW)
    again = answer_requests(reqs, stored, items, fetched, table, "2024-02-01 00:06:00")
    assert again.filter(~F.col("from_cache")).count() == 0
    cols = ["cache_key", "rank", "link", "title", "click_count", "relevance"]
    assert sorted(map(tuple, first.select(*cols).collect())) == sorted(map(tuple, again.select(*cols).collect()))


def test_fresh_lists_come_from_valid_fresh_snapshots(spark):
    """A query with a valid 'fresh' snapshot is not searched again: with no landed
    hits at all, its answers are unchanged; the never-searched query loses its hits."""
    from conftest import SMALL
    from hitweave.plans import registry as R
    from hitweave.plans.answer import answer_requests
    from hitweave.sources import fixtures as fx
    stored, items, fetched = fx.stored(spark, SMALL), fx.items(spark, SMALL), fx.page_fetch(spark, SMALL)
    never = stored.agg(F.min("query")).first()[0]
    stored = stored.filter(F.col("query") != never)
    snaps = R._fixture_snapshots(spark, SMALL, stored=stored, items=items, fetched=fetched)
    reqs = fx.requests(spark, SMALL)
    cols = ["cache_key", "rank", "link", "title"]
    full = answer_requests(reqs, stored, items, fetched, snaps, R.READ_NOW)
    no_hits = answer_requests(reqs, stored, items.limit(0), fetched, snaps, R.READ_NOW)
    searched = [r.query for r in stored.select("query").distinct().collect()]
    keep = F.col("query").isin(searched)
    assert sorted(map(tuple, full.filter(keep).select(*cols).collect())) == \
        sorted(map(tuple, no_hits.filter(keep).select(*cols).collect()))
    computed = ~keep & ~F.col("from_cache")   # its ':month' list is served from a final snapshot
    assert full.filter(computed).count() > 0 and no_hits.filter(computed).count() == 0


def test_of_lists_of_one_time_the_later_version_counts(spark):
    lists = spark.createDataFrame([("k", r, f"t{r}", f"l{r}", "", 0.5, None, 0, False) for r in (1, 2, 3)], LIST)
    now = "2024-01-01 00:00:00"
    table = snap.snapshot_write(lists, now, version=1).unionByName(snap.snapshot_write(lists.filter("rank = 1"), now, version=2))
    keys = spark.createDataFrame([("k",)], "cache_key string")
    assert [r.link for r in snap.snapshot_read(table, keys, now).collect()] == ["l1"]
    assert [r.version for r in snap.snapshot_purge(table, now).collect()] == [2]
    assert table.select(snap.next_version(table)).first()[0] == 3


def test_requests_with_their_own_time(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    heads = [("k", "final", 1, t(1), t(3)), ("k", "final", 1, t(2), t(2, 30)), ("k", "final", 2, t(4), t(5)), ("k", "final", 3, t(4), t(6)),
             ("k", "fresh", 9, t(1), t(23)), ("x", "final", 1, t(1), t(23))]
    table = spark.createDataFrame(heads, "cache_key string, kind string, version long, cached_at timestamp, expires_at timestamp")
    asked = [("k", t(0)), ("k", t(1)), ("k", t(1, 59)), ("k", t(2)), ("k", t(2, 30)), ("k", t(2, 45)), ("k", t(4)), ("k", t(5, 30)), ("k", t(6)),
             ("x", t(22)), ("x", t(23)), ("y", t(2)), (None, t(2)), ("k", None), ("k", t(1))]
    got = snap.snapshots_at(spark.createDataFrame(asked, "cache_key string, asked_at timestamp"), table)
    want = [("k", t(0), None), ("k", t(1), 1), ("k", t(1, 59), 1), ("k", t(2), 1), ("k", t(2, 30), None), ("k", t(2, 45), None), ("k", t(4), 3),
            ("k", t(5, 30), 3), ("k", t(6), None), ("x", t(22), 1), ("x", t(23), None), ("y", t(2), None), (None, t(2), None), ("k", None, None), ("k", t(1), 1)]
    assert sorted(((r.cache_key, r.asked_at, r.version) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert all((r.status == "hit") == (r.version is not None) for r in got.collect())


def test_asof_join_against_brute_force(spark):
    import random
    from hitweave.operators.asof import asof_join
    rnd = random.Random(1)
    right = [("h" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randint(0, 300), i) for i in range(400)]
    left = [(i, "h" if rnd.random() < 0.7 else rnd.choice("abcd"), rnd.randint(-5, 310)) for i in range(900)] + [(900, None, 3), (901, "h", None)]
    out = asof_join(spark.createDataFrame(left, "id int, key string, at int"), spark.createDataFrame(right, "key string, since int, no int"),
                    ["key"], "at", "since", ["no", "since"], ["no"], partitions=7)

    def last(key, at):
        before = [(s, n) for k, s, n in right if k == key and at is not None and s <= at]
        return max(before) if before else (None, None)

    assert sorted((r.id, r.no, r.since) for r in out.collect()) == [(i, *last(k, a)[::-1]) for i, k, a in left]
    empty = asof_join(spark.createDataFrame(left, "id int, key string, at int"), spark.createDataFrame([], "key string, since int, no int"),
                      ["key"], "at", "since", ["no"])
    assert empty.count() == len(left) and empty.filter("no is not null").isEmpty()


def test_written_back_lists_are_found(spark):
    """After a refresh a query that was searched is not searched again."""
    from conftest import SMALL
    from hitweave.plans import registry as R
    table, stored, items, fetched = R._refreshed(spark, SMALL)
    from hitweave.plans.answer import answers_and_searches
    from hitweave.sources import fixtures as fx
    finals = table.filter("kind = 'fresh'")  # as if feedback had dropped the merged lists only
    answers, searched = answers_and_searches(fx.requests(spark, SMALL), stored, items, fetched, finals, R.LATER)
    assert searched.count() == 0 and answers.filter("NOT from_cache").count() > 0


def test_clear_keeps_schema(spark):
    lists = spark.createDataFrame([("k", 1, "t", "l", "", 0.0, None, 0, False)], LIST)
    table = snap.snapshot_write(lists, "2024-01-01 00:00:00")
    cleared = snap.snapshot_clear(table)
    assert cleared.count() == 0 and cleared.schema == table.schema
