"""The query registry: one Spark job per operator key, each with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.  Every
query reads the given tables (through the derived inputs of
``hitweave.sources.fixtures``) and runs over them whole.  Outputs are flat:
integers as bigint (the stored table's own int columns stay int), floats rounded
to 4 decimals, timestamps as TIMESTAMP_NTZ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.functions import text as tx
from hitweave.functions import timefn as tf
from hitweave.functions import web
from hitweave.functions.entities import html_unescape
from hitweave.operators import feedback as fb
from hitweave.operators import filters as flt
from hitweave.operators import merge as mg
from hitweave.operators import snapshots as snap
from hitweave.operators import tfidf
from hitweave.plans import answer
from hitweave.plans import oracle as o
from hitweave.plans import search as srch
from hitweave.session import materialize, prepare, scratch_path
from hitweave.sources import fixtures as fx
from hitweave.sources import landed, versions
from hitweave.sources.tables import read_pages, read_table
from hitweave.streaming import feedback_stream as fstream
from hitweave.streaming import snapshot_stream as sstream

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def ntz(c):
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# ---------------------------------------------------------------------------
# Landed hits and requests

@register("scan_items", o.with_ctes(
    "SELECT query, pos, title, link, snippet FROM items WHERE (pos // 10) % 5 <> 3", "items"))
def q_scan_items(spark, sf):
    """Hits of the successful responses landed as JSON lines (every fifth response page
    failed, and of every query one line is malformed)."""
    return landed.scan_items(_landed_responses(spark, sf))


@register("result_page", o.with_ctes(
    "SELECT query, pos, title, link, snippet FROM items WHERE pos BETWEEN 10 AND 19 AND (pos // 10) % 5 <> 3",
    "items"))
def q_result_page(spark, sf):
    """T4: the second page of hits (start=11, num=10) of every query."""
    return landed.result_page(landed.scan_items(_landed_responses(spark, sf)), start=11, num=10)


def _landed_responses(spark, sf):
    path = scratch_path(spark, "responses")
    r = fx.responses(spark, sf).select("start", F.to_json(F.struct("query", "start", "status", "items")).alias("value"))
    bad = r.filter("start = 1").select(F.concat(F.lit("{"), "value").alias("value"))
    r.select("value").unionByName(bad).write.text(path)
    return landed.read_responses(spark, path)


_T, _S = "coalesce(title, '')", "coalesce(snippet, '')"
_NORM_ITEMS = (f"SELECT query, pos, {o.unescape(_T)} AS title, coalesce(link, '') AS link, "
               f"{o.unescape(_S)} AS snippet FROM items")


@register("valid_items", o.with_ctes(
    f"SELECT * FROM ({_NORM_ITEMS}) WHERE link <> '' AND title <> ''", "items"))
def q_valid_items(spark, sf):
    """entity-decoded hits that have a link and a title."""
    return landed.valid_items(fx.items(spark, sf)).select("query", "pos", "title", "link", "snippet")


@register("html_unescape", o.with_ctes(
    f"SELECT page_id, title AS raw_title, {o.unescape('title')} AS title FROM page_base", "page_base"))
def q_html_unescape(spark, sf):
    """Page titles with their entities decoded."""
    pb = fx.page_base(spark, sf)
    return pb.select("page_id", F.col("title").alias("raw_title"), html_unescape(F.col("title")).alias("title"))


@register("clean_queries", o.with_ctes(
    """SELECT query, time_filter, CASE WHEN time_filter = '' THEN query ELSE query || ':' || time_filter END AS cache_key
       FROM (SELECT regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, coalesce(time_filter, '') AS time_filter
             FROM requests) WHERE query <> '' AND time_filter IN ('', 'day', 'month', 'year')""", "requests"))
def q_clean_queries(spark, sf):
    """Trimmed non-blank queries with a known time filter, and their cache keys."""
    return flt.clean_queries(fx.requests(spark, sf)).select("query", "time_filter", "cache_key")


@register("request_rejects", o.with_ctes(
    """SELECT query, time_filter, CASE WHEN query = '' THEN 'blank query' ELSE 'unknown time filter' END AS reason
       FROM (SELECT regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, coalesce(time_filter, '') AS time_filter
             FROM requests) WHERE query = '' OR time_filter NOT IN ('', 'day', 'month', 'year')""", "requests"))
def q_request_rejects(spark, sf):
    """F8/F2: requests that cannot be answered: blank queries and unknown time filters."""
    return flt.request_rejects(fx.requests(spark, sf)).select("query", "time_filter", "reason")


@register("blocklist_scan", f"""SELECT DISTINCT h AS host FROM (SELECT regexp_replace({o.url_host('url')}, '^\\s+|\\s+$', '', 'g') AS h FROM pages)
                                WHERE h <> ''""")
def q_blocklist_scan(spark, sf):
    """A blocklist file of the pages' hosts, with blank lines, spaces and repeats, read back."""
    path = scratch_path(spark, "blocklist")
    host = web.url_host("url")
    lines = read_table(spark, sf, "pages").select(F.explode(F.array(host, F.concat(F.lit("  "), host, F.lit("\t")), F.lit(""))).alias("value"))
    lines.write.text(path)
    return landed.read_blocklist(spark, path)


# ---------------------------------------------------------------------------
# Pages attached, summaries, ranked hits

_FIRST_VALID = f"SELECT * FROM ({_NORM_ITEMS}) WHERE pos BETWEEN 0 AND 9 AND link <> '' AND title <> ''"
_ATTACHED = (f"SELECT v.query, v.pos, v.title, v.link, v.snippet, coalesce(f.html, '') AS html FROM ({_FIRST_VALID}) v "
             "LEFT JOIN last_fetch f ON v.link = f.url")


@register("attach_pages", o.with_ctes(
    f"""SELECT v.query, v.pos, v.link, coalesce(f.html, '') AS html FROM ({_NORM_ITEMS}) v LEFT JOIN last_fetch f ON v.link = f.url
        WHERE v.link <> '' AND v.title <> ''""", "items", "last_fetch"))
def q_attach_pages(spark, sf):
    """Every valid hit with its last successful fetch ('' when there is none)."""
    hits = landed.valid_items(fx.items(spark, sf))
    return landed.attach_pages(hits, fx.page_fetch(spark, sf)).select("query", "pos", "link", "html")


_SEARCH_HITS = (f"SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY pos) AS BIGINT) AS rank, pos, "
                f"title, link, snippet, html, CASE WHEN html <> '' THEN {o.summary('title', 'snippet')} END AS rag_summary, "
                f"CAST(1.0 AS DOUBLE) AS ml_rank FROM ({_ATTACHED})")


@register("search_hits", o.with_ctes(f"SELECT * FROM ({_SEARCH_HITS})", "items", "last_fetch"))
def q_search_hits(spark, sf):
    """M1: cleaned, page-attached, summarised, ranked hits for every query."""
    h = srch.search_hits(fx.items(spark, sf), fx.page_fetch(spark, sf))
    return h.select("query", "rank", "pos", "title", "link", "snippet", "html", "rag_summary", "ml_rank")


@register("snippet_summary", o.with_ctes(
    f"SELECT query, pos, {o.summary('title', 'snippet')} AS rag_summary FROM ({_NORM_ITEMS})", "items"))
def q_snippet_summary(spark, sf):
    """Extractive summary of every hit's snippet for its title."""
    n = landed.normalise_items(fx.items(spark, sf))
    return n.select("query", "pos", tx.extractive_summary(F.col("title"), F.col("snippet")).alias("rag_summary"))


# ---------------------------------------------------------------------------
# Hosts and the blocklist

@register("url_host", f"SELECT page_id, url, {o.url_host('url')} AS host FROM pages")
def q_url_host(spark, sf):
    """Network location of every page URL."""
    return read_table(spark, sf, "pages").select("page_id", "url", web.url_host("url").alias("host"))


@register("blocklist_filter", o.with_ctes(
    f"""SELECT query, pos, link FROM items i
        WHERE NOT EXISTS (SELECT 1 FROM blocklist b WHERE b.host = {o.url_host('i.link')})""", "items", "blocklist"))
def q_blocklist_filter(spark, sf):
    """Hits whose host is not blocklisted (broadcast anti join)."""
    return flt.blocklist_filter(fx.items(spark, sf), fx.blocklist(spark)).select("query", "pos", "link")


# ---------------------------------------------------------------------------
# Page analysis and the quality floor

@register("page_text", f"SELECT page_id, {o.visible_text('html')} AS text FROM pages")
def q_page_text(spark, sf):
    """C11: visible text of every page."""
    return read_pages(spark, sf).select("page_id", web.visible_text("html").alias("text"))


_STATS = (f"SELECT page_id, {o.word_count(o.visible_text('html'))} AS word_count, {o.link_count('html')} AS link_count "
          "FROM pages")


@register("page_stats",
          f"SELECT page_id, word_count, link_count, round(word_count / greatest(link_count, 1), 4) AS content_score "
          f"FROM ({_STATS})")
def q_page_stats(spark, sf):
    """Words, links and words per link of every page."""
    s = flt.page_stats(read_pages(spark, sf))
    return s.select("page_id", "word_count", "link_count", r4("content_score").alias("content_score"))


_CF_STATS = (f"SELECT query, pos, link, {o.word_count(o.visible_text('html'))} AS w, {o.link_count('html')} AS l "
             f"FROM hits_with_pages h WHERE NOT EXISTS (SELECT 1 FROM blocklist b WHERE b.host = {o.url_host('h.link')})")


@register("content_filter", o.with_ctes(
    f"""SELECT query, pos, link, round(w / greatest(l, 1), 4) AS content_score,
               row_number() OVER (PARTITION BY query ORDER BY pos, link) AS final_rank
        FROM ({_CF_STATS}) WHERE w / greatest(l, 1) >= 50""", "hits_with_pages", "blocklist"))
def q_content_filter(spark, sf):
    """M2 (F3, C11-C15, F4, W3): blocklist, words-per-link floor 50, renumbered per query."""
    out = flt.content_filter(fx.measured_hits(spark, sf), fx.blocklist(spark), min_words=50)
    return out.select("query", "pos", "link", r4("content_score").alias("content_score"), "final_rank")


# ---------------------------------------------------------------------------
# Dates and time windows

_DATES = (f"SELECT page_id, query, published_date, published_date IS NOT NULL AS has_date, "
          f"{o.parse_ts('published_date')} AS published_ts FROM "
          f"(SELECT page_id, query, {o.meta_content('tag')} AS published_date FROM "
          f"(SELECT page_id, query, {o.meta_first('html')} AS tag FROM dated_pages))")


@register("page_dates", o.with_ctes(f"SELECT * FROM ({_DATES})", "dated_pages"))
def q_page_dates(spark, sf):
    """Publication date from the page's <meta>, parsed."""
    d = flt.page_dates(fx.dated_pages(spark, sf))
    return d.select("page_id", "query", "published_date", "has_date", ntz("published_ts").alias("published_ts"))


@register("time_relevance", o.with_ctes(
    f"SELECT page_id, {o.age_score('published_ts', fx.NOW_DATED)} AS time_relevance FROM ({_DATES})", "dated_pages"))
def q_time_relevance(spark, sf):
    """Freshness score of every dated page at 2024-01-31."""
    d = flt.page_dates(fx.dated_pages(spark, sf), now=fx.NOW_DATED)
    return d.select("page_id", "time_relevance")


def _dist_sql(now):
    t = "published_ts"
    cnt = lambda cond, name: f"CAST(count_if(coalesce({cond}, false)) AS BIGINT) AS {name}"
    cols = [cnt(f"{t} >= {o.days_ago(now, d)}", n) for d, n in
            ((1, "last_day"), (7, "last_week"), (30, "last_month"), (365, "last_year"))]
    cols += [cnt(f"{t} < {o.days_ago(now, 365)}", "older"), cnt(f"{t} IS NULL", "unknown")]
    return f"SELECT query, {', '.join(cols)} FROM ({_DATES}) GROUP BY query"


@register("date_distribution", o.with_ctes(_dist_sql(fx.NOW_DATED), "dated_pages"))
def q_date_distribution(spark, sf):
    """Per query, hits by publication age bucket at 2024-01-31."""
    d = flt.page_dates(fx.dated_pages(spark, sf))
    return flt.date_distribution(d, fx.NOW_DATED)


def _window_query(kind):
    now = fx.NOW_WINDOW[kind]
    days = tf.TIME_FILTER_DAYS[kind]

    @register(f"time_window_{kind}", o.with_ctes(
        f"SELECT query, link, created, click_count FROM stored WHERE created >= {o.days_ago(now, days)}", "stored"))
    def q(spark, sf):
        s = flt.time_window(fx.stored(spark, sf), kind, now)
        return s.select("query", "link", ntz("created").alias("created"), "click_count")
    q.__doc__ = f"F2: stored hits created in the last {days} day(s) before {now}."
    return q


for _k in ("day", "month", "year"):
    _window_query(_k)


# ---------------------------------------------------------------------------
# TF-IDF

def _tfidf_ctes(docs_sql: str, deps: tuple, max_features: int, prefix: str = "t") -> dict:
    """Query-local CTEs of the TF-IDF contract over ``docs_sql`` = (g, d, x)."""
    p = prefix
    return {
        f"{p}docs": (docs_sql, deps),
        f"{p}tf": (f"SELECT g, d, term, count(*) AS tf FROM (SELECT g, d, unnest({o.tokens('x')}) AS term FROM {p}docs) "
                   "GROUP BY g, d, term", (f"{p}docs",)),
        f"{p}sizes": (f"SELECT g, count(*) AS n_docs FROM {p}docs GROUP BY g", (f"{p}docs",)),
        f"{p}vocab": (f"""SELECT * FROM (SELECT g, term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df,
                            row_number() OVER (PARTITION BY g ORDER BY sum(tf) DESC, term) AS term_rank
                          FROM {p}tf GROUP BY g, term) WHERE term_rank <= {int(max_features)}""", (f"{p}tf",)),
        f"{p}idf": (f"""SELECT v.g, v.term, v.df, s.n_docs, ln((1.0 + s.n_docs) / (1.0 + v.df)) + 1 AS idf
                        FROM {p}vocab v JOIN {p}sizes s ON v.g = s.g""", (f"{p}vocab", f"{p}sizes")),
        f"{p}w": (f"""SELECT t.g, t.d, t.term, t.tf * i.idf AS w FROM {p}tf t
                      JOIN {p}idf i ON t.g = i.g AND t.term = i.term""", (f"{p}tf", f"{p}idf")),
    }


_DOCS_BY_SOURCE = _tfidf_ctes("SELECT source AS g, doc_id AS d, text AS x FROM documents", (),
                              tfidf.RANK_MAX_FEATURES)
_RTEXT = o.strip_ws("lower(concat_ws(' ', title, snippet))")
_ITEM_DOCS = _tfidf_ctes(f"SELECT query AS g, pos AS d, {_RTEXT} AS x "
                         f"FROM ({_NORM_ITEMS})", ("items",), tfidf.RANK_MAX_FEATURES)
_INDEX = _tfidf_ctes("SELECT 'index' AS g, doc_id AS d, text AS x FROM documents", (), tfidf.INDEX_MAX_FEATURES,
                     prefix="i")


def _source_model(spark, sf):
    docs = read_table(spark, sf, "documents").select("source", "doc_id", "text")
    return tfidf.Fitted(docs, "source", "doc_id", "text", tfidf.RANK_MAX_FEATURES)


def _norm_items(spark, sf):
    return landed.normalise_items(fx.items(spark, sf))


@register("ranking_text", o.with_ctes(
    f"SELECT query, pos, {_RTEXT} AS text FROM ({_NORM_ITEMS})", "items"))
def q_ranking_text(spark, sf):
    """``"title snippet"``, lower-cased and trimmed, of every hit."""
    return _norm_items(spark, sf).select("query", "pos", tx.ranking_text(F.col("title"), F.col("snippet")).alias("text"))


@register("tokens", f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
    FROM (SELECT doc_id, {o.tokens('text')} AS toks FROM documents)""")
def q_tokens(spark, sf):
    """C4: every document's token sequence (stop words removed), whole texts."""
    t = read_table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@register("term_freq", o.with_ctes(
    "SELECT g AS source, d AS doc_id, term, tf FROM ttf", extra=_DOCS_BY_SOURCE))
def q_term_freq(spark, sf):
    """A1: term frequency per document (corpus = source)."""
    return _source_model(spark, sf).tf.select("source", "doc_id", "term", "tf")


@register("vocabulary", o.with_ctes(
    "SELECT g AS source, term, ctf, df, term_rank FROM tvocab", extra=_DOCS_BY_SOURCE))
def q_vocabulary(spark, sf):
    """The 500 most frequent terms of each source."""
    return _source_model(spark, sf).vocab.select("source", "term", "ctf", "df", "term_rank")


@register("idf_table", o.with_ctes(
    "SELECT g AS source, term, df, n_docs, round(idf, 4) AS idf FROM tidf", extra=_DOCS_BY_SOURCE))
def q_idf_table(spark, sf):
    """A2: document frequency and smoothed IDF of each vocabulary term."""
    return _source_model(spark, sf).idf.select("source", "term", "df", "n_docs", r4("idf").alias("idf"))


@register("tfidf_vectors", o.with_ctes(
    "SELECT g AS source, d AS doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY g, d)), 4) AS weight FROM tw",
    extra=_DOCS_BY_SOURCE))
def q_tfidf_vectors(spark, sf):
    """A3/M5: L2-normalised TF-IDF weights of every document."""
    return _source_model(spark, sf).vectors().select("source", "doc_id", "term", r4("weight").alias("weight"))


@register("tfidf_rank", o.with_ctes(
    f"""SELECT query, pos, link, round(CASE WHEN anyh = 0 THEN 1.0 WHEN n = 1 THEN importance
                                       WHEN mx = mn THEN 0.0 ELSE (importance - mn) / (mx - mn) END, 4) AS ml_rank
        FROM sc JOIN (SELECT query, min(importance) AS mn, max(importance) AS mx, count(*) AS n,
                             max(CAST(has AS INTEGER)) AS anyh FROM sc GROUP BY query) st USING (query)""",
    extra={**_ITEM_DOCS,
           "imp": ("SELECT g, d, sum(w) / sqrt(sum(w * w)) AS importance FROM tw GROUP BY g, d", ("tw",)),
           "sc": (f"""SELECT h.query, h.pos, h.link, coalesce(i.importance, 0.0) AS importance,
                             i.importance IS NOT NULL AS has
                      FROM ({_NORM_ITEMS}) h LEFT JOIN imp i ON i.g = h.query AND i.d = h.pos""", ("imp",))}))
def q_tfidf_rank(spark, sf):
    """M3 (A4/A5): min-max scaled TF-IDF importance of every hit within its query."""
    ranked = tfidf.tfidf_rank(_norm_items(spark, sf), corpus="query", doc="pos")
    return ranked.select("query", "pos", "link", r4("ml_rank").alias("ml_rank"))


@register("feature_importance", o.with_ctes(
    """SELECT g AS query, term, round(idf, 4) AS idf, term_rank FROM (
         SELECT g, term, idf, row_number() OVER (PARTITION BY g ORDER BY df, term) AS term_rank FROM tidf)
       WHERE term_rank <= 10""", extra=_ITEM_DOCS))
def q_feature_importance(spark, sf):
    """The ten highest-IDF vocabulary terms of every query's result set."""
    fi = tfidf.feature_importance(_norm_items(spark, sf), corpus="query", doc="pos", top=10)
    return fi.select("query", "term", r4("idf").alias("idf"), "term_rank")


@register("feature_importance_map", o.with_ctes(
    """SELECT query, string_agg(term, ' ' ORDER BY term_rank) AS terms, count(*) AS n_terms, max(idf) AS best_idf FROM (
         SELECT g AS query, term, round(idf, 4) AS idf, row_number() OVER (PARTITION BY g ORDER BY df, term) AS term_rank FROM tidf)
       WHERE term_rank <= 10 GROUP BY query""", extra=_ITEM_DOCS))
def q_feature_importance_map(spark, sf):
    """The ten terms of every query as one map and in rank order (shown flat)."""
    m = tfidf.feature_importance_map(tfidf.feature_importance(_norm_items(spark, sf), corpus="query", doc="pos", top=10))
    return m.select("query", F.array_join("terms", " ").alias("terms"), F.size("idf_by_term").cast("bigint").alias("n_terms"),
                    r4(F.array_max(F.map_values("idf_by_term"))).alias("best_idf"))


def _similarity(index: dict) -> dict:
    """CTEs of the similarity of ``search_queries`` with an index's documents; result CTE ``sem``."""
    return {**index,
            "post": ("SELECT d AS doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY d)) AS weight FROM iw", ("iw",)),
            "qtf": (f"SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({o.tokens('text')}) AS term "
                    "FROM search_queries) GROUP BY query_id, term", ("search_queries",)),
            "qw": ("SELECT q.query_id, q.term, q.tf * i.idf AS w FROM qtf q JOIN iidf i ON q.term = i.term", ("qtf", "iidf")),
            "qv": ("SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qweight FROM qw", ("qw",)),
            "sem": ("""SELECT qv.query_id, post.doc_id, sum(qv.qweight * post.weight) AS score
                       FROM qv JOIN post ON qv.term = post.term GROUP BY qv.query_id, post.doc_id""", ("qv", "post"))}


_SEM = _similarity(_INDEX)
_SEM_ALL_TERMS = _similarity(_tfidf_ctes("SELECT 'index' AS g, doc_id AS d, text AS x FROM documents", (), 2**62, prefix="i"))
# fitted on the documents with odd ids; those with even ids are weighted by that vocabulary
_FITTED = _tfidf_ctes("SELECT 'index' AS g, doc_id AS d, text AS x FROM documents WHERE doc_id % 2 = 1", (), tfidf.INDEX_MAX_FEATURES, prefix="i")
_SEM_ADDED = _similarity({**_FITTED, "alltf": (f"""SELECT doc_id AS d, term, count(*) AS tf FROM (SELECT doc_id, unnest({o.tokens('text')}) AS term
                                                    FROM documents) GROUP BY doc_id, term""", ()),
                          "iw": ("SELECT d, t.term, t.tf * i.idf AS w FROM alltf t JOIN iidf i ON t.term = i.term", ("alltf", "iidf"))})
_TOP5 = """SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (
             SELECT query_id, doc_id, score,
                    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sem)
           WHERE rank <= 5"""


def _top5(spark, sf, index):
    t = index.topk(fx.search_queries(spark, sf), k=5)
    return t.select("query_id", "doc_id", r4("score").alias("score"), "rank")


@register("semantic_scores", o.with_ctes(
    "SELECT query_id, doc_id, round(score, 4) AS score FROM sem", extra=_SEM))
def q_semantic_scores(spark, sf):
    """Cosine similarity of each query with every document sharing a term."""
    s = tfidf.Index.fit(fx.search_docs(spark, sf)).scores(fx.search_queries(spark, sf))
    return s.select("query_id", "doc_id", r4("score").alias("score"))


@register("semantic_topk", o.with_ctes(_TOP5, extra=_SEM))
def q_semantic_topk(spark, sf):
    """The five most similar documents per query."""
    return _top5(spark, sf, tfidf.Index.fit(fx.search_docs(spark, sf)))


@register("semantic_topk_all_terms", o.with_ctes(_TOP5, extra=_SEM_ALL_TERMS))
def q_semantic_topk_all_terms(spark, sf):
    """The five most similar documents per query by an index of every term."""
    return _top5(spark, sf, tfidf.Index.fit(fx.search_docs(spark, sf), max_features=None))


@register("semantic_topk_loaded", o.with_ctes(_TOP5, extra=_SEM_ADDED))
def q_semantic_topk_loaded(spark, sf):
    """M5: an index fitted on half of the documents is saved, loaded, given the other half, and searched."""
    root, docs = scratch_path(spark, "saved-index"), fx.search_docs(spark, sf)
    tfidf.Index.fit(docs.filter(F.col("doc_id") % 2 == 1), root=root)
    tfidf.Index.load(spark, root).add(docs.filter(F.col("doc_id") % 2 == 0))
    return _top5(spark, sf, tfidf.Index.load(spark, root))


# ---------------------------------------------------------------------------
# Feedback and the results table

_FB_VALID = """SELECT event_id, ts, query, link, title, coalesce(snippet, '') AS snippet,
    coalesce(CAST(ml_rank AS DOUBLE), 0.0) AS ml_rank, coalesce(rag_summary, '') AS rag_summary,
    coalesce(CAST("rank" AS INTEGER), 1) AS "rank"
  FROM feedback WHERE query IS NOT NULL AND link IS NOT NULL AND title IS NOT NULL"""
_FB_ROLLUP = f"""SELECT query, link, count(*) AS clicks, min(ts) AS first_ts, max(ts) AS last_ts,
    arg_max(title, (ts, event_id)) AS l_title,
    arg_max(snippet, (ts, event_id)) AS l_snippet,
    arg_max(ml_rank, (ts, event_id)) AS l_ml_rank,
    arg_max(rag_summary, (ts, event_id)) AS l_rag_summary,
    arg_min("rank", (ts, event_id)) AS first_rank
  FROM ({_FB_VALID}) v GROUP BY query, link"""
_UPSERT = f"""SELECT coalesce(r.query, u.query) AS query, coalesce(r.link, u.link) AS link,
    CASE WHEN u.query IS NOT NULL THEN u.l_title ELSE r.title END AS title,
    CASE WHEN u.query IS NOT NULL THEN u.l_snippet ELSE r.snippet END AS snippet,
    CAST(CASE WHEN r.query IS NOT NULL THEN r."rank" ELSE u.first_rank END AS INTEGER) AS "rank",
    CASE WHEN r.query IS NOT NULL THEN r.created ELSE u.first_ts END AS created,
    CASE WHEN u.query IS NOT NULL THEN true ELSE r.relevance END AS relevance,
    CAST(CASE WHEN u.query IS NOT NULL THEN u.l_ml_rank ELSE r.ml_rank END AS DOUBLE) AS ml_rank,
    CASE WHEN u.query IS NOT NULL THEN u.l_rag_summary ELSE r.rag_summary END AS rag_summary,
    CAST(coalesce(r.click_count, 0) + coalesce(u.clicks, 0) AS INTEGER) AS click_count,
    CASE WHEN u.query IS NOT NULL THEN u.last_ts ELSE r.last_clicked END AS last_clicked
  FROM stored r FULL OUTER JOIN ({_FB_ROLLUP}) u ON r.query = u.query AND r.link = u.link"""
_RESULT_OUT = ("query", "link", "title", "snippet", "rank", "created", "relevance", "ml_rank", "rag_summary",
               "click_count", "last_clicked")


def _results_out(df):
    return df.select("query", "link", "title", "snippet", "rank", ntz("created").alias("created"), "relevance",
                     r4("ml_rank").alias("ml_rank"), "rag_summary", "click_count",
                     ntz("last_clicked").alias("last_clicked"))


_RESULTS_OUT_SQL = ('query, link, title, snippet, "rank", created, relevance, round(ml_rank, 4) AS ml_rank, '
                    'rag_summary, click_count, last_clicked')


@register("feedback_rejects", o.with_ctes(
    """SELECT event_id, CASE WHEN query IS NULL THEN 'missing query' WHEN link IS NULL THEN 'missing link'
                             ELSE 'missing title' END AS reason
       FROM feedback WHERE query IS NULL OR link IS NULL OR title IS NULL""", "feedback"))
def q_feedback_rejects(spark, sf):
    """feedback events lacking a required field, with the reason."""
    return fb.feedback_rejects(fx.feedback(spark, sf))


@register("feedback_rollup", o.with_ctes(
    f"""SELECT query, link, clicks, first_ts, last_ts, l_title AS title, l_snippet AS snippet,
               round(l_ml_rank, 4) AS ml_rank, l_rag_summary AS rag_summary, first_rank
        FROM ({_FB_ROLLUP})""", "feedback"))
def q_feedback_rollup(spark, sf):
    """Clicks per (query, link) with first/last time, latest fields and first rank."""
    r = fb.feedback_rollup(fx.feedback(spark, sf))
    return r.select("query", "link", "clicks", ntz("first_ts").alias("first_ts"), ntz("last_ts").alias("last_ts"),
                    F.col("latest.title").alias("title"), F.col("latest.snippet").alias("snippet"),
                    r4("latest.ml_rank").alias("ml_rank"), F.col("latest.rag_summary").alias("rag_summary"),
                    "first_rank")


@register("feedback_upsert", o.with_ctes(f"SELECT {_RESULTS_OUT_SQL} FROM ({_UPSERT})", "stored", "feedback"))
def q_feedback_upsert(spark, sf):
    """The results table after folding in every click."""
    return _results_out(fb.feedback_upsert(fx.stored(spark, sf), fx.feedback(spark, sf)))


@register("feedback_echo", o.with_ctes(
    f"""SELECT query, link, title, click_count, relevance FROM ({_UPSERT}) t
        WHERE EXISTS (SELECT 1 FROM ({_FB_VALID}) v WHERE v.query = t.query AND v.link = t.link)""", "stored", "feedback"))
def q_feedback_echo(spark, sf):
    """M7: what the feedback route answers for each changed row."""
    return fb.feedback_echo(fx.stored(spark, sf), fx.feedback(spark, sf))


@register("results_conform", o.with_ctes(
    f"""SELECT query, link, title, snippet, "rank", created, relevance, round(coalesce(ml_rank, 0.0), 4) AS ml_rank, rag_summary, click_count, last_clicked
        FROM (SELECT query, link, title, snippet, "rank", coalesce(CASE WHEN click_count % 2 = 0 THEN created END, {o.ts(fx.NOW_FEEDBACK)}) AS created,
                     coalesce(CASE WHEN click_count % 3 > 0 THEN relevance END, false) AS relevance, CAST(NULL AS DOUBLE) AS ml_rank, rag_summary,
                     CAST(0 AS INTEGER) AS click_count, last_clicked FROM stored)""", "stored"))
def q_results_conform(spark, sf):
    """Rows with missing fields and columns brought to the results table's schema and defaults."""
    partial = fx.stored(spark, sf).select(
        "query", "link", "title", "snippet", F.col("rank").cast("bigint").alias("rank"), F.when(F.col("click_count") % 2 == 0, F.col("created")).alias("created"),
        F.when(F.col("click_count") % 3 > 0, F.col("relevance")).alias("relevance"), F.lit(None).cast("double").alias("ml_rank"), "rag_summary", "last_clicked")
    return _results_out(fb.conform_results(partial, fx.NOW_FEEDBACK))


@register("results_version", ORACLE["feedback_upsert"])
def q_results_version(spark, sf):
    """The stored table and then its update written as two versions; the latest read back."""
    root = scratch_path(spark, "results")
    base = versions.write_version(fx.stored(spark, sf), root)
    versions.write_version(fb.feedback_upsert(versions.read_version(spark, root, base), fx.feedback(spark, sf)), root, base=base)
    return _results_out(versions.read_version(spark, root))


@register("results_replace", o.with_ctes(
    f"""SELECT {_RESULTS_OUT_SQL} FROM (
          SELECT query, link, title, snippet, "rank", created, relevance, ml_rank, rag_summary, click_count, last_clicked
          FROM stored s WHERE NOT EXISTS (SELECT 1 FROM ({_SEARCH_HITS}) h WHERE h.query = s.query AND h.link = s.link)
          UNION ALL
          SELECT query, link, title, snippet, CAST(rank AS INTEGER), {o.ts(fx.NOW_FEEDBACK)}, false, ml_rank,
                 coalesce(rag_summary, ''), 0, CAST(NULL AS TIMESTAMP)
          FROM ({_SEARCH_HITS}))""", "stored", "items", "last_fetch"))
def q_results_replace(spark, sf):
    """Fresh hits written replace-on-key into the results table."""
    hits = srch.search_hits(fx.items(spark, sf), fx.page_fetch(spark, sf))
    return _results_out(fb.results_replace(fx.stored(spark, sf), hits, fx.NOW_FEEDBACK))


@register("constraint_audit", o.with_ctes(
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows,
               CAST(count_if(query IS NULL) AS BIGINT) AS null_query, CAST(count_if("rank" IS NULL) AS BIGINT) AS null_rank,
               CAST(count_if(link IS NULL) AS BIGINT) AS null_link, CAST(count_if(title IS NULL) AS BIGINT) AS null_title,
               CAST((SELECT count(*) FROM (SELECT 1 FROM ({_UPSERT}) GROUP BY query, link HAVING count(*) > 1)) AS BIGINT)
                 AS dup_keys
        FROM ({_UPSERT})""", "stored", "feedback"))
def q_constraint_audit(spark, sf):
    """NOT NULL and UNIQUE(query, link) audit of the results table after feedback."""
    return fb.constraint_audit(fb.feedback_upsert(fx.stored(spark, sf), fx.feedback(spark, sf)))


# ---------------------------------------------------------------------------
# Stored results in order, counts per request

_T1 = 'relevance DESC NULLS FIRST, click_count DESC NULLS FIRST, "rank" ASC NULLS LAST, link'


@register("stored_results", o.with_ctes(
    f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY {_T1}) AS position, link, relevance, click_count,
               "rank" FROM stored""", "stored"))
def q_stored_results(spark, sf):
    """Every query's stored hits in display order (``position`` 1..n)."""
    s = mg.stored_order(fx.stored(spark, sf), "query", out="position", base=1)
    return s.select("query", "position", "link", "relevance", "click_count", "rank")


def _counts_sql(now):
    cols = ", ".join(f"count_if(created >= {o.days_ago(now, d)}) AS n_{n}" for n, d in tf.TIME_FILTER_DAYS.items())
    pick = " ".join(f"WHEN r.time_filter = '{n}' THEN c.n_{n}" for n in tf.TIME_FILTER_DAYS)
    return f"""SELECT r.query, r.time_filter,
                      CAST(coalesce(CASE WHEN r.time_filter = '' THEN c.n_all {pick} END, 0) AS BIGINT) AS n_results
               FROM requests r LEFT JOIN (SELECT query, count(*) AS n_all, {cols} FROM stored GROUP BY query) c
               ON r.query = c.query"""


@register("result_counts", o.with_ctes(_counts_sql(fx.NOW_STORED), "requests", "stored"))
def q_result_counts(spark, sf):
    """Stored hits per request (query, time filter) at 2024-01-20."""
    return mg.result_counts(fx.stored(spark, sf), fx.requests(spark, sf), fx.NOW_STORED)


# ---------------------------------------------------------------------------
# Merge, rank, format

_HIT_FIELDS_SQL = "title, link, snippet, ml_rank, rag_summary, click_count, relevance"


def _merge_sql(stored_sql: str, fresh_sql: str, key: str, p: str) -> dict:
    """CTEs of M4 over ``stored_sql`` / ``fresh_sql`` = (key, pos, hit fields); result CTE ``{p}mr``."""
    cols = f"{key}, CAST(pos AS BIGINT) AS pos, CAST(title AS VARCHAR) AS title, CAST(link AS VARCHAR) AS link, " \
           "CAST(snippet AS VARCHAR) AS snippet, CAST(ml_rank AS DOUBLE) AS ml_rank, " \
           "CAST(rag_summary AS VARCHAR) AS rag_summary, CAST(click_count AS BIGINT) AS click_count, " \
           "CAST(relevance AS BOOLEAN) AS relevance"
    return {
        f"{p}u": (f"SELECT {cols}, 'db' AS source, 0 AS prio FROM ({stored_sql}) "
                  f"UNION ALL SELECT {cols}, 'new' AS source, 1 AS prio FROM ({fresh_sql})", ()),
        f"{p}sz": (f"SELECT {key}, count_if(source = 'db') AS n_db, count_if(source = 'new') AS n_new FROM {p}u "
                   f"GROUP BY {key}", (f"{p}u",)),
        f"{p}dd": (f"""SELECT {key}, pos, title, link, snippet, coalesce(ml_rank, 0.0) AS ml_rank, rag_summary,
                         coalesce(click_count, 0) AS click_count, coalesce(relevance, false) AS relevance, source, prio
                       FROM (SELECT u.*, row_number() OVER (PARTITION BY u.{key}, u.link ORDER BY u.prio, u.pos) AS rn
                             FROM {p}u u JOIN {p}sz s ON u.{key} = s.{key} WHERE s.n_db > 0 AND s.n_new > 0)
                       WHERE rn = 1""", (f"{p}u", f"{p}sz")),
        f"{p}sc": (f"""SELECT d.*, 2.0 * CAST(relevance AS INTEGER)
                         + CASE WHEN n.mc > 0 THEN 1.0 * click_count / n.mc ELSE 0.0 END
                         + CASE WHEN n.mm > 0 THEN 1.0 * ml_rank / n.mm ELSE 0.0 END AS rank_score
                       FROM {p}dd d JOIN (SELECT {key}, max(click_count) AS mc, max(ml_rank) AS mm FROM {p}dd
                                          GROUP BY {key}) n ON d.{key} = n.{key}""", (f"{p}dd",)),
        f"{p}al": (f"""SELECT * FROM {p}sc UNION ALL
                       SELECT u.{key}, u.pos, u.title, u.link, u.snippet, u.ml_rank, u.rag_summary, u.click_count,
                              u.relevance, u.source, u.prio, CAST(NULL AS DOUBLE) AS rank_score
                       FROM {p}u u JOIN {p}sz s ON u.{key} = s.{key} WHERE NOT (s.n_db > 0 AND s.n_new > 0)""",
                   (f"{p}sc",)),
        f"{p}mr": (f"""SELECT *, row_number() OVER (PARTITION BY {key}
                                   ORDER BY round(rank_score, 9) DESC NULLS LAST, prio, pos, link) AS rank
                       FROM {p}al""", (f"{p}al",)),
    }


_STORED_SIDE = f"SELECT query, row_number() OVER (PARTITION BY query ORDER BY {_T1}) - 1 AS pos, {_HIT_FIELDS_SQL} FROM stored"
_FRESH_SIDE = (f"SELECT query, rank - 1 AS pos, title, link, snippet, ml_rank, rag_summary, 0 AS click_count, "
               f"false AS relevance FROM ({_SEARCH_HITS})")
_MERGE = _merge_sql(_STORED_SIDE, _FRESH_SIDE, "query", "m")


def _stored_side(spark, sf):
    return mg.stored_order(fx.stored(spark, sf), "query", out="pos", base=0)


def _fresh_side(spark, sf):
    """Fresh hits of every query."""
    h = srch.search_hits(fx.items(spark, sf), fx.page_fetch(spark, sf))
    return h.select("query", (F.col("rank") - 1).alias("pos"), "title", "link", "snippet", "ml_rank", "rag_summary",
                    F.lit(0).alias("click_count"), F.lit(False).alias("relevance"))


@register("merge_dedup", o.with_ctes(
    f"""SELECT query, link, source, pos FROM (
          SELECT *, row_number() OVER (PARTITION BY query, link ORDER BY prio, pos) AS rn FROM mu) WHERE rn = 1""",
    "stored", "items", "last_fetch", extra=_MERGE))
def q_merge_dedup(spark, sf):
    """Stored and fresh hits unioned, first row per (query, link) kept."""
    d = mg.merge_dedup(_stored_side(spark, sf), _fresh_side(spark, sf))
    return d.select("query", "link", "source", "pos")


@register("merge_rank", o.with_ctes(
    "SELECT query, rank, link, source, round(rank_score, 4) AS rank_score FROM mmr",
    "stored", "items", "last_fetch", extra=_MERGE))
def q_merge_rank(spark, sf):
    """M4 (A6, C16, W2, T2): merged and ranked lists; one-sided queries keep their own order."""
    m = mg.merge_rank(_stored_side(spark, sf), _fresh_side(spark, sf))
    return m.select("query", "rank", "link", "source", r4("rank_score").alias("rank_score"))


_FORMAT = ("SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank, link) AS rank, "
           "coalesce(title, 'Untitled') AS title, coalesce(link, '#') AS link, "
           "coalesce(snippet, 'No description available') AS snippet, coalesce(ml_rank, 0.0) AS ml_rank, rag_summary, "
           "coalesce(click_count, 0) AS click_count, coalesce(relevance, false) AS relevance FROM mmr")


def _formatted(spark, sf):
    return mg.format_results(mg.merge_rank(_stored_side(spark, sf), _fresh_side(spark, sf)), "query", "rank",
                            renumber=False)


@register("format_results", o.with_ctes(
    f"""SELECT query, rank, title, link, snippet, round(ml_rank, 4) AS ml_rank, rag_summary, click_count, relevance
        FROM ({_FORMAT})""", "stored", "items", "last_fetch", extra=_MERGE))
def q_format_results(spark, sf):
    """The merged lists in display shape, ranks 1..n."""
    return _formatted(spark, sf).select("query", "rank", "title", "link", "snippet", r4("ml_rank").alias("ml_rank"),
                                        "rag_summary", "click_count", "relevance")


@register("format_renumbered", o.with_ctes(
    f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank, link) AS rank, link, source_rank FROM (
          SELECT query, rank, rank AS source_rank, link FROM mmr WHERE source = 'new' OR rank % 3 <> 1)""",
    "stored", "items", "last_fetch", extra=_MERGE))
def q_format_renumbered(spark, sf):
    """Displayed lists from which some stored hits were taken out, numbered 1..n again."""
    m = mg.merge_rank(_stored_side(spark, sf), _fresh_side(spark, sf))
    left = m.filter((F.col("source") == "new") | (F.col("rank") % 3 != 1)).withColumn("summary", F.col("rank").cast("string"))
    out = mg.format_results(left, "query", "rank")
    return out.select("query", "rank", "link", F.col("rag_summary").cast("bigint").alias("source_rank"))


@register("score_text", o.with_ctes(
    f"SELECT query, rank, printf('%.2f', ml_rank) AS score_text FROM ({_FORMAT})",
    "stored", "items", "last_fetch", extra=_MERGE))
def q_score_text(spark, sf):
    """The two-decimal score text shown (and sent back) per displayed hit."""
    return _formatted(spark, sf).select("query", "rank", tx.score_text("ml_rank").alias("score_text"))


# ---------------------------------------------------------------------------
# Snapshots; M8: answer requests (flagship)

READ_NOW = "2024-02-01 00:05:00"
# The prior snapshot versions of the fixture (key suffix, cached_at,
# ttl seconds, list, version): a valid one, an expired one, and an older valid one that
# the valid one supersedes; plus a year-old version that feedback invalidates.
SNAPSHOT_VERSIONS = (
    (":month", "2024-02-01 00:00:00", 0, "stored", "final", 4),
    (":day", "2024-01-31 23:00:00", 600, "stored", "final", 2),
    (":month", "2024-01-31 23:58:00", 3600, "fresh", "final", 3),
    (":year", "2024-01-10 00:00:00", 31536000, "stored", "final", 1),
    # the fresh hit lists of the queries searched before (those with stored results)
    ("", "2024-02-01 00:01:00", 0, "searched", "fresh", 5),
    # a list with a long life, replaced by one that has expired: nothing may be served
    ("", "2024-01-31 23:30:00", 36000, "stored", "final", 2),
    ("", "2024-01-31 23:40:00", 60, "fresh", "final", 3),
    # written at the same time as another list of its key: the later version counts
    (":month", "2024-02-01 00:00:00", 0, "fresh", "final", 3),
    (":year", "2024-01-10 00:00:00", 31536000, "fresh", "final", 2),
)


def _lists(spark, sf, stored=None, items=None, fetched=None):
    """The two kinds of finished lists the fixture caches: stored lists (T1 order)
    and fresh hit lists, both as (query, rank, hit fields)."""
    stored = stored if stored is not None else fx.stored(spark, sf)
    items = items if items is not None else fx.items(spark, sf)
    fetched = fetched if fetched is not None else fx.page_fetch(spark, sf)
    st = mg.stored_order(stored, "query", out="rank", base=1)
    fresh = srch.search_hits(items, fetched).select(
        "query", "rank", "title", "link", "snippet", "ml_rank", "rag_summary",
        F.lit(0).alias("click_count"), F.lit(False).alias("relevance"))
    searched = fresh.join(stored.select("query").distinct(), "query", "left_semi")
    return {"stored": st, "fresh": fresh, "searched": searched}


def _fixture_snapshots(spark, sf, **inputs):
    """The prior snapshot table (written once to the shared folder, as it would
    be at rest)."""
    lists = _lists(spark, sf, **inputs)
    out = None
    for suffix, at, ttl, kind, snap_kind, version in SNAPSHOT_VERSIONS:
        src = lists[kind].withColumn("cache_key", F.concat(F.col("query"), F.lit(suffix)))
        w = snap.snapshot_write(src, at, kind=snap_kind, ttl_seconds=ttl, version=version)
        out = w if out is None else out.unionByName(w)
    return materialize(out)


_LIST_SQL = {
    "stored": f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY {_T1}) AS rank, title, link, snippet,
                         ml_rank, rag_summary, click_count, relevance FROM stored""",
    "fresh": f"""SELECT query, rank, title, link, snippet, ml_rank, rag_summary, 0 AS click_count, false AS relevance
                 FROM ({_SEARCH_HITS})""",
    "searched": f"""SELECT query, rank, title, link, snippet, ml_rank, rag_summary, 0 AS click_count,
                           false AS relevance FROM ({_SEARCH_HITS}) WHERE query IN (SELECT query FROM stored)""",
}


def _snap_sql():
    parts = []
    for suffix, at, ttl, kind, snap_kind, version in SNAPSHOT_VERSIONS:
        secs = ttl or snap.DEFAULT_TTL_SECONDS
        parts.append(f"""SELECT query || '{suffix}' AS cache_key, '{snap_kind}' AS kind, {version} AS version, {o.ts(at)} AS cached_at,
                                {o.ts(at)} + INTERVAL {secs} SECOND AS expires_at, CAST(rank AS BIGINT) AS rank, title,
                                link, snippet, CAST(ml_rank AS DOUBLE) AS ml_rank, rag_summary,
                                CAST(click_count AS BIGINT) AS click_count, relevance
                         FROM ({_LIST_SQL[kind]})""")
    return " UNION ALL ".join(parts)


_SNAP = {
    "snap": (_snap_sql(), ()),
    "vlatest": (f"""SELECT * EXCLUDE (place) FROM (SELECT *, dense_rank() OVER (PARTITION BY cache_key, kind ORDER BY cached_at DESC, version DESC) AS place
                    FROM snap WHERE cached_at <= {o.ts(READ_NOW)}) WHERE place = 1""", ("snap",)),
    "vall": (f"SELECT * FROM vlatest WHERE {o.ts(READ_NOW)} < expires_at", ("vlatest",)),
    "vsnap": ("SELECT * FROM vall WHERE kind = 'final'", ("vall",)),
    "vfresh": ("SELECT * FROM vall WHERE kind = 'fresh'", ("vall",)),
    "req": ("""SELECT DISTINCT query, time_filter,
                      CASE WHEN time_filter = '' THEN query ELSE query || ':' || time_filter END AS cache_key
               FROM (SELECT regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, coalesce(time_filter, '') AS time_filter
                     FROM requests) WHERE query <> '' AND time_filter IN ('', 'day', 'month', 'year')""", ()),
}
_SNAP_NEEDS = ("stored", "items", "last_fetch", "requests")
_HIT_OUT_SQL = ("rank, title, link, snippet, round(ml_rank, 4) AS ml_rank, rag_summary, click_count, relevance")


def _hits_out(df, *lead):
    return df.select(*lead, "rank", "title", "link", "snippet", r4("ml_rank").alias("ml_rank"), "rag_summary",
                     "click_count", "relevance")


@register("snapshot_write", o.with_ctes(
    f"""SELECT query || ':month' AS cache_key, 'final' AS kind, CAST((rank - 1) // 100 AS BIGINT) AS chunk,
               count(*) AS n_items, {o.ts(fx.NOW_FEEDBACK)} AS cached_at,
               {o.ts(fx.NOW_FEEDBACK)} + INTERVAL 600 SECOND AS expires_at
        FROM ({_LIST_SQL['stored']}) GROUP BY query, (rank - 1) // 100""", "stored"))
def q_snapshot_write(spark, sf):
    """Every query's stored list written as snapshot chunks with the default TTL."""
    st = _lists(spark, sf)["stored"].withColumn("cache_key", F.concat(F.col("query"), F.lit(":month")))
    w = snap.snapshot_write(st, fx.NOW_FEEDBACK)
    return w.select("cache_key", "kind", "chunk", "n_items", ntz("cached_at").alias("cached_at"),
                    ntz("expires_at").alias("expires_at"))


@register("snapshot_read", o.with_ctes(
    f"SELECT v.cache_key, {_HIT_OUT_SQL} FROM vsnap v WHERE v.cache_key IN (SELECT cache_key FROM req)",
    *_SNAP_NEEDS, extra=_SNAP))
def q_snapshot_read(spark, sf):
    """Decoded lists of the requests' valid, latest snapshots at the read time."""
    keys = flt.clean_queries(fx.requests(spark, sf))
    r = snap.snapshot_read(_fixture_snapshots(spark, sf), keys, READ_NOW)
    return _hits_out(r, "cache_key")


@register("snapshot_reuse", o.with_ctes(
    """SELECT r.cache_key, CASE WHEN EXISTS (SELECT 1 FROM vsnap v WHERE v.cache_key = r.cache_key)
                               THEN 'hit' ELSE 'miss' END AS status
       FROM (SELECT DISTINCT cache_key FROM req) r""", *_SNAP_NEEDS, extra=_SNAP))
def q_snapshot_reuse(spark, sf):
    """Which requests can reuse a snapshot and which must be computed."""
    keys = flt.clean_queries(fx.requests(spark, sf))
    return snap.snapshot_reuse(keys, _fixture_snapshots(spark, sf), READ_NOW)


_CHUNKS_SQL = ("SELECT cache_key, kind, CAST(version AS BIGINT) AS version, CAST((rank - 1) // 100 AS BIGINT) AS chunk, cached_at, count(*) AS n_items "
               "FROM {} GROUP BY cache_key, kind, version, (rank - 1) // 100, cached_at")
# the last feedback on each cache key
_TOUCHED_SQL = """SELECT query || sfx AS cache_key, max(ts) AS last_ts FROM feedback, (VALUES (''), (':day'), (':month'), (':year')) AS x(sfx)
                  WHERE query IS NOT NULL GROUP BY query || sfx"""


def _chunks_out(df):
    return df.select("cache_key", "kind", "version", "chunk", ntz("cached_at").alias("cached_at"), "n_items")


@register("snapshot_invalidate", o.with_ctes(
    f"""SELECT s.* FROM ({_CHUNKS_SQL.format('snap')}) s LEFT JOIN ({_TOUCHED_SQL}) f USING (cache_key)
        WHERE last_ts IS NULL OR cached_at > last_ts""",
    *_SNAP_NEEDS, "feedback", extra=_SNAP))
def q_snapshot_invalidate(spark, sf):
    """Snapshots left after the clicks invalidate the keys of their queries."""
    return _chunks_out(snap.snapshot_invalidate(_fixture_snapshots(spark, sf), fx.feedback(spark, sf)))


@register("snapshot_purge", o.with_ctes(_CHUNKS_SQL.format("vall"), *_SNAP_NEEDS, extra=_SNAP))
def q_snapshot_purge(spark, sf):
    """The snapshot table without the rows expired or replaced at the read time."""
    return _chunks_out(snap.snapshot_purge(_fixture_snapshots(spark, sf), READ_NOW))


@register("snapshot_version", ORACLE["snapshot_purge"])
def q_snapshot_version(spark, sf):
    """The snapshot table written as a version, purged into the next; the latest read back."""
    root = scratch_path(spark, "snapshots")
    base = versions.write_version(_fixture_snapshots(spark, sf), root)
    versions.write_version(snap.snapshot_purge(versions.read_version(spark, root, base), READ_NOW), root, base=base)
    return _chunks_out(versions.read_version(spark, root))


@register("snapshot_stream", o.with_ctes(
    f"""SELECT s.* FROM ({_CHUNKS_SQL.format('vall')}) s LEFT JOIN ({_TOUCHED_SQL}) f USING (cache_key)
        WHERE last_ts IS NULL OR cached_at > last_ts""",
    *_SNAP_NEEDS, "feedback", extra=_SNAP))
def q_snapshot_stream(spark, sf):
    """Snapshots dropped by a stream of clicks and by timers, delivered in three turns (half of the
    clicks before the snapshots are written, the others after, then the read time); what is left."""
    root, table = scratch_path(spark, "snapshot_stream"), _fixture_snapshots(spark, sf)
    clicks = fx.feedback(spark, sf).select("query", "ts", F.xxhash64("link").alias("part"))
    heads = table.select("cache_key", "kind", "version", "cached_at", "expires_at").distinct()
    clock = spark.range(1).select(tf.ts_lit("2024-01-01 00:00:00").alias("now"))
    turns = ((None, clicks.filter("part % 2 = 0"), clock), (heads, clicks.filter("part % 2 <> 0 OR part IS NULL"), clock),
             (None, None, clock.select(tf.ts_lit(READ_NOW).alias("now"))))
    heads.limit(0).write.parquet(f"{root}/writes")
    for turn in turns:
        for name, rows in zip(("writes", "clicks", "clock"), turn):
            if rows is not None:
                rows.write.mode("append").parquet(f"{root}/{name}")
        sstream.start_snapshot_stream(spark, *(f"{root}/{p}" for p in ("writes", "clicks", "clock", "drops", "state"))).awaitTermination()
    return _chunks_out(sstream.live_snapshots(table, sstream.read_drops(spark, f"{root}/drops")))


_SERVED = {"served": ("""SELECT r.*, version, cached_at, expires_at, row_number() OVER (PARTITION BY event_id ORDER BY cached_at DESC, version DESC) AS place
                     FROM timed_requests r LEFT JOIN snapshot_times s ON r.cache_key = s.cache_key AND cached_at <= asked_at""", ())}


@register("request_status_at", o.with_ctes(
    """SELECT event_id, cache_key, CASE WHEN asked_at < expires_at THEN CAST(version AS BIGINT) END AS version, CASE WHEN asked_at < expires_at THEN cached_at END AS cached_at,
              CASE WHEN asked_at < expires_at THEN 'hit' ELSE 'miss' END AS status FROM served WHERE place = 1""",
    "timed_requests", "snapshot_times", extra=_SERVED))
def q_request_status_at(spark, sf):
    """Every request at its own time: the version that was served then, or a miss."""
    served = snap.snapshots_at(fx.timed_requests(spark, sf), fx.snapshot_times(spark, sf))
    return served.select("event_id", "cache_key", "version", ntz("cached_at").alias("cached_at"), "status")


@register("snapshot_read_at", o.with_ctes(
    """SELECT event_id, cache_key, link, rank FROM (
         SELECT event_id, r.cache_key, link, rank, expires_at, asked_at,
                dense_rank() OVER (PARTITION BY event_id ORDER BY cached_at DESC, version DESC) AS place
         FROM timed_requests r JOIN snap s ON r.cache_key = s.cache_key AND cached_at <= asked_at WHERE kind = 'final') WHERE place = 1 AND asked_at < expires_at""",
    *_SNAP_NEEDS, "timed_requests", extra=_SNAP))
def q_snapshot_read_at(spark, sf):
    """The decoded lists that requests were served at their own times."""
    r = snap.snapshot_read_at(fx.timed_requests(spark, sf), _fixture_snapshots(spark, sf))
    return r.select("event_id", "cache_key", "link", "rank")


def _answer_sql():
    cut = " ".join(f"WHEN m.time_filter = '{n}' THEN {o.days_ago(READ_NOW, d)}" for n, d in tf.TIME_FILTER_DAYS.items())
    miss = "(SELECT * FROM req r WHERE NOT EXISTS (SELECT 1 FROM vsnap v WHERE v.cache_key = r.cache_key))"
    stored_side = f"""SELECT m.cache_key, row_number() OVER (PARTITION BY m.cache_key ORDER BY {_T1.replace('"rank"', 's."rank"')}) - 1
                             AS pos, s.title, s.link, s.snippet, s.ml_rank, s.rag_summary, s.click_count, s.relevance
                      FROM {miss} m JOIN stored s ON m.query = s.query
                      WHERE (CASE {cut} END) IS NULL OR s.created >= (CASE {cut} END)"""
    fresh_lists = f"""SELECT query, rank, title, link, snippet, ml_rank, rag_summary FROM ({_SEARCH_HITS}) x
                      WHERE NOT EXISTS (SELECT 1 FROM vfresh f WHERE f.cache_key = x.query)
                      UNION ALL
                      SELECT cache_key AS query, rank, title, link, snippet, ml_rank, rag_summary FROM vfresh"""
    fresh_side = f"""SELECT m.cache_key, h.rank - 1 AS pos, h.title, h.link, h.snippet, h.ml_rank, h.rag_summary,
                            0 AS click_count, false AS relevance
                     FROM {miss} m JOIN ({fresh_lists}) h ON m.query = h.query"""
    merge_ctes = _merge_sql(stored_side, fresh_side, "cache_key", "ans_")
    body = f"""SELECT r.cache_key, r.query, r.time_filter, a.rank, coalesce(a.title, 'Untitled') AS title,
                      coalesce(a.link, '#') AS link, coalesce(a.snippet, 'No description available') AS snippet,
                      round(coalesce(a.ml_rank, 0.0), 4) AS ml_rank, a.rag_summary, coalesce(a.click_count, 0) AS click_count,
                      coalesce(a.relevance, false) AS relevance, false AS from_cache
               FROM ans_mr a JOIN req r ON a.cache_key = r.cache_key
               UNION ALL
               SELECT r.cache_key, r.query, r.time_filter, {_HIT_OUT_SQL}, true AS from_cache
               FROM vsnap v JOIN req r ON v.cache_key = r.cache_key"""
    return o.with_ctes(body, *_SNAP_NEEDS, extra={**_SNAP, **merge_ctes})


LATER = "2024-02-01 00:06:00"


def _refreshed(spark, sf):
    """The snapshot table after the requests at the read time were answered and written back."""
    stored, items, fetched = fx.stored(spark, sf), fx.items(spark, sf), fx.page_fetch(spark, sf)
    snaps = _fixture_snapshots(spark, sf, stored=stored, items=items, fetched=fetched)
    answers, searched = answer.answers_and_searches(fx.requests(spark, sf), stored, items, fetched, snaps, READ_NOW)
    return materialize(answer.refresh_snapshots(snaps, answers, READ_NOW, searched=searched), "refreshed"), stored, items, fetched


@register("answer_after_refresh", _answer_sql().replace("false AS from_cache", "true AS from_cache"))
def q_answer_after_refresh(spark, sf):
    """The same requests a minute after their answers were written back: all from the cache."""
    table, stored, items, fetched = _refreshed(spark, sf)
    a = answer.answer_requests(fx.requests(spark, sf), stored, items, fetched, table, LATER)
    return a.select("cache_key", "query", "time_filter", "rank", "title", "link", "snippet",
                    r4("ml_rank").alias("ml_rank"), "rag_summary", "click_count", "relevance", "from_cache")


@register("fresh_written_back", o.with_ctes(
    f"""SELECT cache_key, rank, title, link, snippet, rag_summary FROM vfresh
        UNION ALL
        SELECT query AS cache_key, rank, title, link, snippet, rag_summary FROM ({_SEARCH_HITS}) h
        WHERE NOT EXISTS (SELECT 1 FROM vfresh f WHERE f.cache_key = h.query)
          AND EXISTS (SELECT 1 FROM req r WHERE r.query = h.query AND r.cache_key NOT IN (SELECT cache_key FROM vsnap))""",
    *_SNAP_NEEDS, extra=_SNAP))
def q_fresh_written_back(spark, sf):
    """The fresh lists that later requests find: those kept before and those searched for the requests."""
    table = _refreshed(spark, sf)[0]
    keys = table.select("cache_key").distinct()
    return snap.snapshot_read(table, keys, LATER, kind="fresh").select("cache_key", "rank", "title", "link", "snippet", "rag_summary")


@register("answer_requests", _answer_sql())
def q_answer_requests(spark, sf):
    """M8 (flagship): every request answered from a valid snapshot, or by merging
    its stored hits (in its time window) with the query's fresh hits."""
    stored, items, fetched = fx.stored(spark, sf), fx.items(spark, sf), fx.page_fetch(spark, sf)
    snaps = _fixture_snapshots(spark, sf, stored=stored, items=items, fetched=fetched)
    a = answer.answer_requests(fx.requests(spark, sf), stored, items, fetched, snaps, READ_NOW)
    return a.select("cache_key", "query", "time_filter", "rank", "title", "link", "snippet",
                    r4("ml_rank").alias("ml_rank"), "rag_summary", "click_count", "relevance", "from_cache")


# ---------------------------------------------------------------------------
# Feedback as a stream (same table as the batch fold)

STREAM_SPLIT = "2024-01-16 00:00:00"


@register("feedback_stream", ORACLE["feedback_upsert"])
def q_feedback_stream(spark, sf):
    """Clicks delivered as files three times (early half, late half, then a
    redelivery of some events of both), folded by the streaming job after each
    delivery; the results table equals the batch fold (``feedback_upsert``)."""
    root = scratch_path(spark, "feedback_stream")
    ev = fx.feedback(spark, sf).select(*[f.name for f in fstream.FEEDBACK_SCHEMA.fields])
    mid = tf.ts_lit(STREAM_SPLIT)
    early, late = ev.filter(F.col("ts") < mid), ev.filter(F.col("ts") >= mid)
    redelivered = ev.filter(((F.col("ts") >= mid) & (F.col("event_id") % 7 == 0))
                            | ((F.col("ts") < mid) & (F.col("event_id") % 11 == 0)))
    for part in (early, late, redelivered):
        part.write.mode("append").parquet(f"{root}/source")
        q = fstream.start_feedback_stream(spark, f"{root}/source", f"{root}/rollup", f"{root}/state", files_per_batch=None, compact=2)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return _results_out(fstream.results_from_stream(spark, fx.stored(spark, sf), f"{root}/rollup"))
