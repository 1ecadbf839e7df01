"""DuckDB SQL twins of the registered queries (the correctness oracle).

The derived inputs are CTEs over the pre-registered raw views; each query's SQL pulls in the CTEs it
needs.  HTML and character references have their own patterns here (RE2), written apart from the
library's; DuckDB needs the ``'g'`` option for global replace.
"""

from __future__ import annotations

from html.entities import html5

from hitweave.functions import text as _text
from hitweave.functions import timefn as _tf
from hitweave.functions.stopwords import listed as _listed
from hitweave.sources import fixtures as _fx

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_URL_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_ATTRS = r"""(?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?|["'])*"""
_TOKEN = (r"(?is)<!--.*?(?:--!?>|\z)" + "".join(rf"|<{n}(?:[\s/]{_ATTRS})?>.*?(?:</{n}(?:[\s/][^>]*)?>|\z)" for n in ("script", "style", "template"))
          + rf"|<[!?][^>]*>|</?[a-z]{_ATTRS}>|</[^a-z>][^>]*>|</>")
_ATTR = r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def visible_text(html: str) -> str:
    text = f"regexp_replace(coalesce({html}, ''), {q(_TOKEN)}, ' ', 'g')"
    return f"trim(regexp_replace({unescape(text)}, '{_WS}+', ' ', 'g'))"


def word_count(text: str) -> str:
    return f"CAST(len(list_filter(string_split_regex({text}, '{_WS}+'), lambda w: w <> '')) AS BIGINT)"


def _tags(html: str, name: str) -> str:
    tokens = f"regexp_extract_all(coalesce({html}, ''), {q(_TOKEN)}, 0)"
    return f"list_filter({tokens}, lambda t: regexp_matches(t, '(?i)^<{name}[\\s/>]'))"


def _names(tag: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace({tag}, '^<[^\\s/>]*', ''), {q(_ATTR)}, 1), lambda n: lower(n))"


def _attribute(tag: str, name: str) -> str:
    inside = f"regexp_replace({tag}, '^<[^\\s/>]*', '')"
    at = f"list_position({_names(tag)}, '{name}')"
    return "concat(" + ", ".join(f"regexp_extract_all({inside}, {q(_ATTR)}, {i})[{at}]" for i in (2, 3, 4)) + ")"


def link_count(html: str) -> str:
    return f"CAST(len(list_filter({_tags(html, 'a')}, lambda t: list_contains({_names('t')}, 'href'))) AS BIGINT)"


def url_host(url: str) -> str:
    return f"coalesce(regexp_extract({url}, {q(_URL_AUTHORITY)}, 1), '')"


def _literal_map(table: dict[str, str]) -> str:
    return f"MAP([{', '.join(q(k) for k in table)}], [{', '.join(q(v) for v in table.values())}])"


_NAMED = _literal_map(html5)
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_C1 = _literal_map({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})


def unescape(x: str) -> str:
    """Character references of ``x`` decoded: split before each ``&``, then piece by piece."""
    code = ("CASE WHEN regexp_matches(p, '^&#[0-9]') THEN try_cast(regexp_extract(p, '^&#([0-9]+)', 1) AS HUGEINT) "
            "ELSE try_cast('0x' || right(lpad(regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1), 12, '0'), 12) AS HUGEINT) END")
    char = (f"CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 OR n = 0 THEN '\ufffd' WHEN n BETWEEN 128 AND 159 THEN {_C1}[CAST(n AS VARCHAR)] "
            "WHEN n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n IN (11, 127) OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' "
            "ELSE chr(CAST(n AS INTEGER)) END")
    numeric = f"list_transform([{code}], lambda n: {char})[1] || regexp_replace(p, '^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?', '')"
    name = "regexp_extract(p, '^&([^\\t\\n\\f <&#;]{1,32};?)', 1)"
    old = f"regexp_extract(p, '^&({'|'.join(_OLD_NAMES)})', 1)"
    named = (f"list_transform([{_NAMED}], lambda m: CASE WHEN m[{name}] IS NOT NULL THEN m[{name}] || substr(p, 2 + length({name})) "
             f"WHEN {old} <> '' THEN m[{old}] || substr(p, 2 + length({old})) ELSE p END)[1]")
    piece = f"CASE WHEN regexp_matches(p, '^&#(?:[0-9]|[xX][0-9a-fA-F])') THEN {numeric} WHEN p LIKE '&_%' THEN {named} ELSE p END"
    return (f"list_transform([string_split({x}, '&')], lambda s: CASE WHEN len(s) = 1 THEN s[1] ELSE array_to_string(list_transform(s, lambda p0, i: "
            f"list_transform([CASE WHEN i = 1 THEN p0 ELSE '&' || p0 END], lambda p: CASE WHEN i = 1 THEN p ELSE {piece} END)[1]), '') END)[1]")


def query_words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{_WS}+'), lambda t: t <> '')"


def summary(query: str, context: str) -> str:
    ctx = f"coalesce({context}, '')"
    hits = (f"list_filter(string_split_regex({ctx}, {q(_text.SENTENCE_SPLIT)}), "
            f"lambda s: len(list_filter({query_words(query)}, lambda w: contains(lower(s), lower(w)))) > 0)")
    joined = f"array_to_string(list_transform(list_slice({hits}, 1, 2), lambda s: {strip_ws('s')}), ' ')"
    return (f"CASE WHEN len({hits}) > 0 AND length({joined}) > 20 THEN {joined} "
            f"ELSE substr({ctx}, 1, 200) || '...' END")


def ts(s: str) -> str:
    return f"TIMESTAMP {q(s)}"


def days_ago(now: str, days: int) -> str:
    return f"({ts(now)} - INTERVAL {int(days)} DAY)"


def parse_ts(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(_tf.DATE_PREFIX)}) THEN timezone('UTC', try_cast({x} AS TIMESTAMPTZ)) END"


def age_score(t: str, now: str) -> str:
    parts = [f"WHEN {t} IS NULL THEN {_tf.AGE_UNKNOWN}"]
    parts += [f"WHEN {t} > {days_ago(now, d)} THEN {s}" for d, s in _tf.AGE_STEPS]
    return f"CAST(CASE {' '.join(parts)} ELSE {_tf.AGE_OLDER} END AS DOUBLE)"


def meta_first(html: str) -> str:
    """First <meta> tag naming a publication date (null if none)."""
    named = f"{_attribute('m', 'property')} IN ('article:published_time', 'og:published_time')"
    dated = f"{_attribute('m', 'name')} IN ('date', 'publish-date', 'article.published')"
    return f"list_filter({_tags(html, 'meta')}, lambda m: {named} OR {dated})[1]"


def meta_content(tag: str) -> str:
    return f"nullif({_attribute(tag, 'content')}, '')"


def stop_list(words=_text.DEFAULT_STOP_WORDS) -> str:
    return "[" + ", ".join(q(w) for w in _listed(words)) + "]"


def tokens(x: str, words=_text.DEFAULT_STOP_WORDS) -> str:
    toks = f"regexp_extract_all(lower(coalesce({x}, '')), {q(_text.TOKEN_PATTERN)}, 0)"
    return f"list_filter({toks}, lambda t: NOT list_contains({stop_list(words)}, t))"


# ---------------------------------------------------------------------------
# derived inputs (FIXTURES.md §4) as CTEs: name -> (sql, dependencies)

_bl_values = ", ".join(f"({q(h)})" for h in _fx.FIXTURE_BLOCKLIST)
_day = "CAST(DATE '2024-01-31' - CAST(page_id * 7 % 800 AS INTEGER) AS VARCHAR)"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "page_base": (f"""SELECT page_id, url, html,
        {url_host('url')} AS query,
        regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
        {visible_text('html')} AS body
      FROM pages""", ()),
    "hits_with_pages": ("""SELECT query, row_number() OVER (PARTITION BY query ORDER BY page_id) - 1 AS pos,
        CASE WHEN page_id % 37 = 5 THEN '' ELSE title END AS title, url AS link, body AS snippet,
        page_id, html
      FROM page_base""", ("page_base",)),
    "items": ("SELECT query, pos, title, link, snippet FROM hits_with_pages", ("hits_with_pages",)),
    "page_fetch": ("""SELECT url, CAST(CASE WHEN page_id % 9 = 4 THEN 404 ELSE 200 END AS INTEGER) AS status, html, page_id * 2 + 1 AS fetch_id
                      FROM pages UNION ALL
                      SELECT url, 200 AS status, '<p>old</p>' || html AS html, page_id * 2 AS fetch_id FROM pages WHERE page_id % 6 = 1""",
                   ()),
    "last_fetch": ("SELECT url, arg_max(html, fetch_id) AS html FROM page_fetch WHERE status = 200 AND url IS NOT NULL GROUP BY url",
                   ("page_fetch",)),
    "dated_pages": (f"""SELECT page_id, url, query,
        CASE WHEN page_id % 10 = 0 THEN html
             WHEN page_id % 11 = 0 THEN '<meta property="article:published_time" content="not a date">' || html
             WHEN page_id % 2 = 0 THEN '<meta name="date" content="' || {_day} || '">' || html
             ELSE '<meta content="' || {_day} || 'T00:00:00Z" property="article:published_time">' || html
        END AS html
      FROM page_base""", ("page_base",)),
    "act": ("""SELECT e.event_id, e.event_type, e.ts, p.query, p.url AS link, p.title,
        p.body AS snippet, round(e.value / 500, 4) AS ml_rank
      FROM (SELECT ev.event_id, ev.event_type, ev.ts, ev.value,
                   (ev.user_id * 7 + CAST(json_extract_string(ev.props, '$.k') AS BIGINT)) % (SELECT count(*) FROM pages) AS pid
            FROM events ev) e
      JOIN page_base p ON p.page_id = e.pid""", ("page_base",)),
    "feedback": ("""SELECT CASE WHEN event_id % 13 <> 0 THEN event_id END AS event_id, ts, query, CASE WHEN event_id % 97 = 0 THEN NULL ELSE link END AS link,
        title, snippet, ml_rank, '' AS rag_summary, CAST(1 AS INTEGER) AS "rank"
      FROM act WHERE event_type = 'click'""", ("act",)),
    "stored": ("""SELECT query, link, min(title) AS title, min(snippet) AS snippet, min(ts) AS created,
        max(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) = 1 AS relevance, max(ml_rank) AS ml_rank,
        '' AS rag_summary, CAST(count(*) AS INTEGER) AS click_count, max(ts) AS last_clicked,
        CAST(1 + min(event_id) % 10 AS INTEGER) AS "rank"
      FROM act
      WHERE event_type = 'purchase'
      GROUP BY query, link""", ("act",)),
    "requests": (f"""SELECT DISTINCT query, tf AS time_filter
      FROM (SELECT {url_host('url')} AS query FROM pages UNION ALL SELECT '  '), (VALUES ('day'), ('month'), (''), ('decade')) AS t(tf)""", ()),
    "hosts": (f"SELECT query, row_number() OVER (ORDER BY query) - 1 AS number FROM (SELECT DISTINCT {url_host('url')} AS query FROM pages)", ()),
    "timed_requests": ("""SELECT event_id, ts AS asked_at, query || ['', ':day', ':month', ':year'][CAST(event_id % 4 + 1 AS INTEGER)] AS cache_key
      FROM events JOIN hosts ON user_id % (SELECT count(*) FROM hosts) = number""", ("hosts",)),
    "snapshot_times": ("""SELECT cache_key, 'final' AS kind, version, cached_at, cached_at + to_hours(CAST((day % 3 + version) * 10 AS BIGINT)) AS expires_at FROM (
        SELECT query || sfx AS cache_key, day, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(day AS INTEGER)) + to_hours(CAST(day * 7 % 24 AS BIGINT)) AS cached_at,
               unnest(CASE WHEN day % 5 = 0 THEN [1, 2] ELSE [1] END) AS version
        FROM hosts, (VALUES (''), (':day'), (':month')) AS s(sfx), (SELECT unnest(range(30)) AS day) WHERE (day + length(query)) % 4 <> 0)""", ("hosts",)),
    "blocklist": (f"SELECT * FROM (VALUES {_bl_values}) AS t(host)", ()),
    "search_queries": ("SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0", ()),
}


def with_ctes(body: str, *needed: str, extra: dict | None = None) -> str:
    """``WITH`` clause holding ``needed`` and their dependencies (in order) + ``body``.
    ``extra`` adds query-local CTEs (name -> (sql, deps)), emitted after the fixtures."""
    table = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in table[n][1]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    for n in (extra or {}):
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({table[n][0]})" for n in order) + "\n" + body
