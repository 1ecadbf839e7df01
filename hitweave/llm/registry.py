"""Registered queries of the operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitweave.llm import (clusters, decontam, exact, html_text, lexical, mixing, quality, simhash, spm, substring, suffix,
                          toxicity, warc)

# The vocabulary file of op6 and the pipeline; an operator takes any path.
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pieces_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(PIECES))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontaminate", f"""
WITH items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(list_slice(w, i, i + 12), ' ') AS win,
                least(len(w), 13) AS n
         FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
spans AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
          FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, s.n, item FROM spans s JOIN wins USING (win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS v(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS lst FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(lst, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM rep, unnest(range(i, i + 20)) AS v(p)),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op4_exact_dedup", f"""
WITH n AS (SELECT doc_id, {_LOWER.format('text')} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encoded(table(spark, sf_dir, "documents"), pieces_model())


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT page_id, octet_length(b) AS payload_bytes, payload_digest,
             CASE WHEN octet_length(b) >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM r""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_lexical_search", f"""
WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents),
t AS (SELECT count_if(len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark)),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM items) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), t),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS c FROM tf JOIN w USING (term), t),
s AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM items JOIN c USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_mix_sources", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE)
   + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
s AS (SELECT source, words, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source)),
k AS (SELECT *, 3 * words / w AS ratio, CAST((SELECT sum(words) FROM s) - coalesce(sum(3 * words) OVER before, 0) AS BIGINT) AS rest,
             CAST((SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0) AS BIGINT) AS ws
      FROM s WINDOW before AS (ORDER BY 3 * words / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
fit AS (SELECT rest, ws FROM k WHERE rest * w <= 3 * words * ws ORDER BY ratio LIMIT 1),
plan AS (SELECT source, words, CASE WHEN 3 * words * ws < rest * w THEN CAST(3 * words AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(ws AS DOUBLE) END AS target
         FROM s, fit),
p AS (SELECT d.*, words, target, CASE WHEN words > 0 THEN least(CAST(floor(target / words) AS BIGINT), 3) ELSE 0 END AS whole
      FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
l AS (SELECT *, CASE WHEN whole < 3 THEN CAST(floor(target - whole * words) AS BIGINT) ELSE 0 END AS room FROM p),
z AS (SELECT *, q / (1 + q) AS z FROM (SELECT *, CASE WHEN room > 0 AND size > 0 THEN
        (u / (1 - u)) / ((CAST(room AS DOUBLE) / words) / (1 - CAST(room AS DOUBLE) / words)) END AS q FROM l)),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY z, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM z WHERE z IS NOT NULL),
f AS (SELECT source, min((z, doc_id)) AS cut, arg_min(room - used + size, (z, doc_id)) AS free FROM c WHERE used > room GROUP BY source),
b AS (SELECT c.source, c.doc_id, size, free, row_number() OVER (PARTITION BY c.source ORDER BY z, doc_id) AS place
      FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source WHERE (z, doc_id) >= cut AND size <= free),
step AS (SELECT source, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS doc_id, min(free) AS free, false AS fits FROM b GROUP BY source
         UNION ALL
         SELECT b.source, b.place, b.doc_id, step.free - CASE WHEN b.size <= step.free THEN b.size ELSE 0 END, b.size <= step.free
         FROM step JOIN b ON b.source IS NOT DISTINCT FROM step.source AND b.place = step.place + 1 WHERE b.place <= 256)
SELECT z.doc_id, z.size, z.words AS source_size, z.target, CAST(z.size * (whole + CASE WHEN (z.z, z.doc_id) < f.cut OR step.fits THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z LEFT JOIN f ON z.source IS NOT DISTINCT FROM f.source LEFT JOIN step ON step.doc_id = z.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _moved(centroids: str, i: int) -> str:
    """SQL of one assignment to ``centroids`` (``a{i}``) and of the centroids after it (``c{i + 1}``)."""
    near = f"""a{i} AS (SELECT vec_id, v, arg_min(no, (d, no)) AS no, min(d) AS d FROM (
        SELECT vec_id, q.rid, q.v, no, CAST(list_sum(list_transform(range(1, 65), lambda j: (q.v[j] - c.v[j]) * (q.v[j] - c.v[j]))) AS BIGINT) AS d
        FROM q, {centroids} c) GROUP BY vec_id, rid, v)"""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    move = f"""m{i} AS (SELECT no, list({floor} ORDER BY j) AS v FROM (SELECT no, j, count(*) AS n, CAST(sum(v[j]) AS BIGINT) AS s
        FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY no, j) GROUP BY no),
      c{i + 1} AS (SELECT c.no, coalesce(m.v, c.v) AS v FROM {centroids} c LEFT JOIN m{i} m USING (no))"""
    return near if i == 3 else f"{near}, {move}"


@query("op13_orchard_clusters", f"""
WITH q AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS no, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM q ORDER BY h, v LIMIT 16)),
{', '.join(_moved(f'c{i}', i) for i in range(4))},
t AS (SELECT no, CAST(sum(d) AS BIGINT) AS ci FROM a3 GROUP BY no)
SELECT vec_id, CAST(no AS INTEGER) AS cluster, d AS distance, ci AS cluster_inertia, CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN t USING (no) JOIN c3 USING (no)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.clustered(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
