"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

1. Each text (A-Z lowered, null as empty) is cut into chunks where its own content says so,
   and becomes a *recipe*: the ordered list of its chunks' 64-bit identifiers, about 2 % of
   the text.  Chunks, joined, are the text, so equal texts have equal recipes.
2. Identifiers are verified: one aggregation over (identifier, 128 more bits of hash of the
   chunk) finds identifiers that stand for two different chunks.  Those, and only those, get
   the chunk's rank among its namesakes added.  After that equal recipes mean equal texts.
3. Recipes are compared: grouped, with the count and the largest doc_id combined before the
   shuffle, and joined back to the rows.  No text is shuffled at all.

Defined results: null text equals the empty text (an empty recipe).  Of rows tied for the
largest doc_id (repeated rows, or all ids null) exactly one stays: the least by all columns.
A null doc_id is less than any other.  Other columns, clashing names included, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.common import ascii_lower, stored, text_or_empty

# A chunk has 256 to 4096 characters and ends after white space that follows a vowel and one
# of n, r, s, t; without such a place it ends at 4096, and a text's last chunk where the text does.
CHUNK = r"(?s).{256,4096}?(?<=[aeiou][nrst]\s)|(?s).{1,4096}"


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key`` (a hash of the raw text), ``text_sha256``
    (of the normalised text) and ``recipe``, an array that is equal for equal texts only."""
    named = stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("key"), ascii_lower(text_or_empty(text)).alias("t"),
    ).select("doc_id", "key", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t")), lambda c: F.struct(
        identify(c).alias("id"), F.xxhash64(F.lit(1), c).alias("a"), F.xxhash64(F.lit(2), c).alias("b"))).alias("parts")), "recipes")
    # Equal triples are combined before the shuffle; an identifier with two digests (a, b) is not
    # yet an identifier.
    seen = named.select(F.explode("parts").alias("p")).select("p.*")
    clash = stored(seen.groupBy("id").agg(F.min("a").alias("a0"), F.max("a").alias("a1"),
                                          F.min("b").alias("b0"), F.max("b").alias("b1"))
                   .filter("a0 <> a1 or b0 <> b1").select("id"), "chunk-clashes")
    if clash.isEmpty():
        return named.select("doc_id", "key", "text_sha256", F.col("parts.id").alias("recipe"))
    ranked = seen.join(clash, "id", "left_semi").distinct().withColumn(
        "rank", F.rank().over(Window.partitionBy("id").orderBy("a", "b")))
    places = named.select("text_sha256", F.posexplode("parts").alias("pos", "p")).select("text_sha256", "pos", "p.*") \
                  .join(ranked, ["id", "a", "b"]) \
                  .groupBy("text_sha256").agg(F.map_from_entries(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
    renamed = F.transform("parts", lambda x, i: F.struct(x.id.alias("id"), F.coalesce(F.try_element_at("ranks", i), F.lit(0)).alias("rank")))
    return named.join(places, "text_sha256", "left").select("doc_id", "key", "text_sha256", renamed.alias("recipe"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = recipes(docs, doc_id, text, identify)
    marked = _marked(rows)
    plain = marked.filter("not tied").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    # Rows tied for the largest id are alike in every column here: one of them is kept.
    tied = marked.filter("tied").groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(
        F.count(F.lit(1)).alias("n")).select(
        "doc_id", "keep_id", "group_size", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i == 1)).alias("kept"),
        "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return plain.unionByName(tied)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = _marked(recipes(docs, doc_id, text, identify))
    stay = marked.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))) \
                 .select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "text_sha256", "n_largest").distinct()
    # The text moves here for the first and only time, with its row.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("key"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    single = kept.filter("n_largest = 1").select("row.*")
    tied = kept.filter("n_largest > 1").groupBy("text_sha256").agg(F.min("row").alias("row")).select("row.*")
    return single.unionByName(tied)


def _groups(rows: DataFrame) -> DataFrame:
    """Per recipe: the largest doc_id, the number of rows, and how many rows have that id."""
    per_id = rows.groupBy("recipe", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"),
        F.coalesce(F.max_by("n", "doc_id"), F.max("n")).alias("n_largest"))


def _marked(rows: DataFrame) -> DataFrame:
    groups = stored(_groups(rows), "recipe-groups")  # so that both sides of the join are plain, and Spark can split a hot recipe
    return rows.join(groups, "recipe").withColumn(
        "tied", (F.col("n_largest") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
