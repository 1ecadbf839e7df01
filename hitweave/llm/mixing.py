"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. Targets: sources share the words of all documents by weight; a target stops at ``copies`` times
   its source's words, and the excess is shared again by weight until none is above.
2. Whole copies are certain: each document of a source is taken floor(target / words) times.
3. The rest of a target is a fixed size in words.  The source's documents are ranked by random odds
   over inclusion odds, u / (1 - u) over p / (1 - p), u a hash of the document, and taken once more in that order while they fit.
   The place where they stop fitting is found by sums per bucket of the rank, five times finer each
   time, so no source is sorted and no group of rows is gathered: a source may hold any share of the table.
4. What is left of the target there is filled by those of the next ``FILL`` documents that still fit, in order.

``odds`` multiplies a document's inclusion odds: documents of a source then have unequal
probabilities, and the words taken stay the same.

Defined results: null text has no words, a null source is a source of its own, the last one.  Rows
alike in id, text and source get the same random number; which of them are taken does not show.
A source without words has target 0; an empty table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.common import split_words, stored, text_or_empty
from hitweave.operators.ordinal import ordinal

WEIGHTS = (5, 2, 1)
COPIES = 3
FILL = 256
SEED = 7
BUCKETS = 4096
WHITE = r"[\x20\x09-\x0D]+"  # fixed value: what separates words
DIGITS = 13                  # hexadecimal digits of the random number, 52 bits


def measured(docs: DataFrame, doc_id: str, text: str, source: str, odds: Column, seed: int) -> DataFrame:
    """``doc_id, source, size, u, odds, tie``; ``tie`` tells rows apart that are alike."""
    whole = text_or_empty(text)
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole)
    number = F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("bigint").cast("double")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.size(split_words(whole, WHITE)).cast("bigint").alias("size"),
                       ((number + 0.5) / float(16**DIGITS)).alias("u"), odds.cast("double").alias("odds"),
                       F.monotonically_increasing_id().alias("tie"))


def targets(sources: DataFrame, weights=WEIGHTS, copies: int = COPIES) -> DataFrame:
    """``number, source, words, target``, from ``source, words``: sources in order of their code points, null last."""
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")).cast("bigint")
    placed = stored(ordinal(sources, [], [F.col("source").asc_nulls_last()], out="number", base=0).withColumn("weight", share), "sources")
    # Sources stop one after the other as the share of the rest grows; two numbers a step reach the driver.
    rest, weight = placed.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    whole, big = rest, "decimal(38,0)"
    while True:
        above = (F.col("words") * copies).cast(big) * F.lit(weight).cast(big) < F.lit(rest).cast(big) * F.col("weight").cast(big)
        stopped, still = placed.agg(F.coalesce(F.sum(F.when(above, F.col("words") * copies)), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if still == weight or not still:
            break
        rest, weight = whole - stopped, still
    shared = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(max(weight, 1)))
    return placed.select("number", "source", "words", F.when(above, (F.col("words") * copies).cast("double")).otherwise(shared).alias("target"))


def ranked(rows: DataFrame, planned: DataFrame, copies: int = COPIES) -> DataFrame:
    """``rows`` with ``target``, ``source_size``, ``whole`` (certain copies), ``left`` (words of its source
    beyond them) and ``z``, the place in the order, from 0 to 1; null if there is nothing more to take."""
    ratio = F.col("target") / F.col("source_size")
    p = F.col("left") / F.col("source_size")
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p) * F.col("odds"))
    p_s = planned.select("number", F.col("source").alias("s"), F.col("words").alias("source_size"), "target")
    return (rows.join(p_s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(copies))).otherwise(0).cast("bigint"))
            .withColumn("left", F.when(F.col("whole") < copies, F.floor(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0).cast("bigint"))
            .withColumn("z", F.when((F.col("left") > 0) & (F.col("size") > 0) & (F.col("odds") > 0), q / (1 + q))))


def first_without_room(rows: DataFrame) -> DataFrame:
    """Per source (``number``): ``z, tie`` of the first row in order that no longer fits, and ``left``,
    the words free before it."""
    steps = [F.floor(F.col("z") * BUCKETS), F.floor(F.col("z") * BUCKETS * BUCKETS), F.col("z"),
             F.shiftright("tie", 33), F.col("tie")]  # the rank coarse to fine; then the task that read a row, and the row
    inside = rows.filter("z is not null").select("number", "left", "size", "z", "tie")
    for i, step in enumerate(steps):
        inside = inside.withColumn("bucket", step)
        sums = inside.groupBy("number", "bucket").agg(F.sum("size").alias("words"), F.min("left").alias("left"))
        before = F.sum("words").over(Window.partitionBy("number").orderBy("bucket")) - F.col("words")
        cut = (sums.withColumn("left", F.col("left") - before).filter(F.col("words") > F.col("left"))
               .groupBy("number").agg(F.min("bucket").alias("at"), F.max("left").alias("free")))
        cut = stored(cut, "cut")
        inside = inside.join(cut, (inside["number"] == cut["number"]) & (F.col("bucket") == F.col("at"))) \
                       .select(inside["number"], F.col("free").alias("left"), "size", "z", "tie")
        if i == 0:  # one of many buckets: little is left from here on
            inside = stored(inside, "cut-bucket")
    return inside.select("number", F.col("z").alias("z_cut"), F.col("tie").alias("tie_cut"), F.col("left").alias("free"))


def filled(rows: DataFrame, cuts: DataFrame, fill: int = FILL) -> DataFrame:
    """``tie`` of the rows behind the cut that fill what is free before it."""
    behind = rows.join(cuts, "number").filter(
        (F.struct("z", "tie") >= F.struct(F.col("z_cut"), F.col("tie_cut"))) & (F.col("size") <= F.col("free")))
    near = behind.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy("z", "tie"))).filter(F.col("place") <= fill)
    # At most ``fill`` rows a source.
    lists = near.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "size", "tie"))).alias("rows"), F.min("free").alias("free"))
    empty = F.struct(F.col("free").alias("free"), F.array().cast("array<bigint>").alias("ties"))
    take = F.aggregate("rows", empty, lambda s, x: F.when(
        x["size"] <= s["free"], F.struct((s["free"] - x["size"]).alias("free"), F.concat(s["ties"], F.array(x["tie"])).alias("ties"))).otherwise(s))
    return lists.select(F.explode(take["ties"]).alias("tie"), F.lit(True).alias("fills"))


def mixture(docs: DataFrame, weights=WEIGHTS, copies: int = COPIES, odds: Column | None = None, seed: int = SEED, fill: int = FILL,
            doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``."""
    rows = stored(measured(docs, doc_id, text, source, F.lit(1.0) if odds is None else odds, seed), "measured")
    planned = targets(rows.groupBy("source").agg(F.sum("size").alias("words")), weights, copies)
    placed = ranked(rows, planned, copies)
    cuts = stored(first_without_room(placed), "cuts")
    more = stored(filled(placed, cuts, fill), "fills")
    before = (F.col("z") < F.col("z_cut")) | (F.col("z") == F.col("z_cut")) & (F.col("tie") < F.col("tie_cut"))
    taken = placed.join(cuts, "number", "left").join(more, "tie", "left")
    times = F.col("whole") + F.coalesce(F.when(before | F.col("fills"), 1), F.lit(0))
    return taken.select("doc_id", "source", "size", "source_size", "target", times.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))
