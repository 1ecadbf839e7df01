"""Helpers shared by the operators: A-Z lowering, text defaults, result tables in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.operators.ordinal import ordinal
from hitweave.session import scratch_path


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# Characters other than A-Z that ``lower`` may change; none is below U+00C0.  (Cn: what the JVM does
# not know yet but ``lower`` may.)
_OTHER_CAPITAL = r"[\x{C0}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{IsUppercase}\p{Cn}]]"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other alphabets).

    ``lower`` changes only upper- and title-case characters, so a text without any beyond
    A-Z is lowered whole; another is cut before each such character, which is then left
    alone.  (``translate`` gives the same, ten times as slowly.)"""
    parts = F.split(F.concat(F.lit("a"), col), f"(?={_OTHER_CAPITAL})")  # the "a": only later parts start with a capital
    spared = F.transform(parts, lambda s, i: F.when(i == 0, F.lower(s)).otherwise(
        F.concat(F.substring(s, 1, 1), F.lower(F.substring(s, 2, 2**31 - 1)))))
    return F.when(col.rlike(_OTHER_CAPITAL), F.substring(F.array_join(spared, ""), 2, 2**31 - 1)).otherwise(F.lower(col))


def split_words(col: Column, separators: str) -> Column:
    """Words of a text as an array: a split on runs of ``separators`` (a regular expression)
    without the empty first or last element."""
    parts = F.split(col, separators)
    first = F.when(F.get(parts, 0) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back: the lineage
    ends there, the statistics are exact, and a lost executor re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_name(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column of the input has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def any_ids(operator: Callable) -> Callable:
    """Let an operator that works on integer ids take any: others are numbered in their order first, and the
    numbers turned back into ids at the end.  (Only then do the texts move once more.)"""
    @wraps(operator)
    def run(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        kind = docs.schema[doc_id].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return operator(docs, doc_id, text)
        rows = docs.select(F.col(f"`{doc_id}`").alias("name"), F.col(f"`{text}`").alias("text"))
        names = stored(ordinal(rows.select("name").distinct().filter("name is not null"), [], ["name"], out="number"), "id-numbers")
        out = operator(rows.join(names, "name", "left").select(F.col("number").alias("doc_id"), "text"), "doc_id", "text")
        return out.join(names, out["doc_id"] == names["number"], "left").select(
            F.col("name").alias("doc_id"), *[out[c] for c in out.columns if c != "doc_id"])
    return run


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package, wherever it was imported from.
    (On a cluster it is installed on the executors.)"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)
