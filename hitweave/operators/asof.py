"""As-of join: each row of one table with the last row of another at or before its time.

Both tables are put in one order, by key and time, and dealt out by ranges of it, so a key that holds a third of
all rows is spread over many tasks.  Within a task the last row seen is carried forward; a task
that begins inside a key takes what the tasks before it ended with, from a table of one row per key and task.
No pair of rows is formed, and no key is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.session import materialize

_PART, _LAST, _ROW, _TIME, _RANK, _VALUE = "__hw_part", "__hw_last", "__hw_row", "__hw_time", "__hw_rank", "__hw_value"


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str],
              right_order: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """The rows of ``left`` with ``columns`` of the last row of ``right`` that has equal ``keys`` and a
    ``right_time`` at or before ``left_time``; null without one.  Of rows of one time the last by
    ``right_order`` counts.  Null keys and times match nothing; rows of ``left`` all stay."""
    n = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_names = [f"__hw_k{i}" for i in range(len(keys))]
    missing = F.lit(False)
    for k in [*keys, left_time]:
        missing = missing | F.col(k).isNull()

    def placed(df: DataFrame, time: str, rank: Column, order: Column, row: Column, value: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(a) for k, a in zip(keys, key_names)], F.col(time).alias(_TIME), rank.alias(_RANK),
                         order.alias("__hw_order"), row.alias(_ROW), value.alias(_VALUE))

    fields = F.struct(*[F.col(c) for c in columns])
    order = F.struct(*[F.col(c) for c in right_order]) if right_order else F.struct(F.lit(0).alias("o"))
    row = F.struct(*[F.col(c) for c in left.columns])
    null_like = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    rows = placed(right, right_time, F.lit(0), order, null_like(left, row), fields).unionByName(
        placed(left.filter(~missing), left_time, F.lit(1), null_like(right, order), row, null_like(right, fields)))
    place = [*key_names, _TIME, _RANK, "__hw_order"]  # a right row comes before the left rows of its time
    dealt = materialize(rows.repartitionByRange(n, *place).sortWithinPartitions(*place).withColumn(_PART, F.spark_partition_id())
                        .withColumn("__hw_id", F.monotonically_increasing_id()), "asof")
    ends = dealt.filter(F.col(_RANK) == 0).groupBy(*key_names, _PART).agg(F.max_by(_VALUE, "__hw_id").alias(_LAST))
    # One row per key and task that holds it: what the tasks before it ended with.
    tasks = dealt.groupBy(*key_names, _PART).agg(F.lit(1).alias("__hw_one")).drop("__hw_one").join(ends, [*key_names, _PART], "left")
    before = Window.partitionBy(*key_names).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = tasks.withColumn("__hw_carried", F.last(_LAST, ignorenulls=True).over(before)).drop(_LAST)
    seen = Window.partitionBy(*key_names, _PART).orderBy("__hw_id").rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn(_LAST, F.last(_VALUE, ignorenulls=True).over(seen)).filter(F.col(_RANK) == 1)
    found = here.join(carried, [*key_names, _PART]).select(f"{_ROW}.*", F.coalesce(F.col(_LAST), F.col("__hw_carried")).alias(_VALUE))
    out = found.select(*left.columns, *[F.col(f"{_VALUE}.{c}").alias(c) for c in columns])
    nothing = left.filter(missing).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    return out.unionByName(nothing)
