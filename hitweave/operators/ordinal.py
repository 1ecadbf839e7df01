"""Row numbers within groups that may be hot.

``row_number() over (partition by k order by o)`` sorts each group ``k`` inside
one task; a query holding a third of all rows would then be sorted by one core.
:func:`ordinal` gives the same numbers without that: rows are range-partitioned
on ``(k, o)`` (Spark samples the bounds, so a hot ``k`` is spread over many
tasks), each task numbers its rows in order, and a small table of per-task
counts turns the local numbers into group-wide ones.

* one range exchange of the rows, written once as Parquet (number narrow projections and join
  wide columns back); the count table has at most ``partitions + groups`` rows and is joined back
  (broadcast by AQE when small, otherwise a balanced hash join on ``(k, partition)``).
* ``order`` must be a total order within a group (add a unique tie-break),
  otherwise the numbering of equal rows is arbitrary, as with ``row_number``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.session import materialize

_P, _M, _N, _OG, _OP = "__hw_part", "__hw_mono", "__hw_n", "__hw_off_group", "__hw_first"


def _sort_key(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rn",
            base: int = 1, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = position of the row inside its ``keys`` group under ``order``
    (``base`` for the first row), as bigint.  One path for all sizes; null keys form a group."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_cols = [F.col(k) for k in keys]
    order_cols = [_sort_key(o) for o in order]
    # Written once: the task and row ids become plain data and both consumers read the same files.
    ranged = materialize(df.repartitionByRange(n, *key_cols, *order_cols)
                           .sortWithinPartitions(*key_cols, *order_cols)
                           .withColumn(_P, F.spark_partition_id())
                           .withColumn(_M, F.monotonically_increasing_id()), "ordinal")
    # Counts per (group, task), and the row id each group begins with in its task.
    counts = ranged.groupBy(*keys, _P).agg(F.count(F.lit(1)).alias(_N), F.min(_M).alias(_OP))
    earlier = Window.partitionBy(*keys).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__hw_k{i}") for i, k in enumerate(keys)], F.col(_P).alias("__hw_p"), _OP,
                            F.coalesce(F.sum(_N).over(earlier), F.lit(0)).alias(_OG))
    # null-safe on the group keys, so a null group is numbered like any other
    cond = [F.col(_P) == F.col("__hw_p")] + [F.col(k).eqNullSafe(F.col(f"__hw_k{i}")) for i, k in enumerate(keys)]
    joined = ranged.join(offsets, cond, "inner").drop("__hw_p", *[f"__hw_k{i}" for i in range(len(keys))])
    return (joined.withColumn(out, (F.col(_OG) + F.col(_M) - F.col(_OP) + F.lit(base)).cast("bigint"))
                  .drop(_P, _M, _OG, _OP))
