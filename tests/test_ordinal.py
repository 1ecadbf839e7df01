from pyspark.sql import Window
from pyspark.sql import functions as F

from hitweave.operators.ordinal import ordinal


def test_ordinal_equals_row_number_with_hot_key(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string")))
        .alias("k"), "id", (F.abs(F.hash("id")) % 50).alias("s"))
    a = ordinal(df, ["k"], [F.col("s").desc(), "id"], out="rn")
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy(F.col("s").desc(), "id")))
    j = a.join(b, ["k", "id"])
    assert j.count() == 5000
    assert j.filter("rn != rn2").count() == 0


def test_ordinal_null_group_and_base(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, v int")
    for n in (None, 1):
        got = sorted(((r.k, r.v, r.n) for r in ordinal(df, ["k"], ["v"], out="n", base=0, partitions=n).collect()), key=repr)
        assert got == sorted([(None, 1, 0), (None, 3, 1), ("a", 2, 0)], key=repr)
