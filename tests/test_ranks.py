"""Row numbers of groups, against a plain window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators.ranks import numbered


def test_numbers(spark):
    rows = [("hot" if k % 3 else f"g{k % 7}" if k % 5 else None, (k * 37) % 500, k, "x") for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, k int, __n string").repartition(6)
    got = numbered(df, ["g"], ["o", "k"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o", "k")))
    assert got.columns == ["g", "o", "k", "__n", "n"]
    assert sorted(map(str, [(r.g, r.k, r.n) for r in got.collect()])) == sorted(map(str, [(r.g, r.k, r.n) for r in want.collect()]))
    assert numbered(df.limit(0), ["g"], ["o"], "n").count() == 0
