"""Windows over chunks must equal plain windows, also where one group holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voucherlake.operators import ordered


def hot(spark, n=500):
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise((F.col("id") % 20).cast("string")).alias("k"), F.col("id"))
    w = Window.partitionBy("k").orderBy("id")
    return rows.withColumn("ord", F.row_number().over(w)).withColumn("v", (F.col("id") * 7919 % 13).cast("long"))


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_neighbours(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("ord")
    plain = df.withColumn("prev", F.collect_list("v").over(w.rowsBetween(-5, -1))).withColumn(
        "next", F.collect_list("v").over(w.rowsBetween(1, 9)))
    for size in (1, 4, 1000):
        same(ordered.neighbours(df, ["k"], "ord", "v", 5, 9, size).select(plain.columns), plain)


def test_running_sum_and_last_before(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("ord")
    plain = df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "last", F.last(F.when(F.col("v") > 9, F.col("v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    got = ordered.running_sum(df, ["k"], ["ord"], F.col("v"), "s", 8)
    got = ordered.last_before(got, ["k"], ["ord"], F.when(F.col("v") > 9, F.col("v")), "last", 8)
    same(got.select(plain.columns), plain)


def test_first_rows_limit_on_the_map_side(spark):
    first = ordered.first_rows(hot(spark), ["k"], ["ord"])
    assert first.count() == hot(spark).select("k").distinct().count()
    assert first.filter("ord <> 1").count() == 0
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
