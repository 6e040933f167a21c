from collections import Counter

from keyloom.operators.skew import Fold, heavy_hashes, heavy_keys, salted_fold
from pyspark.sql import functions as F


def test_totals_equal_plain_grouping(spark, as_rows):
    data = [("hot", None if i % 7 == 0 else i) for i in range(3000)] + [(f"k{i % 500}", i) for i in range(2000)] + [(None, 5)] * 40
    df = spark.createDataFrame(data, "k string, v bigint").withColumn("kl_salt", F.lit("clash")).withColumn("n", F.lit(1))
    got = salted_fold(df, ["k"], [Fold("n", "count"), Fold("filled", "count", F.col("v")), Fold("total", "sum", F.col("v")), Fold("lo", "min", F.col("v")), Fold("hi", "max", F.col("v"))])
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"))
    assert as_rows(got) == as_rows(plain)


def test_heavy_keys_are_exact(spark):
    data = [("a", "x")] * 600 + [("b", "x")] * 100 + [("a", "X")] * 99 + [(str(i), "y") for i in range(9201)]
    df = spark.createDataFrame(data, "c string, k string")
    want = {k for k, n in Counter(data).items() if n >= 0.01 * len(data)}
    assert {(r.c, r.k) for r in heavy_keys(df, ["c", "k"], 0.01).collect()} == want == {("a", "x"), ("b", "x")}


def test_heavy_sketch_sees_every_heavy_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 400, F.lit(7)).otherwise(F.col("id")).alias("k"))
    hot = df.where("k = 7").select(F.xxhash64("k")).first()[0]
    assert hot in {r[0] for r in heavy_hashes(df, ["k"]).collect()}


def test_empty(spark):
    df = spark.createDataFrame([], "k string")
    assert salted_fold(df, ["k"], [Fold("n", "count")]).count() == 0
    assert heavy_keys(df, ["k"], 0.01).count() == 0
