import random

import pytest
from pyspark.sql import functions as F

from tailseries.operators.skew import heavy_keys, spread_join


def tables(spark, seed=1):
    rng = random.Random(seed)
    left = [(None if rng.random() < 0.4 else rng.choice([1, 1, 1, 2, 3, 9]), rng.choice("ab"), i % 70) for i in range(900)]
    right = [(k, g, f"{k}{g}{i}") for k in (1, 2, 4, None) for g in "ab" for i in range(2)] + [(3, None, "n")]
    return (
        spark.createDataFrame(left, "k int, g string, v int").repartition(4),
        spark.createDataFrame(right, "k int, g string, w string"),
    )


def in_order(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_same_rows_as_the_plain_join(spark, how, null_safe):
    left, right = tables(spark)
    other = right.select(F.col("k").alias("k2"), F.col("g").alias("g2"), "w")
    same = [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in (("k", "k2"), ("g", "g2"))]
    plain = left.join(other, same[0] & same[1], how).drop("k2", "g2")
    got = spread_join(left, right, ["k", "g"], how=how, null_safe=null_safe, rows=20, heavy=8)
    assert got.columns == plain.columns
    assert in_order(got) == in_order(plain)


def test_heavy_keys_are_few_and_their_copies_bounded(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 3000, None).otherwise(F.col("id") % 50).alias("k"))
    top = heavy_keys(df, ["k"], rows=100, heavy=10).collect()
    assert len(top) == 10 and sum(r["__copies"] for r in top) < 20
    assert {r["k"]: r["__rows"] for r in top}[None] == 3000
    assert heavy_keys(df, ["k"], rows=5000).collect() == []


def test_a_key_with_all_rows_is_dealt_over_tasks(spark):
    left = spark.range(200_000).select(F.lit(None).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(None, "x"), (1, "y")], "k int, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = spread_join(left, right, ["k"], null_safe=True, rows=1000, heavy=64)
        parts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in parts) == 200_000
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 40_000


def test_empty_sides_self_join_and_clashing_names(spark):
    left, right = tables(spark)
    assert spread_join(left.limit(0), right, ["k", "g"]).collect() == []
    assert spread_join(left, right.limit(0), ["k", "g"], rows=20).where("w IS NOT NULL").collect() == []
    again = left.groupBy("k", "g").agg(F.count("*").alias("n"))
    assert spread_join(left, again, ["k", "g"], null_safe=True, rows=20).where("n IS NULL").collect() == []
    with pytest.raises(ValueError):
        spread_join(left, right.withColumnRenamed("w", "v"), ["k", "g"])
    with pytest.raises(ValueError):
        spread_join(left, right, ["k"], how="full")
