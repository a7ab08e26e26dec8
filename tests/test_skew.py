import pytest
from pyspark.sql import functions as F

from millrace.operators import skew


@pytest.mark.parametrize("most", [0, 100])
def test_hot_keys_give_the_plain_join(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "ROWS_A_SALT", 10)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    many = spark.range(500).select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")).alias("key"))
    one = many.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(one, "key", "n")
    assert hot.count() == one.where("n > 10").count() and hot.orderBy(F.desc("_salts")).first()["key"] == "hot"
    for how in ("left", "inner"):
        got = skew.join_to_unique(many, one, "key", hot, F.xxhash64("id"), how)
        assert sorted(map(tuple, got.select("id", "key", "n").collect())) == sorted(map(tuple, many.join(one, "key", how).select("id", "key", "n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("rows", [0, 100])
def test_measured_tables_give_the_plain_join(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "ROWS_A_SALT", 10)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    many = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")).alias("key"))
    one = many.groupBy("key").agg(F.count("*").alias("n")).where("key <> '1'")
    for how in ("left", "inner"):
        got = skew.join_to_measured(many, one, "key", lambda: skew.hot_keys(one, "key", "n"), F.xxhash64("id"), how)
        assert sorted(map(tuple, got.select("id", "n").collect()), key=lambda r: r[0]) == sorted(map(tuple, many.join(one, "key", how).select("id", "n").collect()), key=lambda r: r[0])


def test_empty(spark):
    one = spark.createDataFrame([], "key string, n long")
    many = spark.createDataFrame([(1, "a")], "id long, key string")
    assert skew.join_to_unique(many, one, "key", skew.hot_keys(one, "key", "n"), F.xxhash64("id")).collect()[0]["n"] is None
