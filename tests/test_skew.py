from statistics import median

import pytest
from pyspark.sql import functions as F

from quillon.operators.skew import salted_join


@pytest.fixture
def without_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tables(spark):
    big = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 4_000).alias("k"), "id")
    one = spark.range(3_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return big, one


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_the_plain_join(without_adaptive, how):
    big, one = tables(without_adaptive)
    got, want = (d.select(*sorted(d.columns)) for d in (salted_join(big, one, "k", how, 1_000), big.join(one, "k", how)))
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_a_hot_key_is_spread_evenly(without_adaptive):
    spark = without_adaptive
    star = spark.range(1_000_000).select(F.lit("hub").alias("k"), "id")
    out = salted_join(star, spark.createDataFrame([("hub", 1)], "k string, v int"), "k", "left", 1_000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * median(sizes)


def test_small_and_empty_tables_join_plainly(spark):
    big, one = tables(spark)
    assert "_salt" not in salted_join(big.limit(10), one, "k")._jdf.queryExecution().toString()
    assert salted_join(big.limit(0), one, "k").count() == salted_join(big, one.limit(0), "k", "inner", 1_000).count() == 0
