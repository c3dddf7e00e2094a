"""Reproducible samples and splits by the order of a hash, at any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.prefix import hash_key, prefix_sums


def sample_k(df: DataFrame, key: str, k: int, seed: str = "42") -> DataFrame:
    """Exactly min(k, n) rows, those first in hash order of key (a top-k, never a full sort). Repeated keys stand by
    nothing else, so keys should be unique; null counts as a key."""
    return df.withColumn("_h", hash_key(key, seed=seed)).orderBy("_h", key).limit(k).drop("_h")


def make_split(df: DataFrame, key: str = "doc_id", train: float = 0.8, dev: float = 0.1, seed: str = "42", ensure_nonempty_test: bool = True) -> DataFrame:
    """df (unique key) with split. In hash order the first max(1, floor(n x train)) are train, the next max(1,
    floor(n x dev)) dev, the rest test. Where nothing is left for test and ensure_nonempty_test is set, the last
    record comes a second time, as test. Ranks are prefix sums over slices of the hash, never one global window."""
    n = df.count()
    if not n:
        return df.withColumn("split", F.lit(None).cast("string"))
    a, b = max(1, int(n * train)), max(1, int(n * dev))
    ranked = prefix_sums(df.withColumn("_h", hash_key(key, seed=seed)).withColumn("_all", F.lit(0)), ["_all"], "_h", [key], F.lit(1), n, out="_place")
    split = F.when(F.col("_place") <= a, "train").when(F.col("_place") <= a + b, "dev").otherwise("test")
    out = ranked.withColumn("split", split)
    if n <= a + b and ensure_nonempty_test:
        out = out.unionByName(ranked.where(F.col("_place") == n).withColumn("split", F.lit("test")))
    return out.drop("_h", "_all", "_place")


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows and share per split; null is a split of its own."""
    whole = df.agg(F.count("*").alias("n_all"))
    return df.groupBy("split").agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(whole)).select("split", "n_rows", (F.col("n_rows") / F.col("n_all")).alias("share"))


def shared_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split, with the splits: none where a split is free of leaks."""
    per = df.where(F.col("split").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s"))
    return per.where(F.size("s") > 1).select(key, F.array_join("s", ",").alias("splits"))
