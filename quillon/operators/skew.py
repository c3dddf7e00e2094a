"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows under one key below which it is left alone.
LEAST_HOT = 50_000
#: Shares of a task that a salted part of a hot key weighs: parts are so small that they even out over the tasks.
PARTS_OF_TASK = 16


def salted_join(big: DataFrame, one: DataFrame, keys: str | list[str], how: str = "inner", least: int = LEAST_HOT, counted: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """big.join(one, keys, how) for a big side that is a written table and any other (inner, left, left_semi or left_anti), of which the rows under hot
    keys are repeated, so that one row a key or few are meant.
    counted: a written table with the keys of big, where big is none itself; rows: its number of rows where known.

    Keys with more than a sixteenth of a task's even share of big (and than least) are cut by a hash of the row, and their
    row of the other side is handed to every part. At most 16 keys for each shuffle partition can be hot, so the
    list of them that is broadcast does not grow with the data. Null keys meet nothing and are spread as well.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    counted = big if counted is None else counted
    n, tasks = counted.count() if rows is None else rows, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(least, n // (PARTS_OF_TASK * tasks))
    if n <= most:
        return big.join(one, keys, how)
    hot = F.broadcast(counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_parts")))
    spread = F.pmod(F.xxhash64(*big.columns), F.when(F.col(keys[0]).isNull(), F.lit(PARTS_OF_TASK * tasks)).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    left = big.join(hot, keys, "left").withColumn("_salt", spread).drop("_parts")
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
