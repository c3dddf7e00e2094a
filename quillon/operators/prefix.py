"""Prefix sums and ranks over any number of rows, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one window task should hold at most, on average.
ROWS_PER_SLICE = 200_000


def hash_key(*cols: Column | str, seed: str = "") -> Column:
    """A uniform 60-bit order key of the columns, equal in every run. Null columns count as a value of their own."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0000null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("\u0001", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def prefix_sums(df: DataFrame, group: list[str], key: str, tie: list[str], value: Column, n_rows: int, out: str = "running", slices: int | None = None) -> DataFrame:
    """Adds the inclusive running sum of value within each group in order of (key, tie).

    key must be a hash_key: as it is uniform, its leading bits cut every group into slices of equal expected
    size, so a group with a third of all rows is spread like any other. Sums of slices are small (slices x
    groups) and are accumulated first; then each slice is scanned on its own. Null values count as 0.
    An empty table gives an empty table.
    """
    if slices is None:
        slices = max(1, -(-n_rows // ROWS_PER_SLICE))
    width = -(-(1 << 60) // slices)
    df = df.withColumn("_slice", F.floor(F.col(key) / F.lit(width)).cast("int")).withColumn("_v", F.coalesce(value, F.lit(0)).cast("long"))
    totals = df.groupBy(*group, "_slice").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_{c}_at") for c in [*group, "_slice"]], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}_at")) for c in [*group, "_slice"]]
    joined = df.join(offsets, match).drop(*[f"_{c}_at" for c in [*group, "_slice"]])
    inside = Window.partitionBy(*group, "_slice").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum("_v").over(inside)).drop("_slice", "_v", "_before")
