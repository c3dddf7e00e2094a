"""Length profiles and the window size that fits a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.batches import fours_of
from quillon.storage import keep


def pieces_of_four(text: Column | str) -> Column:
    """Pieces of a deterministic stand-in tokenizer: every word in fours of characters. Null for a null text."""
    return F.arrow_udf(fours_of, "int")(text)


def length_profile(df: DataFrame, by: list[str], length: str, exact: bool = True) -> DataFrame:
    """Per group: rows, longest, mean, median, 70th and 99th percentile of a length (nulls left out).

    exact interpolates and keeps a count for every distinct length of a group (lengths are few however many rows);
    else the sketch of percentile_approx is used.
    """
    at = F.percentile(length, F.array(F.lit(0.5), F.lit(0.7), F.lit(0.99))) if exact else F.percentile_approx(length, [0.5, 0.7, 0.99], 10_000).cast("array<double>")
    out = df.where(F.col(length).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.avg(length).alias("mean"), at.alias("p"))
    return out.select(*by, "n", "longest", F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p70", "p99"))])


def token_word_ratio(df: DataFrame, tokens: Column, n_words: Column) -> DataFrame:
    """df with ratio = tokens / words, without rows that have no word."""
    return df.withColumn("_t", tokens).withColumn("_n", n_words).where("_n > 0").withColumn("ratio", F.col("_t") / F.col("_n")).drop("_t", "_n")


def exact_percentiles(df: DataFrame, col: str, at: list[float], tasks: int | None = None) -> list[float | None]:
    """Exact interpolated percentiles of a numeric column (nulls left out; nulls where nothing is left).

    Values are counted, range-partitioned and summed by partition; only the partitions that hold the wanted ranks are then
    read in order. No task has more than a share of the distinct values, and a few numbers a partition come to the driver.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = keep(values.repartitionByRange(tasks, "v").withColumn("part", F.spark_partition_id()), "values")
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(at)
    places = [p * (total - 1) for p in at]
    wanted = sorted({int(x) for p in places for x in (p, min(int(p) + 1, total - 1))})
    starts, before = [], 0
    for part, n in sizes:
        starts += [(part, before, k) for k in wanted if before <= k < before + n]
        before += n
    running = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    some = ranged.where(F.col("part").isin(sorted({p for p, _, _ in starts}))).withColumn("to", running)
    hit = reduce(lambda a, b: a | b, [(F.col("part") == p) & (F.col("to") > k - b) & (F.col("to") - F.col("n") <= k - b) for p, b, k in starts])
    found = sorted((r["part"], r["to"], r["n"], r["v"]) for r in some.where(hit).collect())  # two rows a percentile at most
    value = {k: next(v for part, to, n, v in found if part == p and to - n <= k - b < to) for p, b, k in starts}
    return [value[int(x)] + (x - int(x)) * (value[min(int(x) + 1, total - 1)] - value[int(x)]) for x in places]


def safe_windows(ratios: DataFrame, percentiles: list[float], target: int = 480, margin: float = 0.9) -> DataFrame:
    """(percentile, ratio, window_words): for every percentile of ratio, that percentile and the words of a window that fits target
    tokens, floor(target / it x margin). No row without ratios."""
    if not all(0 <= p <= 1 for p in percentiles):
        raise ValueError("percentiles must be between 0 and 1")
    found = exact_percentiles(ratios.where("ratio > 0"), "ratio", percentiles)
    rows = [(p, round(r, 6), int(float(target) / r * float(margin))) for p, r in zip(percentiles, found, strict=True) if r is not None]
    return ratios.sparkSession.createDataFrame(rows, "percentile double, ratio double, window_words int")


def safe_window(ratios: DataFrame, percentile: float = 0.9, target: int = 480, margin: float = 0.9) -> DataFrame:
    """safe_windows for one percentile: (ratio, window_words)."""
    return safe_windows(ratios, [percentile], target, margin).select("ratio", "window_words")


def fixed(col: Column | str, decimals: int) -> Column:
    """A number with so many decimals, as text; null stays null."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))


def grouped(col: Column | str) -> Column:
    """A whole number with commas between thousands, as text; null stays null."""
    return F.format_number(col, 0)


def head(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The first k rows in the order of by (a top-k, no full sort); by should leave no ties."""
    return df.orderBy(*by).limit(k)
