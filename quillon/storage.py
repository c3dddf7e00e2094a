"""Scratch tables in the folder all executors share.

Iterative operators cut their lineage here: a result is written once as Parquet and read back, so that a
lost executor costs a re-read and not a recomputation, and so that later steps prune columns.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset an own one on one machine (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to; clear() deletes what is put there."""
    path = f"{shared_folder(spark)}/quillon/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def keep(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder, with options of the Parquet writer, and return what was written. Rows and columns stay as they are."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, label), df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def keep_counted(df: DataFrame, label: str, **counted: Column) -> tuple[DataFrame, dict[str, int]]:
    """keep, and n, the number of rows, with how many rows meet each condition: counted while they are written, not by another job."""
    seen = Observation()
    kept = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counted.items()]), label)
    return kept, {k: v or 0 for k, v in seen.get.items()}


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than there are cores, as with one small file; else df.

    For steps that cost much more than the rows weigh. A scan of a large table has partitions enough and is left alone;
    so is a plan with a shuffle, whose partitions are known only when it has run.
    """
    query, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if query.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    return df.repartition(cores) if query.toRdd().getNumPartitions() < cores else df


def clear(spark: SparkSession) -> int:
    """Delete the scratch tables of this session; results that still read them must have been used up."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = [p for s, p in _written if s is spark]
    for path in own:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _written[:] = [(s, p) for s, p in _written if s is not spark]
    return len(own)


@atexit.register
def _at_end() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            clear(spark)
        except Exception:  # the JVM may be gone already
            pass
