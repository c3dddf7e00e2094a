"""Records that land as files, chunked and tagged as they come.

Chunking, tagging and formatting look at one record at a time, so they run on a stream as they do on a table, in
append mode and without a watermark; only counts over records need state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.tags import seq2seq_input, seq2seq_target, tagged_words
from quillon.operators.chunking import chunk_records
from quillon.schemas import SPLIT_DOCUMENT


def landed_records(spark: SparkSession, folder: str, schema: str = SPLIT_DOCUMENT, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tagged_chunks(records: DataFrame, window: int = 246, overlap: int = 50) -> DataFrame:
    """(doc_id, tokens, ner_tags) of the records' chunks; a table or a stream."""
    both = chunk_records(records, window, overlap).select("doc_id", tagged_words("text", "entities").alias("x"))
    return both.select("doc_id", F.col("x.tokens").alias("tokens"), F.col("x.tags").alias("ner_tags"))


def generated_chunks(records: DataFrame, window: int = 246, overlap: int = 50) -> DataFrame:
    """(doc_id, input_text, target_text) of the records' chunks; a table or a stream."""
    return chunk_records(records, window, overlap).select("doc_id", seq2seq_input(F.col("text")).alias("input_text"), seq2seq_target(F.col("entities")).alias("target_text"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet files, each record exactly once, and stops when what has landed is done."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def split_counts(records: DataFrame) -> DataFrame:
    """Records and records without an entity per split; on a stream, in complete or update mode."""
    bare = F.count_if(F.coalesce(F.size("entities"), F.lit(0)) <= 0)
    return records.groupBy("split").agg(F.count("*").alias("n_docs"), bare.alias("n_without"))
