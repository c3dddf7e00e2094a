"""Overlapping word windows over records, with the entities of each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.batches import cuts_of
from quillon.functions.tags import placed


def window_cuts(text: Column | str, window: int, overlap: int) -> Column:
    """array<struct<chunk_no:int,first_word:int,n_words:int,start:int,end:int>>. A text of at most window words is one
    chunk with its outer blanks and no number; else chunk k has the words from k x (window - overlap)."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and below window, else no window moves on")
    return F.arrow_udf(cuts_of(window, overlap), "array<struct<chunk_no:int,first_word:int,n_words:int,start:int,end:int>>")(text)


def own_entities(entities: Column, start: Column, end: Column) -> Column:
    """Entities that lie wholly in [start, end), with offsets from start."""
    inside = F.filter(placed(entities), lambda e: (e["start"] >= start) & (e["end"] <= end))
    return F.transform(inside, lambda e: e.withField("start", e["start"] - start).withField("end", e["end"] - start))


def chunk_records(df: DataFrame, window: int = 246, overlap: int = 50, doc_id: str = "doc_id", text: str = "text", entities: str = "entities") -> DataFrame:
    """Records in chunks: the columns of df but doc_id, text and entities, and then orig_doc_id, chunk_no (null where the record was
    not cut), doc_id (with the suffix _chunk<k> where it was), text, n_words, start, entities.

    An entity that crosses a chunk's edge is in neither part; one that lies in the overlap is in both. Null
    texts have no chunks, blank ones a single one; null entities are none. One pass, no shuffle. (Every text has a
    chunk, so the outer explode adds none; the plain one would evaluate the cuts a second time, as a filter.)
    """
    own = {doc_id, text, entities, "orig_doc_id", "chunk_no", "n_words", "start"}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in own]
    cut = df.where(F.col(text).isNotNull()).select(*rest, F.col(doc_id).alias("orig_doc_id"), F.col(text).alias("_text"), F.col(entities).alias("_entities"), F.explode_outer(window_cuts(text, window, overlap)).alias("_c"))
    return cut.select(
        *rest, "orig_doc_id", F.col("_c.chunk_no").alias("chunk_no"),
        F.when(F.col("_c.chunk_no").isNull(), F.col("orig_doc_id")).otherwise(F.concat("orig_doc_id", F.lit("_chunk"), F.col("_c.chunk_no"))).alias("doc_id"),
        F.col("_text").substr(F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start")).alias("text"), F.col("_c.n_words").alias("n_words"), F.col("_c.start").alias("start"),
        own_entities(F.col("_entities"), F.col("_c.start"), F.col("_c.end")).alias("entities"),
    )
