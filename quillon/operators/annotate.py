"""Records and their annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import salted_join


def attach_entities(docs: DataFrame, annotations: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs with entities: those of annotations (filename, ord, off0, off1, span, label) with that filename, by ord.

    A left join: a record without annotations keeps an empty array, annotations of unknown files are dropped, before
    they are grouped, so that a file that no record has costs no group however large it is; hot files are salted for that. ord
    must order the annotations of a file; equal ones stand by offsets and span. A null doc_id has none.
    """
    known = docs.select(F.col(doc_id).alias("filename")).where("filename is not null").distinct()
    rows = salted_join(annotations.select("filename", "ord", "off0", "off1", "span", "label"), known, "filename", "left_semi")
    entity = F.struct(F.col("off0").alias("start"), F.col("off1").alias("end"), F.coalesce("span", F.lit("")).alias("text"), "label", F.lit(None).cast("string").alias("normalized_term"))
    lists = rows.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("ord", "off0", "off1", F.coalesce("span", F.lit("")).alias("span"), entity.alias("e")))).alias("l"))
    lists = lists.select(F.col("filename").alias("_file"), F.transform("l", lambda x: x["e"]).alias("_entities"))
    kept = [c for c in docs.columns if c != "entities"]
    empty = F.array().cast("array<struct<start:int,end:int,text:string,label:string,normalized_term:string>>")
    return docs.select(*kept).join(lists, F.col(doc_id) == F.col("_file"), "left").select(*kept, F.coalesce("_entities", empty).alias("entities"))


def without_entities(docs: DataFrame, by: str = "split") -> DataFrame:
    """Per group: records, those without an entity (null counts as none), and their share in percent (0 of nothing)."""
    n, bare = F.count("*"), F.count_if(F.coalesce(F.size(F.filter("entities", lambda e: e.isNotNull())), F.lit(0)) <= 0)
    return docs.groupBy(by).agg(n.alias("n_docs"), bare.alias("n_without")).withColumn("pct_without", F.when(F.col("n_docs") == 0, 0.0).otherwise(F.col("n_without") * 100.0 / F.col("n_docs")))


def offset_faults(docs: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, ord, start, end, text, found) of entities whose offsets do not hold their text."""
    rows = docs.where("text is not null").select(key, F.col("text").alias("_text"), F.posexplode("entities").alias("ord", "e"))
    found = F.when((F.col("e.start") >= 0) & (F.col("e.end") >= F.col("e.start")), F.col("_text").substr(F.col("e.start") + 1, F.col("e.end") - F.col("e.start")))
    return rows.select(key, "ord", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.text").alias("text"), found.alias("found")).where("not (found <=> text)")
