"""Queries on references to records that do not exist (problem 5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.integrity import ForeignKey, all_direct_orphans, file_reference, orphan_cascade, orphan_report


def _graph(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[ForeignKey]]:
    tables = {
        "subtrack1_entities": spark.read.parquet(f"{folder}/subtrack1_entities.parquet").select("row_id", "filename", "annotated_at"),
        "distemist_raw_splits": spark.read.parquet(f"{folder}/distemist_raw_splits.parquet").select("row_id", "doc_id", "loaded_at"),
        "text_files": spark.read.parquet(f"{folder}/text_files.parquet").select(F.col("file_id").alias("row_id"), "filename", "received_at", "deleted_at"),
    }
    file = {"parent": "text_files", "parent_key": F.col("filename"), "since": F.col("received_at"), "until": F.col("deleted_at")}
    keys = [
        ForeignKey("subtrack1_entities", file_reference(F.col("filename")), at=F.col("annotated_at"), **file),
        ForeignKey("distemist_raw_splits", file_reference(F.col("doc_id")), at=F.col("loaded_at"), **file),
        ForeignKey("subtrack1_entities", file_reference(F.col("filename")), "distemist_raw_splits", file_reference(F.col("doc_id")), at=F.col("annotated_at"), strict=False),
    ]
    return tables, keys


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Level 0 of the cascade, which is where it starts."""
    return all_direct_orphans(*_graph(spark, folder)).select("child_table", "row_id")


def p5_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(orphan_cascade(*_graph(spark, folder)))


QUERIES = {"p5_found": p5_found, "p5_orphan_report": p5_orphan_report}

_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_REFS = rf"""
refs AS (
  SELECT child_table, row_id, t,
         regexp_replace(regexp_replace(regexp_replace(raw, '^{_BLANKS}+|{_BLANKS}+$', '', 'g'), '\.txt$', ''), '_chunk[0-9]+$', '') AS ref
  FROM (SELECT 'subtrack1_entities' AS child_table, row_id, filename AS raw, annotated_at AS t FROM subtrack1_entities
        UNION ALL SELECT 'distemist_raw_splits', row_id, doc_id, loaded_at FROM distemist_raw_splits)
  WHERE raw IS NOT NULL),
direct AS (
  SELECT r.child_table, r.row_id, r.t, r.ref,
         CASE WHEN count(f.file_id) FILTER (f.received_at IS NOT NULL) = 0 THEN 'missing' WHEN r.t IS NULL THEN 'undated'
              WHEN count(f.file_id) FILTER (f.received_at <= r.t) = 0 THEN 'not_yet' ELSE 'deleted' END AS kind
  FROM refs r LEFT JOIN text_files f ON f.filename = r.ref
  GROUP BY r.child_table, r.row_id, r.t, r.ref
  HAVING count(f.file_id) FILTER (f.received_at <= r.t AND (f.deleted_at IS NULL OR f.deleted_at > r.t)) = 0)"""

SQL = {
    "p5_found": f"WITH {_REFS} SELECT child_table, row_id FROM direct",
    "p5_orphan_report": f"""WITH {_REFS},
dead AS (
  SELECT r.ref FROM refs r LEFT JOIN direct d ON d.child_table = r.child_table AND d.row_id = r.row_id
  WHERE r.child_table = 'distemist_raw_splits' GROUP BY r.ref HAVING count(*) = count(d.row_id)),
everything AS (
  SELECT child_table, 'text_files' AS parent_table, t, kind, 'direct' AS origin FROM direct
  UNION ALL
  SELECT r.child_table, 'distemist_raw_splits', r.t, 'parent_orphaned', 'inherited' FROM refs r
  WHERE r.child_table = 'subtrack1_entities' AND r.ref IN (SELECT ref FROM dead)
    AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.child_table = r.child_table AND d.row_id = r.row_id))
SELECT child_table, parent_table, strftime(t, '%Y-%m') AS month, kind, origin, count(*) AS n_rows FROM everything GROUP BY ALL""",
}
