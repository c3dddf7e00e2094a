"""The preparation and evaluation pipeline as queries over the project's tables, each with its SQL.

Truth are the entities of the records, read as tags; the prediction that evaluation needs is derived from the true tags by a
fixed rule: a word whose (row_id + place) is a multiple of 7 becomes O, else of 11 becomes B, else stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.tags import (
    argmax, bio_decode, decoded_marks, encode_labels, first_pieces, kept_labels, parse_generated, placed, seq2seq_input, seq2seq_target, tagged_words,
)
from quillon.functions.text import strip_chunk_suffix, unescape_unicode, word_count, word_spans
from quillon.operators import annotate, evaluate, profile, splits
from quillon.operators.chunking import chunk_records
from quillon.plans.pipeline_sql import SQL  # noqa: F401
from quillon.storage import spread

WINDOW, OVERLAP = 246, 50


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "distemist_raw_splits")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_records(spark, folder).select("row_id", "doc_id", "split", "text", "entities"))


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, doc_id, split, tokens, tags, predicted) of records with a text."""
    rows = _texts(spark, folder).where("text is not null").select("row_id", "doc_id", "split", tagged_words("text", "entities").alias("x"))
    rows = rows.select("row_id", "doc_id", "split", F.col("x.tokens").alias("tokens"), F.col("x.tags").alias("tags"))
    return rows.withColumn("predicted", _perturbed(F.col("tags"), F.col("row_id")))


def _perturbed(tags: Column, row_id: Column) -> Column:
    return F.transform(tags, lambda t, i: F.when((row_id + i) % 7 == 0, "O").when((row_id + i) % 11 == 0, "B-ENFERMEDAD").otherwise(t))


def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("row_id", F.explode_outer(word_spans("text")).alias("w")).where("w is not null").select("row_id", "w.i", "w.word", "w.start", "w.end")


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).where("text is not null").select("row_id", word_count("text").alias("n_words"))


def length_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.length_profile(_texts(spark, folder).select("split", word_count("text").alias("n_words")), ["split"], "n_words")


def chunk_length_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile after chunking, measured on the chunks."""
    return profile.length_profile(chunk_records(_texts(spark, folder), WINDOW, OVERLAP).select("split", "n_words"), ["split"], "n_words")


def _ratios(spark: SparkSession, folder: str) -> DataFrame:
    return profile.token_word_ratio(_texts(spark, folder).select("row_id", "text"), profile.pieces_of_four("text"), word_count("text"))


def token_word_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return _ratios(spark, folder).select("row_id", "ratio")


def safe_window(spark: SparkSession, folder: str) -> DataFrame:
    return profile.safe_windows(_ratios(spark, folder).select("ratio"), [0.9, 1.0])


def docs_without_entities(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.without_entities(_records(spark, folder))


def offset_faults(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.offset_faults(_records(spark, folder))


def doc_entities(spark: SparkSession, folder: str) -> DataFrame:
    docs = _records(spark, folder).select("doc_id").where("doc_id is not null").distinct()
    notes = _read(spark, folder, "subtrack1_entities").withColumn("ord", F.col("row_id"))
    out = annotate.attach_entities(docs, notes)
    return out.select("doc_id", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("spans"))


def sample_k(spark: SparkSession, folder: str) -> DataFrame:
    return splits.sample_k(_records(spark, folder).select("row_id"), "row_id", 30)


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.make_split(_records(spark, folder).select("doc_id").where("doc_id is not null").distinct())


def make_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).select("doc_id", "split")


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_sizes(_records(spark, folder))


def split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return splits.shared_keys(_records(spark, folder).select(strip_chunk_suffix("doc_id").alias("orig_doc_id"), "split").where("orig_doc_id is not null"), "orig_doc_id")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_records(_texts(spark, folder), WINDOW, OVERLAP)


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("row_id", F.coalesce("chunk_no", F.lit(-1)).alias("chunk_no"), "doc_id", "n_words", F.md5("text").alias("text_md5"), F.size("entities").alias("n_entities"))


def chunk_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder).select("row_id", F.coalesce("chunk_no", F.lit(-1)).alias("chunk_no"), "start", F.explode("entities").alias("e"))
    return rows.select("row_id", "chunk_no", (F.col("e.start") + F.col("start")).alias("doc_start"), (F.col("e.end") + F.col("start")).alias("doc_end"), F.col("e.text").alias("text"))


def rebase_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder).select("row_id", F.coalesce("chunk_no", F.lit(-1)).alias("chunk_no"), "text", F.explode("entities").alias("e"))
    return rows.select("row_id", "chunk_no", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("text").substr(F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("found"))


def strip_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("row_id", strip_chunk_suffix("doc_id").alias("orig_doc_id"))


def bio_tag_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("row_id", F.posexplode_outer("tags").alias("i", "tag")).where("tag <> 'O'")


def bio_format(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("row_id", F.md5(F.array_join("tokens", "\t")).alias("tokens_md5"), F.array_join("tags", "\t").alias("tags"))


def bio_decode_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("row_id", F.explode_outer(bio_decode(F.col("tokens"), F.col("predicted"))).alias("entity")).where("entity is not null")


def seq2seq_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("row_id", seq2seq_target(F.col("entities")).alias("target_text"))


def seq2seq_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder)
    return rows.select("row_id", F.coalesce("chunk_no", F.lit(-1)).alias("chunk_no"), F.md5(seq2seq_input(F.col("text"))).alias("input_md5"), seq2seq_target(F.col("entities")).alias("target_text"))


def parse_generated_rows(spark: SparkSession, folder: str) -> DataFrame:
    targets = _records(spark, folder).select("row_id", F.upper(seq2seq_target(F.col("entities"))).alias("g"))
    return targets.select("row_id", F.explode_outer(parse_generated(F.col("g"))).alias("entity")).where("entity is not null")


def unicode_unescape(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "subtrack1_entities").select("row_id", unescape_unicode("span").alias("span"))


def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("row_id", F.array_join(encode_labels(F.col("tags")), ",").alias("labels"))


def argmax_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("best"))


def mask_ignored(spark: SparkSession, folder: str) -> DataFrame:
    labels = F.transform("tags", lambda t, i: F.when((F.col("row_id") + i) % 3 == 0, F.lit(-100)).otherwise(encode_labels(F.array(t))[0]))
    return _tagged(spark, folder).select("row_id", F.array_join(kept_labels(F.col("predicted"), labels), ",").alias("kept"))


def word_level_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of a stand-in tokenizer (words in fours of characters), each predicting its word's tag, later pieces O."""
    pieces = F.flatten(F.transform(F.arrays_zip(F.col("tokens").alias("w"), F.col("predicted").alias("t")), lambda x, i: F.transform(
        F.sequence(F.lit(0), F.ceil(F.length(x["w"]) / 4).cast("int") - 1), lambda k: F.struct(i.alias("word"), F.when(k == 0, x["t"]).otherwise("O").alias("value")))))
    framed = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("word"), F.lit("O").alias("value"))), pieces)
    return _tagged(spark, folder).select("row_id", F.array_join(first_pieces(framed), ",").alias("tags"))


def token_confusion(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.token_confusion(_tagged(spark, folder), "tags", "predicted", ["row_id", "split"])
    return rows.groupBy("split", "outcome").agg(F.count("*").alias("n"))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.mark_outcomes(_tagged(spark, folder), decoded_marks("tokens", "tags", "predicted"))


def doc_entity_sets(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.entity_pairs(_records(spark, folder), F.transform(placed(F.col("entities")), lambda e: e["text"]))


def micro_prf1(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.micro_scores(_outcomes(spark, folder))


def per_doc_prf1(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.doc_scores(_outcomes(spark, folder))


def _outcome(*names: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _outcomes(spark, folder).where(F.col("outcome").isin(*names)).select("doc_id", "entity")

    return query


def annotator_prf1(spark: SparkSession, folder: str) -> DataFrame:
    """The annotation table held against the records' own entities, for the records it annotates."""
    notes = _read(spark, folder, "subtrack1_entities").select(F.col("filename").alias("doc_id"), F.array(unescape_unicode("span")).alias("names"))
    truth = evaluate.entity_pairs(_records(spark, folder), F.transform(placed(F.col("entities")), lambda e: e["text"]))
    pairs = evaluate.entity_pairs(notes, F.col("names")).join(truth.select("doc_id").distinct(), "doc_id", "left_semi")
    return evaluate.micro_prf1(truth, pairs)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """A training log made of the events table: one model per event type, an epoch per user group, gaps where values are odd."""
    e = _read(spark, folder, "events")
    return e.select(F.col("event_type").alias("model_key"), F.col("event_id").cast("int").alias("step"), (F.col("user_id") % 10 + 1).cast("double").alias("epoch"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("loss"),
                    F.when(F.col("event_id") % 3 == 0, F.col("value") / 2).alias("eval_loss"), F.when(F.col("event_id") % 5 == 0, F.floor(F.col("value")) / 1000).alias("eval_f1"))


def best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.best_epoch(_log(spark, folder))


def training_curves(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.training_curves(_log(spark, folder))


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per split of a word-wise stand-in: the perturbed tags as finetuned, tags shifted by one word as baseline."""
    rows = _tagged(spark, folder).where("split is not null").withColumn("shifted", F.slice(F.concat(F.array(F.lit("O")), "tags"), F.lit(1), F.size("tags")))
    return evaluate.word_scores(rows, "tags", {"baseline": "shifted", "finetuned": "predicted"}, "split").withColumnRenamed("split", "model_key")


def metric_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.metric_pivot(_metrics(spark, folder), ["model_key"])


QUERIES = {
    "word_tokens": word_tokens, "word_count": word_counts, "length_profile": length_profile, "chunk_length_profile": chunk_length_profile,
    "token_word_ratio": token_word_ratios, "safe_window": safe_window, "docs_without_entities": docs_without_entities, "offset_faults": offset_faults,
    "doc_entities": doc_entities, "sample_k": sample_k, "make_split": make_split, "split_sizes": split_sizes, "split_leaks": split_leaks,
    "chunk_documents": chunk_documents, "chunk_entities": chunk_entities, "rebase_entities": rebase_entities, "strip_chunk_suffix": strip_suffix,
    "bio_tags": bio_tag_rows, "bio_format": bio_format, "bio_decode": bio_decode_rows, "seq2seq_target": seq2seq_targets, "seq2seq_format": seq2seq_format,
    "parse_generated": parse_generated_rows, "unicode_unescape": unicode_unescape, "label_encode": label_encode, "argmax_labels": argmax_labels,
    "mask_ignored": mask_ignored, "word_level_collapse": word_level_collapse, "token_confusion": token_confusion, "doc_entity_sets": doc_entity_sets,
    "micro_prf1": micro_prf1, "per_doc_prf1": per_doc_prf1, "entity_intersect": _outcome("TP"), "entity_except": _outcome("FP"), "entity_missed": _outcome("FN"),
    "entity_union": _outcome("TP", "FP", "FN"), "annotator_prf1": annotator_prf1, "best_epoch": best_epoch, "training_curves": training_curves, "metric_pivot": metric_pivot,
}
