"""Queries on sources, sinks, subword tokenizers, predictions and views, and SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.sequences import REGISTRY, collate, decoded_text, encoded, framed_length, unmasked, vocabulary
from quillon.functions.tags import IGNORED, INSTRUCTION, align_labels, decode_labels, encode_labels, seq2seq_target
from quillon.functions.text import word_count
from quillon.functions.tokenizers import token_length, token_pieces, word_pieces
from quillon.operators import evaluate
from quillon.operators.chunking import chunk_records
from quillon.operators.predict import gazetteer, gazetteer_terms
from quillon.operators.profile import fixed, grouped, head, length_profile, pieces_of_four, safe_windows, token_word_ratio
from quillon.plans.pipeline import OVERLAP, WINDOW, _metrics, _read, _records, _tagged, _texts
from quillon.plans.pipeline_sql import SOLID, profile_sql
from quillon.plans.pipeline_sql import SQL as PIPELINE_SQL
from quillon.sources import files
from quillon.storage import keep, scratch_path


def scan_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """The annotation table, written as TSV files and scanned."""
    path = scratch_path(spark, "annotations")
    columns = ["filename", "mark", "label", "off0", "off1", "span", "codes", "semantic_relation"]
    files.write_annotations(_read(spark, folder, "subtrack1_entities").select(*columns), path)
    return files.scan_annotations(spark, path, linked=True, pattern="*.csv").select(*[F.col(c).cast("double").alias(c) if c.startswith("off") else c for c in columns])


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation items (a table of fixed size), written as one text file each and scanned."""
    path = scratch_path(spark, "texts")
    jvm = spark.sparkContext._jvm
    for r in _read(spark, folder, "eval_items").select("item_id", "text").toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/item {r['item_id']}.es.txt")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(r["text"].replace("\n", "\r\n").encode()))
        out.close()
    return files.scan_documents(spark, path)


def sink_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    files.write_splits(_records(spark, folder), path)
    rows = files.read_split(spark, path, "dev")
    return rows.select("row_id", "doc_id", F.md5("text").alias("text_md5"), F.size("entities").cast("double").alias("n_entities"), "split")


def to_json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records as JSON, parsed back: what was kept of each."""
    rows = files.to_json_records(_records(spark, folder).select("row_id", "doc_id", "text", "entities"))
    back = F.from_json("json", "row_id bigint, doc_id string, text string, entities array<struct<start:int,end:int,text:string>>")
    return rows.select(back.alias("r")).select("r.row_id", "r.doc_id", F.md5("r.text").alias("text_md5"), F.when(F.col("r.entities").isNotNull(), F.size("r.entities")).cast("double").alias("n_entities"))


def results_summary(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "results")
    rows = evaluate.results_summary(_metrics(spark, folder)).withColumn("checkpoint", F.lit("stand-in"))
    files.write_results(rows.select("model_key", "checkpoint", "baseline", "finetuned"), path)
    back = files.read_results(spark, path)
    return back.select("model_key", *[F.col(f"{p}.{m}").alias(f"{p}_{m}") for p in ("baseline", "finetuned") for m in ("precision", "recall", "f1")])


def render_confusion_html(spark: SparkSession, folder: str) -> DataFrame:
    html = evaluate.confusion_html(F.col("tokens"), F.col("tags"), F.col("predicted"), "predicted")
    return _tagged(spark, folder).select("row_id", html.alias("html"))


def align_subword_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of real subword pieces, framed by two special pieces."""
    rows = _tagged(spark, folder).withColumn("pieces", word_pieces("tokens", vocabulary("byte").path()))
    ids = F.concat(F.array(F.lit(None).cast("int")), F.transform("pieces", lambda p: p["word"]), F.array(F.lit(None).cast("int")))
    return rows.select("row_id", F.size("pieces").alias("n_pieces"), F.array_join(align_labels(ids, F.col("tags")), ",").alias("labels"))


def subword_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Safe windows by tokenizer and percentile, from tokens a word of a public vocabulary."""
    parts = []
    for key in REGISTRY:
        ratios = keep(token_word_ratio(_texts(spark, folder).select("text"), token_length("text", vocabulary(key).path()), word_count("text")).select("ratio"), "ratios")
        parts.append(safe_windows(ratios, [0.9, 1.0]).select(F.lit(key).alias("tokenizer"), "percentile", "ratio", "window_words"))
    return reduce(DataFrame.unionByName, parts)


def token_length_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths in pieces of the stand-in tokenizer, the two special pieces counted."""
    return length_profile(_texts(spark, folder).select("split", (pieces_of_four("text") + 2).alias("n_pieces")), ["split"], "n_pieces")


def subword_length_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every public vocabulary, in one pass over the texts."""
    lengths = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.col(k).alias("n_pieces")) for k in REGISTRY])
    rows = _texts(spark, folder).where("text is not null").select("split", *[framed_length("text", k).alias(k) for k in REGISTRY])
    return length_profile(rows.select("split", F.explode(lengths).alias("x")).select("split", "x.*"), ["tokenizer", "split"], "n_pieces")


def _piece_words() -> Column:
    """Word of every piece of the stand-in tokenizer (words in fours of characters), framed by two special pieces."""
    pieces = F.flatten(F.transform("tokens", lambda w, i: F.array_repeat(i.cast("int"), F.ceil(F.length(w) / 4).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    return F.concat(none, pieces, none)


def piece_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _tagged(spark, folder).select("row_id", F.array_join(align_labels(_piece_words(), F.col("tags")), ",").alias("labels"))


def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Label sequences in batches of 8, filled up to the longest of each."""
    rows = _tagged(spark, folder).select("row_id", align_labels(_piece_words(), F.col("tags")).alias("labels"))
    out = collate(rows.withColumn("n", F.size("labels")), "row_id", 8, {"labels": IGNORED})
    return out.select("row_id", "batch", "n", F.size("labels").alias("n_padded"), F.size(F.filter("labels", lambda x: x != IGNORED)).alias("n_labels"))


def decode_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as framed ids, filled up with ignored places, and read back."""
    ids = F.concat(F.col("ids"), F.array_repeat(F.lit(IGNORED), 3))
    rows = _texts(spark, folder).where("text is not null").select("row_id", encoded("text", "byte").alias("ids")).select("row_id", unmasked(ids, "byte").alias("ids"))
    return rows.select("row_id", F.md5(decoded_text("ids", "byte")).alias("text_md5"))


def model_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of text-to-text records in ids of a public vocabulary, at most 128 of them."""
    ids = encoded(seq2seq_target(F.col("entities")), "piece", 128)
    return _records(spark, folder).select("row_id", ids.alias("ids")).select("row_id", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def format_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Both training formats written, and the dev split read back."""
    path = scratch_path(spark, "formats")
    files.write_formats(chunk_records(_texts(spark, folder), WINDOW, OVERLAP), path)
    bio = files.read_format(spark, path, "bio", "dev").select(F.lit("bio").alias("format"), "doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", "\t")).alias("content"))
    pairs = files.read_format(spark, path, "seq2seq", "dev").select(F.lit("seq2seq").alias("format"), "doc_id", F.length("input_text").alias("n"), F.md5(F.concat("input_text", "target_text")).alias("content"))
    return bio.unionByName(pairs)


def all_splits(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    files.write_splits(_records(spark, folder).select("row_id", "doc_id", "split"), path)
    return files.all_splits(spark, path).select("row_id", "doc_id", "split")


def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    return head(_records(spark, folder).select("row_id", "doc_id", "split"), 10, ["row_id"])


def formatted_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Characters and mean characters of a split's texts, written out."""
    sums = _records(spark, folder).where("text is not null").groupBy("split").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows"))
    return sums.select("split", grouped("n").alias("characters"), fixed(F.col("n") / F.col("rows"), 2).alias("mean_characters"))


def mock_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus where no folder is given."""
    rows = files.load_corpus(spark)
    return rows.select("doc_id", "text", F.explode("entities").alias("e")).select("doc_id", F.col("e.text").alias("text"), F.col("text").substr(F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("found"), F.col("e.normalized_term").alias("term"))


#: The settings objects that come with the trained models.
ADAPTER = {"r": 8, "lora_alpha": 16, "lora_dropout": 0.05}
LONGEST = {"encoder": 512}


def config_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Settings files written and read back: an adapter's and a tokenizer's, one row each."""
    path = scratch_path(spark, "settings")
    files.write_artifact(spark, ADAPTER, f"{path}/adapter")
    files.write_artifact(spark, {"model_max_length": LONGEST["encoder"]}, f"{path}/tokenizer")
    return files.read_artifacts(spark, path, "r int, lora_alpha int, lora_dropout double, model_max_length long")


def run_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows of two runs, appended to one table and read back."""
    path = scratch_path(spark, "runs")
    rows = keep(_metrics(spark, folder), "metrics")
    for phase in ("baseline", "finetuned"):
        files.track_run(rows.where(F.col("phase") == phase), path, f"{phase}-1")
    return files.read_runs(spark, path)


def label_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Tags as label ids and back."""
    return _tagged(spark, folder).select("row_id", F.array_join(decode_labels(encode_labels(F.col("tags"))), ",").alias("tags"))


def confusion_view(spark: SparkSession, folder: str) -> DataFrame:
    """Legend, truth and two predictions below each other."""
    shifted = F.slice(F.concat(F.array(F.lit("O")), "tags"), F.lit(1), F.size("tags"))
    html = evaluate.confusion_view(F.col("tokens"), F.col("tags"), {"truth": F.col("tags"), "baseline": shifted, "predicted": F.col("predicted")})
    return _tagged(spark, folder).select("row_id", html.alias("html"))


def compare_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the dictionary's terms in each vocabulary."""
    terms = _read(spark, folder, "disease_terms")
    parts = [terms.withColumn("p", token_pieces("term", vocabulary(k).path())).select("code", F.lit(k).alias("tokenizer"), F.col("p.n").alias("n"), F.array_join("p.pieces", " | ").alias("pieces")) for k in REGISTRY]
    return reduce(DataFrame.unionByName, parts)


def gazetteer_predict(spark: SparkSession, folder: str) -> DataFrame:
    terms = gazetteer_terms(_read(spark, folder, "disease_terms"))
    return _texts(spark, folder).select("row_id", gazetteer("text", terms).alias("codes")).select("row_id", F.explode("codes").alias("code"))


QUERIES = {
    "scan_annotations": scan_annotations, "scan_documents": scan_documents, "sink_roundtrip": sink_roundtrip, "to_json_records": to_json_records,
    "results_summary": results_summary, "render_confusion_html": render_confusion_html, "align_subword_labels": align_subword_labels,
    "subword_windows": subword_lengths, "compare_tokenizers": compare_tokenizers, "gazetteer_predict": gazetteer_predict,
    "token_length_profile": token_length_profile, "subword_length_profile": subword_length_profile, "piece_labels": piece_labels, "padded_batches": padded_batches,
    "decode_roundtrip": decode_roundtrip, "model_targets": model_targets, "format_sinks": format_sinks, "all_splits": all_splits, "head_rows": head_rows,
    "formatted_counts": formatted_counts, "mock_corpus": mock_corpus, "config_artifacts": config_artifacts, "run_tracking": run_tracking,
    "label_decode": label_decode, "confusion_view": confusion_view,
}

_ESCAPED = "replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_COLOUR = "CASE WHEN tag <> 'O' AND predicted <> 'O' THEN '#b6e3a5' WHEN predicted <> 'O' THEN '#f4a3a3' WHEN tag <> 'O' THEN '#f7c98d' ELSE 'transparent' END"
_WITH_TAGS = PIPELINE_SQL["bio_tags"].rpartition(" SELECT row_id, i, tag")[0]
_LABEL = "CASE tag WHEN 'O' THEN '0' WHEN 'B-ENFERMEDAD' THEN '1' ELSE '2' END"
_PIECES = "ceil(length(word) / 4)::INT"
_FOURS = f"coalesce(list_sum(list_transform(regexp_extract_all(text, {SOLID}), lambda w: ceil(length(w) / 4))), 0)::INT + 2"


def _view_row(title: str, predicted: str) -> str:
    colour = f"CASE WHEN tag <> 'O' AND {predicted} <> 'O' THEN '#b6e3a5' WHEN {predicted} <> 'O' THEN '#f4a3a3' WHEN tag <> 'O' THEN '#f7c98d' ELSE 'transparent' END"
    return f"""'<div><b>{title}</b> ' || coalesce(string_agg('<span style="background-color:' || {colour} || '">' || {_ESCAPED} || '</span>', ' ' ORDER BY t.i) FILTER (t.i IS NOT NULL), '') || '</div>'"""


_LEGEND = '<div><span style="background-color:#b6e3a5">Acierto</span> <span style="background-color:#f4a3a3">Falso positivo</span> <span style="background-color:#f7c98d">Se le escapó (FN)</span></div>'

SQL = {
    "scan_annotations": "SELECT filename, mark, label, off0::DOUBLE AS off0, off1::DOUBLE AS off1, coalesce(span, '') AS span, codes, semantic_relation FROM subtrack1_entities",
    "scan_documents": "SELECT 'item ' || item_id || '.es' AS doc_id, text FROM eval_items",
    "sink_roundtrip": "SELECT row_id, doc_id, md5(text) AS text_md5, len(entities)::DOUBLE AS n_entities, split FROM distemist_raw_splits WHERE split = 'dev'",
    "to_json_records": "SELECT row_id, doc_id, md5(text) AS text_md5, len(entities)::DOUBLE AS n_entities FROM distemist_raw_splits",
    "render_confusion_html": f"""{_WITH_TAGS}
SELECT d.row_id, '<div><b>predicted</b> ' || coalesce(string_agg('<span style="background-color:' || {_COLOUR} || '">' || {_ESCAPED} || '</span>', ' ' ORDER BY t.i) FILTER (t.i IS NOT NULL), '') || '</div>' AS html
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "results_summary": "SELECT model_key, " + ", ".join(f"max({p}) FILTER (metric = '{m}') AS {p}_{m}" for p in ("baseline", "finetuned") for m in ("precision", "recall", "f1")) + f" FROM ({PIPELINE_SQL['metric_pivot']}) GROUP BY model_key",
    "token_length_profile": profile_sql(f"SELECT split, CASE WHEN text IS NOT NULL THEN {_FOURS} END AS n_words FROM distemist_raw_splits"),
    "piece_labels": f"""{_WITH_TAGS}
SELECT d.row_id, '-100' || coalesce(string_agg(',' || {_LABEL} || repeat(CASE tag WHEN 'O' THEN ',0' ELSE ',2' END, {_PIECES} - 1), '' ORDER BY t.i) FILTER (t.i IS NOT NULL), '') || ',-100' AS labels
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "padded_batches": f"""
WITH s AS (SELECT row_id, {_FOURS} AS n FROM distemist_raw_splits WHERE text IS NOT NULL),
b AS (SELECT row_id, n, ((row_number() OVER (ORDER BY substring(md5('42' || chr(1) || row_id), 1, 15), row_id) - 1) // 8)::BIGINT AS batch FROM s)
SELECT row_id, batch, n, max(n) OVER (PARTITION BY batch) AS n_padded, (n - 2)::INT AS n_labels FROM b""",
    "decode_roundtrip": "SELECT row_id, md5(text) AS text_md5 FROM distemist_raw_splits WHERE text IS NOT NULL",
    "format_sinks": PIPELINE_SQL["chunk_documents"].rpartition("SELECT c.row_id")[0] + f""", firsts AS (SELECT row_id, chunk_no, term, min(ord) AS o FROM own WHERE term IS NOT NULL GROUP BY ALL),
joined AS (SELECT row_id, chunk_no, string_agg(term, ' [SEP] ' ORDER BY o) AS target_text FROM firsts GROUP BY ALL),
dev AS (SELECT c.*, substring(c.whole, c.a + 1, c.b - c.a) AS part FROM chunks c JOIN distemist_raw_splits d USING (row_id) WHERE d.split = 'dev')
SELECT 'bio' AS format, doc_id, n_words AS n, md5(array_to_string(regexp_extract_all(part, {SOLID}), chr(9))) AS content FROM dev
UNION ALL
SELECT 'seq2seq', doc_id, length('{INSTRUCTION}' || part)::INT, md5('{INSTRUCTION}' || part || coalesce(j.target_text, 'ninguna'))
FROM dev LEFT JOIN joined j ON j.row_id = dev.row_id AND j.chunk_no = dev.chunk_no""",
    "all_splits": "SELECT row_id, doc_id, split FROM distemist_raw_splits WHERE split IN ('train', 'dev', 'test')",
    "head_rows": "SELECT row_id, doc_id, split FROM distemist_raw_splits ORDER BY row_id LIMIT 10",
    "formatted_counts": "SELECT split, format('{:,}', sum(length(text))::BIGINT) AS characters, printf('%.2f', sum(length(text))::DOUBLE / count(*)) AS mean_characters FROM distemist_raw_splits WHERE text IS NOT NULL GROUP BY split",
    "mock_corpus": """SELECT * FROM (VALUES ('mock-1', 'neumonía adquirida', 'neumonía adquirida', 'neumonía'), ('mock-1', 'asma leve', 'asma leve', NULL),
('mock-2', 'diabetes mellitus', 'diabetes mellitus', 'diabetes mellitus')) t(doc_id, text, found, term)""",
    "config_artifacts": "SELECT * FROM (VALUES (8, 16, 0.05::DOUBLE, NULL::BIGINT), (NULL, NULL, NULL, 512)) t(r, lora_alpha, lora_dropout, model_max_length)",
    "run_tracking": f"""SELECT phase || '-1' AS run, model_key, phase, metric, value FROM (
  SELECT model_key, metric, 'baseline' AS phase, baseline AS value FROM ({PIPELINE_SQL['metric_pivot']}) UNION ALL SELECT model_key, metric, 'finetuned', finetuned FROM ({PIPELINE_SQL['metric_pivot']}))""",
    "label_decode": f"""{_WITH_TAGS} SELECT d.row_id, coalesce(string_agg(t.tag, ',' ORDER BY t.i), '') AS tags
FROM distemist_raw_splits d LEFT JOIN tags t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "confusion_view": f"""{_WITH_TAGS}, shown AS (SELECT *, coalesce(lag(tag) OVER (PARTITION BY row_id ORDER BY i), 'O') AS shifted FROM tags)
SELECT d.row_id, '{_LEGEND}' || {_view_row('truth', 'tag')} || {_view_row('baseline', 'shifted')} || {_view_row('predicted', 'predicted')} AS html
FROM distemist_raw_splits d LEFT JOIN shown t USING (row_id) WHERE d.text IS NOT NULL GROUP BY d.row_id""",
    "gazetteer_predict": "SELECT DISTINCT row_id, code FROM distemist_raw_splits JOIN disease_terms ON contains(text, term)",
}
