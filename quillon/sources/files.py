"""Files of a stand-off-annotated corpus: TSV annotations, one text file per document, and the sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.tags import seq2seq_input, seq2seq_target, tagged_words
from quillon.functions.text import unescape_unicode
from quillon.operators.annotate import attach_entities
from quillon.schemas import ANNOTATION, ANNOTATION_LINKED, DOCUMENT, RESULTS


def scan_annotations(spark: SparkSession, folder: str, linked: bool = False, pattern: str = "*.tsv", breaks: bool = True) -> DataFrame:
    """Rows of every file in folder that pattern names (header, tabs, quotes doubled inside quotes, line breaks allowed inside): the columns of the
    schema and ord, which grows in file order, then row order. An empty span is '', not null. A folder without such files is
    an error; offsets that are no numbers are one when they are read. breaks=False promises that no line breaks stand inside quotes: then
    a large file is read by many tasks."""
    reader = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=breaks, pathGlobFilter=pattern, mode="FAILFAST", enforceSchema=True)
    rows = reader.schema(ANNOTATION_LINKED if linked else ANNOTATION).csv(folder)
    if not rows.inputFiles():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    # The id grows with the row inside a split of a file, and splits stand by where they begin.
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_row"))
    return placed.withColumn("span", F.coalesce("span", F.lit(""))).withColumn("ord", F.struct("_file", "_from", "_row")).drop("_file", "_from", "_row")


def _empty_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of the empty files in folder, which Spark's scans leave out; the driver lists folders for any scan."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [f.getPath().getName() for f in found if f.isFile() and f.getLen() == 0 and f.getPath().getName().endswith(suffix)]


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of every *.txt directly in folder; the id is the name without its last suffix, line ends become \\n.
    An empty file is a document with an empty text."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    found = files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    empty = _empty_files(spark, folder, ".txt")
    return found.unionByName(spark.createDataFrame([(n[: -len(".txt")], "") for n in empty], "doc_id string, text string")) if empty else found


def mock_source(spark: SparkSession) -> DataFrame:
    """Two records of our own with entities whose offsets hold."""
    rows = []
    for doc_id, text, terms in (
        ("mock-1", "Paciente con neumonía adquirida y asma leve.", (("neumonía adquirida", "neumonía"), ("asma leve", None))),
        ("mock-2", "Ingresa por diabetes mellitus.", (("diabetes mellitus", "diabetes mellitus"),)),
    ):
        rows.append((doc_id, text, [(text.index(t), text.index(t) + len(t), t, "ENFERMEDAD", n) for t, n in terms]))
    return spark.createDataFrame(rows, DOCUMENT)


def load_corpus(spark: SparkSession, text_folder: str | None = None, annotation_folder: str | None = None) -> DataFrame:
    """Documents with their entities from files, spans unescaped; the mock records where no folder is given."""
    if text_folder is None:
        return mock_source(spark)
    notes = scan_annotations(spark, annotation_folder or text_folder).withColumn("span", unescape_unicode("span"))
    return attach_entities(scan_documents(spark, text_folder), notes)


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet by split, so that a reader of one split opens only its folder."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


#: The two training formats, each a folder of Parquet files by split.
FORMATS = {"bio": ("doc_id", "tokens", "ner_tags", "split"), "seq2seq": ("doc_id", "input_text", "target_text", "split")}


def write_formats(chunks: DataFrame, path: str) -> None:
    """Chunks (doc_id, split, text, entities) in both training formats, under path/bio and path/seq2seq. The chunks are worked out
    once for each. Null splits have a folder of their own."""
    bio = chunks.select("doc_id", "split", tagged_words("text", "entities").alias("x")).select("doc_id", F.col("x.tokens").alias("tokens"), F.col("x.tags").alias("ner_tags"), "split")
    pairs = chunks.select("doc_id", seq2seq_input(F.col("text")).alias("input_text"), seq2seq_target(F.col("entities")).alias("target_text"), "split")
    for name, rows in (("bio", bio), ("seq2seq", pairs)):
        write_splits(rows.select(*FORMATS[name]), f"{path}/{name}")


def read_format(spark: SparkSession, path: str, name: str, split: str | None = None) -> DataFrame:
    """A format written by write_formats; of one split only its folder is opened."""
    if name not in FORMATS:
        raise ValueError(f"no format {name!r}; there are {', '.join(FORMATS)}")
    return read_split(spark, f"{path}/{name}", split)


def all_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """The named splits one after the other, as one table with split."""
    return reduce(DataFrame.unionByName, [read_split(spark, path, s) for s in splits])


def write_artifact(spark: SparkSession, values: dict, path: str) -> None:
    """One settings object as a JSON file, such as an adapter's or a tokenizer's."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per settings file under path, whole files being one object each; what schema names and a file lacks is null."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def track_run(metrics: DataFrame, path: str, run: str) -> None:
    """Appends metric rows (model_key, phase, metric, value) of a run to the table of runs."""
    metrics.select(F.lit(run).alias("run"), "model_key", "phase", "metric", "value").write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, model_key string, phase string, metric string, value double").parquet(path)


def write_annotations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def to_json_records(df: DataFrame) -> DataFrame:
    """(json): each row as one JSON object; null fields are left out, other characters than ASCII stay."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).json(path)
