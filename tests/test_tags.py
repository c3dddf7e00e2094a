import random
import re

from pyspark.sql import functions as F

from quillon.functions import tags as T
from quillon.functions.text import word_spans
from quillon.functions.sequences import vocabulary
from quillon.functions.tokenizers import word_pieces
from quillon.plans.formats import align_subword_labels

ENTITIES = "array<struct<start:int,end:int,text:string,label:string,normalized_term:string>>"


def model_tags(text, entities):
    """By word: the last entity over it, and whether it is that entity's first word."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    over = {k: [i for i, (a, b) in enumerate(spans) if b > e[0] and a < e[1]] for k, e in enumerate(entities) if None not in e[:2]}
    last = [max((k for k, words in over.items() if i in words), default=None) for i in range(len(spans))]
    return ["O" if k is None else f"{'B' if over[k][0] == i else 'I'}-ENFERMEDAD" for i, k in enumerate(last)]


def model_names(tokens, tags):
    """The runs that the pattern BI* matches in the tags' first letters."""
    marks = "".join(t[0] if t[0] in "BI" else "O" for _, t in zip(tokens, tags, strict=False))
    names = [" ".join(tokens[slice(*m.span())]).strip().lower() for m in re.finditer("BI*", marks)]
    return sorted(set(names) - {""}, key=names.index)


def test_tags_match_the_model(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(["a", "bb", "ccc", "ñ"]) for _ in range(rng.randrange(0, 15)))
        entities = [(a, a + rng.randrange(0, 6), "x", "L", None) for a in (rng.randrange(-2, len(text) + 3) for _ in range(rng.randrange(0, 6)))]
        if k % 9 == 0:
            entities.append((None, 3, None, None, None))
        rows.append((k, text, entities))
    df = spark.createDataFrame(rows, f"k int, text string, e {ENTITIES}")
    got = {r.k: r.t for r in df.select("k", T.bio_tags(word_spans("text"), F.col("e")).alias("t")).collect()}
    assert got == {k: model_tags(t, e) for k, t, e in rows}
    both = {r.k: (r.x.tokens, r.x.tags) for r in df.select("k", T.tagged_words("text", "e").alias("x")).collect()}
    assert both == {k: (t.split(), model_tags(t, e)) for k, t, e in rows}


def test_tags_of_nulls(spark):
    df = spark.createDataFrame([(None, [(0, 1, "a", "b", None)]), ("a b", None), ("", [])], f"text string, e {ENTITIES}")
    assert [r.t for r in df.select(T.bio_tags(word_spans("text"), F.col("e")).alias("t")).collect()] == [None, ["O", "O"], []]
    assert [(r.x.tokens, r.x.tags) for r in df.select(T.tagged_words("text", "e").alias("x")).collect()] == [(None, None), (["a", "b"], ["O", "O"]), ([], [])]


def test_decode_matches_the_model(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        n = rng.randrange(0, 12)
        rows.append((k, [rng.choice(["x", "Y", "z"]) for _ in range(n)], [rng.choice(["O", "B-E", "I-E", "X"]) for _ in range(n + rng.choice([-1, 0, 0, 1]) if n else 0)]))
    df = spark.createDataFrame(rows, "k int, w array<string>, t array<string>")
    got = {r.k: r.e for r in df.select("k", T.bio_decode(F.col("w"), F.col("t")).alias("e")).collect()}
    assert got == {k: model_names(w, t) for k, w, t in rows}


def test_decode_undoes_tags(spark):
    df = spark.createDataFrame([("tiene asma leve y gripe", [(6, 15, "asma leve", "E", None), (18, 23, "gripe", "E", None)])], f"text string, e {ENTITIES}")
    out = df.withColumn("s", word_spans("text")).select(T.bio_decode(F.transform("s", lambda w: w["word"]), T.bio_tags(F.col("s"), F.col("e"))).alias("n")).first().n
    assert out == ["asma leve", "gripe"]


def test_seq2seq(spark):
    rows = [([(0, 1, "a", "L", "N"), (0, 1, "b", "L", None), (0, 1, "N", "L", None), (0, 1, None, None, None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"e {ENTITIES}")
    assert [r.t for r in df.select(T.seq2seq_target(F.col("e")).alias("t")).collect()] == ["N [SEP] b", "ninguna", "ninguna"]


def test_parse_generated(spark):
    cases = {"A [SEP]  b [SEP] a": ["a", "b"], " NINGUNA \n": [], "x [SEP]  [SEP] ": ["x"], "": [], None: None, "ninguna [SEP] y": ["ninguna", "y"]}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, t string")
    assert [r.p for r in df.orderBy("k").select(T.parse_generated(F.col("t")).alias("p")).collect()] == list(cases.values())


def test_label_kernels(spark):
    df = spark.createDataFrame([(["O", "B-ENFERMEDAD", "I-ENFERMEDAD", "?"], [1.0, 3.0, 3.0], [1, -100, 2])], "t array<string>, s array<double>, l array<int>")
    r = df.select(T.encode_labels(F.col("t")).alias("a"), T.argmax(F.col("s")).alias("b"), T.kept_labels(F.col("t"), F.col("l")).alias("c"), T.decode_labels(F.array(F.lit(2), F.lit(0), F.lit(9))).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ([0, 1, 2, -1], 1, ["O", "I-ENFERMEDAD"], ["I-ENFERMEDAD", "O", "O"])
    assert df.select(T.argmax(F.array().cast("array<double>")).alias("x")).first().x is None


def test_align_and_collapse(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], ["B-ENFERMEDAD", "O", "I-ENFERMEDAD"])], "w array<int>, t array<string>")
    assert df.select(T.align_labels(F.col("w"), F.col("t")).alias("x")).first().x == [-100, 1, 2, 0, 2, 2, -100]
    pieces = F.transform(F.arrays_zip(F.col("w").alias("word"), F.sequence(F.lit(0), F.lit(6)).alias("value")), lambda p: F.struct(p["word"].alias("word"), p["value"].alias("value")))
    assert df.select(T.first_pieces(pieces).alias("x")).first().x == [1, 3, 4]


def test_pieces_of_a_long_record_are_all_labelled(spark, tmp_path):
    text = "fiebre y " * 700 + "neumonía"
    entity = (len(text) - 8, len(text), "neumonía", "ENFERMEDAD", None)
    spark.createDataFrame([(1, "d", text, [entity], "train", "s")], f"row_id long, doc_id string, text string, entities {ENTITIES}, split string, source string").write.parquet(f"{tmp_path}/distemist_raw_splits.parquet")
    row = align_subword_labels(spark, str(tmp_path)).first()
    labels = [int(x) for x in row.labels.split(",")]
    assert row.n_pieces > 1400 and len(labels) == row.n_pieces + 2
    assert labels[0] == labels[-1] == -100 and sorted(set(labels[1:-1])) in ([0, 1], [0, 1, 2])
    words = spark.createDataFrame([(["uno"] * 600,)], "w array<string>")
    path = vocabulary("byte").path()
    assert words.select(F.size(word_pieces("w", path)) >= 600, F.size(word_pieces("w", path, 512)) == 512).first() == (True, True)


def test_marks_of_both_taggings(spark):
    rng = random.Random(3)
    rows = []
    for k in range(80):
        n = rng.randrange(0, 9)
        tags = lambda: [rng.choice(["O", "B-E", "I-E"]) for _ in range(n)]
        rows.append((k, [rng.choice("xYz") for _ in range(n)], tags(), None if k % 11 == 0 else tags()))
    df = spark.createDataFrame([*rows, (99, None, ["B-E"], ["B-E"])], "k int, w array<string>, t array<string>, p array<string>")
    got = {r.k: [tuple(x) for x in r.m] for r in df.select("k", T.decoded_marks("w", "t", "p").alias("m")).collect()}
    assert got == {99: [], **{k: [(x, True) for x in model_names(w, t)] + [(x, False) for x in (model_names(w, p) if p is not None else [])] for k, w, t, p in rows}}
