import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import annotate, evaluate, profile, splits
from quillon.operators.prefix import hash_key, prefix_sums
from quillon.operators.predict import gazetteer, gazetteer_terms, predict
from quillon.schemas import ENTITIES


@pytest.mark.parametrize(("n", "sizes"), [(0, {}), (1, (1, 0, 1)), (2, (1, 1, 1)), (5, (4, 1, 1)), (6, (4, 1, 1)), (10, (8, 1, 1)), (30, (24, 3, 3))])
def test_make_split_sizes(spark, n, sizes):
    df = spark.createDataFrame([(f"d{i}", i) for i in range(n)], "doc_id string, split_ long")
    got = Counter(r.split for r in splits.make_split(df).collect())
    assert got == Counter() if n == 0 else (got["train"], got["dev"], got["test"]) == sizes
    if n >= 6:
        assert splits.shared_keys(splits.make_split(df), "doc_id").count() == 0


def test_split_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"d{i}",) for i in range(100)], "doc_id string")
    one, two = ({(r.doc_id, r.split) for r in splits.make_split(x).collect()} for x in (df.repartition(1), df.repartition(7)))
    assert one == two


def test_sample_is_exact_and_stable(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "k long")
    a, b = ({r.k for r in splits.sample_k(x, "k", 12).collect()} for x in (df, df.repartition(9)))
    assert a == b and len(a) == 12
    assert splits.sample_k(df, "k", 80).count() == 50 and splits.sample_k(df.limit(0), "k", 5).count() == 0


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_prefix_sums(spark, slices):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long").withColumn("h", hash_key("k"))
    got = {r.k: (r.g, r.h, r.running) for r in prefix_sums(df, ["g"], "h", ["k"], F.col("v"), 300, slices=slices).collect()}
    assert len(got) == 300
    value = {k: v or 0 for _, k, v in rows}
    for k, (g, h, running) in got.items():
        assert running == sum(value[j] for j, (g2, h2, _) in got.items() if g2 == g and h2 <= h)
    assert prefix_sums(df.limit(0), ["g"], "h", ["k"], F.col("v"), 0).count() == 0


def test_attach_entities(spark):
    docs = spark.createDataFrame([("a", "keep"), ("b", "keep"), (None, "keep")], "doc_id string, ord string")
    notes = spark.createDataFrame([("a", 2, 5, 6, "two", "L"), ("a", 1, 3, 4, None, "L"), ("z", 1, 0, 1, "lost", "L"), (None, 1, 0, 1, "none", "L")], "filename string, ord int, off0 int, off1 int, span string, label string")
    got = {r.doc_id: [e.text for e in r.entities] for r in annotate.attach_entities(docs, notes).collect()}
    assert got == {"a": ["", "two"], "b": [], None: []}


def test_without_entities_and_faults(spark):
    df = spark.createDataFrame([(1, "train", "abc", [(0, 2, "ab", "L", None)]), (2, "train", "abc", None), (3, "dev", "abc", [(1, 9, "x", "L", None), (2, 1, "y", "L", None)]), (4, None, None, [])], f"row_id long, split string, text string, entities {ENTITIES}")
    got = {r.split: (r.n_docs, r.n_without, r.pct_without) for r in annotate.without_entities(df).collect()}
    assert got == {"train": (2, 1, 50.0), "dev": (1, 0, 0.0), None: (1, 1, 100.0)}
    assert sorted((r.row_id, r.ord, r.found) for r in annotate.offset_faults(df).collect()) == [(3, 0, "bc"), (3, 1, None)]
    assert annotate.without_entities(df.limit(0)).count() == 0


def test_profile(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 4, 10)] + [("b", None)], "split string, n int")
    r = profile.length_profile(df, ["split"], "n").collect()
    assert [tuple(x) for x in r] == [("a", 5, 10, 4.0, 3.0, 3.8, 9.76)]
    assert profile.length_profile(df, ["split"], "n", exact=False).first().p50 == 3.0


def test_safe_window(spark):
    df = spark.createDataFrame([(1, "abcde fg"), (2, ""), (3, None)], "k int, text string")
    ratios = profile.token_word_ratio(df, profile.pieces_of_four("text"), F.size(F.split("text", " ")))
    from quillon.functions.text import word_count
    ratios = profile.token_word_ratio(df, profile.pieces_of_four("text"), word_count("text"))
    assert [r.ratio for r in ratios.collect()] == [1.5]
    assert profile.safe_window(ratios).first().window_words == 288
    assert profile.safe_window(ratios.limit(0)).count() == 0
    with pytest.raises(ValueError):
        profile.safe_window(ratios, 90)


def test_scores(spark):
    def pairs(rows):
        return spark.createDataFrame(rows, "doc_id string, entity string")

    cases = [([], [], (0, 0, 0, 0.0, 0.0, 0.0)), ([("d", "a")], [("d", "b")], (0, 1, 1, 0.0, 0.0, 0.0)), ([("d", "a")], [("d", "a")], (1, 0, 0, 1.0, 1.0, 1.0)),
             ([("d", "a"), ("e", "b")], [("d", "a"), ("d", "c")], (1, 1, 1, 0.5, 0.5, 0.5))]
    for truth, predicted, want in cases:
        assert tuple(evaluate.micro_prf1(pairs(truth), pairs(predicted)).first()) == want
    per = {r.doc_id: (r.tp, r.fp, r.fn) for r in evaluate.per_doc_prf1(pairs(cases[3][0]), pairs(cases[3][1])).collect()}
    assert per == {"d": (1, 1, 0), "e": (0, 0, 1)}


def test_entity_pairs_join_chunks(spark):
    df = spark.createDataFrame([("d_chunk0", ["A ", "b"]), ("d_chunk1", ["a", None, " "]), ("e", []), (None, ["x"])], "doc_id string, n array<string>")
    assert {tuple(r) for r in evaluate.entity_pairs(df, F.col("n")).collect()} == {("d", "a"), ("d", "b")}


def test_row_outcomes_equal_the_join(spark):
    rng = random.Random(8)
    names = lambda: None if rng.random() < 0.1 else [rng.choice(["a", "B", "b ", "c", None, ""]) for _ in range(rng.randrange(4))]
    rows = [(rng.choice(["x", "y_chunk0", "y_chunk1", None]), names(), names()) for _ in range(30)]
    df = spark.createDataFrame(rows, "doc_id string, t array<string>, p array<string>")
    want = evaluate.outcomes(evaluate.entity_pairs(df, F.col("t")), evaluate.entity_pairs(df, F.col("p")))
    assert {tuple(r) for r in evaluate.row_outcomes(df, F.col("t"), F.col("p")).collect()} == {tuple(r) for r in want.collect()}


def test_log_views(spark):
    log = spark.createDataFrame([("m", 1, 1.0, 0.9, None, 0.5), ("m", 2, 2.0, None, 0.3, 0.7), ("m", 3, 3.0, None, None, 0.7), ("k", 1, 1.0, 0.1, None, None)], "model_key string, step int, epoch double, loss double, eval_loss double, eval_f1 double")
    assert [tuple(r) for r in evaluate.best_epoch(log).collect()] == [("m", 2.0, 0.7)]
    assert evaluate.training_curves(log).count() == 6
    metrics = spark.createDataFrame([("m", "baseline", "f1", 0.1), ("m", "finetuned", "f1", 0.8)], "model_key string, phase string, metric string, value double")
    assert [tuple(r) for r in evaluate.metric_pivot(metrics, ["model_key"]).collect()] == [("m", "f1", 0.1, 0.8)]
    r = evaluate.results_summary(metrics).first()
    assert (r.baseline.f1, r.finetuned.f1, r.baseline.recall) == (0.1, 0.8, None)


def test_confusion(spark):
    df = spark.createDataFrame([(1, ["a<", "b", "c", "d"], ["B-E", "O", "I-E", "O"], ["B-E", "B-E", "O", "O", "O"])], "k int, w array<string>, t array<string>, p array<string>")
    assert [r.outcome for r in evaluate.token_confusion(df, "t", "p", ["k"]).orderBy("i").collect()] == ["TP", "FP", "FN", "TN"]
    html = df.select(evaluate.confusion_html(F.col("w"), F.col("t"), F.slice("p", 1, 4), "x").alias("h")).first().h
    assert "a&lt;" in html and html.count("<span") == 4


def test_predictions(spark):
    df = spark.createDataFrame([(1, "asma y gripe"), (2, None), (3, "nada")], "k int, t string")
    terms = gazetteer_terms(spark.createDataFrame([("2", "gripe"), ("1", "asma"), ("3", None), ("4", "")], "code string, term string"))
    assert [r.c for r in df.orderBy("k").select(gazetteer("t", terms).alias("c")).collect()] == [["1", "2"], None, []]
    assert [r.c for r in df.orderBy("k").select(gazetteer("t", []).alias("c")).collect()] == [[], None, []]
    assert [r.n for r in df.orderBy("k").select(predict("t", lambda: lambda vs: [v and len(v) for v in vs], "int").alias("n")).collect()] == [12, None, 4]


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 500):
        values = rng.choice(rng.random(60), n)
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        at = [0.0, 0.3, 0.5, 0.9, 1.0]
        assert np.allclose(profile.exact_percentiles(df, "v", at), np.quantile(values, at))
        assert np.allclose(profile.exact_percentiles(df, "v", at, tasks=13), np.quantile(values, at))
    assert profile.exact_percentiles(df.limit(0), "v", [0.5]) == [None]


def test_written_numbers_and_heads(spark):
    df = spark.createDataFrame([(1234567, 2.345), (None, None)], "n long, x double")
    assert [tuple(r) for r in df.select(profile.grouped("n"), profile.fixed("x", 1)).collect()] == [("1,234,567", "2.3"), (None, None)]
    assert [r.id for r in profile.head(spark.range(30).orderBy(F.desc("id")), 3, ["id"]).collect()] == [0, 1, 2]


def test_word_scores_match_the_words_one_by_one(spark):
    rows = [("a", ["B-E", "I-E", "O"], ["B-E", "O", "O"], ["O", "O", "B-E"]), ("a", ["O"], ["O"], []), ("b", [], [], []), (None, ["B-E"], ["B-E"], ["B-E"])]
    df = spark.createDataFrame([(k, t, p, q) for k, t, p, q in rows], "k string, t array<string>, p array<string>, q array<string>")
    got = {(r.k, r.phase, r.metric): r.value for r in evaluate.word_scores(df.where("size(t) = size(q)"), "t", {"one": "p", "two": "q"}, "k").collect()}
    assert got[("a", "one", "recall")] == 0.5 and got[("a", "one", "precision")] == 1.0 and got[("a", "two", "f1")] == 0.0 and got[("b", "one", "f1")] == 0.0 and got[(None, "two", "f1")] == 1.0
