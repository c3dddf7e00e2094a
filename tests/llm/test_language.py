import duckdb
import numpy as np
import pytest

from quillon.llm.language import document_languages, fit_language_model, label_language, language_cases, language_stretches, stretches, train

SAMPLES = duckdb.sql("SELECT lang, text FROM '/root/testdata/sf0.001/lang_samples.parquet' ORDER BY sample_id").fetchall()


@pytest.fixture(scope="module")
def model():
    return train(SAMPLES)


def by_lang(lang):
    return [t for a, t in SAMPLES if a == lang]


def test_held_out_accuracy_and_calibration(model):
    assert model.held_out > 0.98 and 0.1 <= model.temperature <= 10
    even = train([s for i, s in enumerate(SAMPLES) if i % 2])
    right, sure = [], []
    for i, (lang, text) in enumerate(SAMPLES):
        if i % 2 == 0:
            s = stretches(even, text)
            right.append(len(s) == 1 and s[0].lang == lang)
            sure.append(s[0].confidence)
    assert np.mean(right) > 0.97 and abs(np.mean(sure) - np.mean(right)) < 0.1


@pytest.mark.parametrize("change", [str.upper, lambda t: "".join(c for c in t if c not in ".,"), lambda t: t.replace(" ", "\n")])
def test_damaged_text(model, change):
    hits = [stretches(model, change(t))[0].lang == lang for lang, t in SAMPLES]
    assert np.mean(hits) > 0.98


@pytest.mark.parametrize(("one", "two"), [("es", "en"), ("pt", "es"), ("fr", "de"), ("it", "pt")])
def test_mixed_text(model, one, two):
    parts = [*by_lang(one)[:3], *by_lang(two)[:2], *by_lang(one)[3:5]]
    text = " ".join(parts)
    found = stretches(model, text)
    assert [s.lang for s in found] == [one, two, one]
    assert text[found[1].start : found[1].end].split()[0] == by_lang(two)[0].split()[0]
    bare = " ".join(p.lower().replace(".", "").replace(",", "") for p in parts)
    assert {s.lang for s in stretches(model, bare)} == {one, two}


def test_foreign_phrases_and_measurements(model):
    text = by_lang("es")[0].rstrip(".") + " with the best " + by_lang("es")[1]
    assert {s.lang for s in stretches(model, text)} == {"es"}
    assert not any(s.sentence for s in stretches(model, "PCR 20 mg/l; Na 64 mmol/l; pO2 7 mmHg | TSH 11,6 mU/l\nK 5,2 mEq/l"))
    assert stretches(model, "") == stretches(model, "12 / 3 ... 4") == []


def test_labels(spark):
    cases = {"es": "es", "ES": "es", "es_CO": "es", " es-ES": "es", "Spanish": "es", "español": "es", "spa": "es", "pt-BR": "pt", "deu": "de", "?": None, "und": None, "": None, None: None, "ca": None, "mul": None, "unknown": None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r.x for r in df.orderBy("i").select(label_language("c").alias("x")).collect()] == list(cases.values())


def test_documents(spark, model):
    es, en, pt = (" ".join(by_lang(x)[:3]) for x in ("es", "en", "pt"))
    rows = [(1, es, "es"), (2, es, None), (3, es, "en"), (4, f"{es} {en}", "es"), (5, en, "eng"), (6, "", "es"), (7, None, "es"), (8, "Na 3 mmol/l", None), (9, pt, "?"), (9, pt, "?"), (None, pt, "und"), (10, pt * 2000, "pt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", df_clash())
    found = language_stretches(df, model)
    assert {tuple(r) for r in language_cases(found).collect()} == {(2, "es"), (3, "es"), (4, "es"), (4, "en"), (9, "pt"), (None, "pt")}
    main = {r.doc_id: (r.lang, r.n_langs, r.label_right) for r in document_languages(found).collect()}
    assert main[1] == ("es", 1, True) and main[3] == ("es", 1, False) and main[4][1] == 2 and main[10] == ("pt", 1, True)
    assert language_stretches(df.limit(0), model).count() == 0


def df_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_fit_from_a_table(spark):
    rows = [*SAMPLES, (None, "x y z"), ("es", None), ("es", "123")]
    model = fit_language_model(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["de", "en", "es", "fr", "it", "pt"]
    with pytest.raises(ValueError):
        fit_language_model(spark.createDataFrame([], "lang string, text string"))


def test_a_very_long_word_is_read_whole(model):
    word = "q" * 300 + "straßenbahnhaltestelle" * 3
    row = model._row(word)
    whole = sum((model.weights[g] for i in range(len(word) + 2) for n in range(1, 5) if i + n <= len(word) + 2 and (g := f" {word} "[i : i + n]) in model.weights), 0)
    assert np.allclose(row[:-3], whole) and row[-2] > 2 * len(word) - 10
    assert model.words([word])[0].shape == (1, 6) and word not in model._ids


def test_a_short_whole_sentence_in_another_language_stands(model):
    es = by_lang("es")
    text = f"{es[0]} The patient was discharged. {es[1]}"
    assert [s.lang for s in stretches(model, text)] == ["es", "en", "es"]
    assert {s.lang for s in stretches(model, f"{es[0].rstrip('.')} patient was discharged {es[1]}")} == {"es"}


FOREIGN = {
    "no": "Pasienten ble innlagt på sykehuset med feber og smerter i brystet etter tre dager.",
    "pl": "Pacjent został przyjęty do szpitala z gorączką i bólem w klatce piersiowej.",
    "fi": "Potilas otettiin sairaalaan kuumeen ja rintakivun vuoksi kolmen päivän jälkeen.",
    "tr": "Hasta üç gün sonra ateş ve göğüs ağrısı ile hastaneye yatırıldı.",
    "sv": "Patienten lades in på sjukhuset med feber och smärta i bröstet efter tre dagar.",
    "": "asdkj qwoeiru zxmcnv alskdjf qpwoeiruty mznxbcv laskdjf qowieur",
}


def test_confidence_is_low_on_foreign_text_and_high_on_known(model):
    assert all(max(s.confidence for s in stretches(model, t)) < 0.5 for t in FOREIGN.values())
    even = train([s for i, s in enumerate(SAMPLES) if i % 2])
    assert np.mean([stretches(even, t)[0].confidence > 0.9 for i, (_, t) in enumerate(SAMPLES) if i % 2 == 0]) > 0.9
