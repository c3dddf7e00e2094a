import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm.splitting import INSIDE, SENTENCE, boundary, place, split_oversized, split_text
from quillon.schemas import ENTITIES

SCHEMA = f"row_id long, doc_id string, text string, entities {ENTITIES}, piece_no string, start string"


def entity(text, words, at=0):
    a = text.index(words, at)
    return {"start": a, "end": a + len(words), "text": words, "label": "L", "normalized_term": None}


def sentences(rng, n):
    return [" ".join([f"Inicio{i}"] + [f"w{rng.randrange(99)}" for _ in range(rng.randrange(3, 14))]) + "." for i in range(n)]


def test_boundaries_of_words_with_long_quote_tails():
    quotes = "”’" * 40
    text = f"uno dos{'x' * 30}.{quotes} {'«“' * 30}Tres cuatro"
    words = [m.span() for m in re.finditer(r"\S+", text)]
    pieces, _ = split_text(text, [], 3, 0)
    assert len(words) == 4 and pieces[1]["text"].endswith("Tres cuatro") and pieces[0]["text"].endswith(quotes)


def test_boundaries():
    assert boundary("fin.", "\n\n", "Otro") > boundary("fin.", " ", "Otro") == SENTENCE > boundary("a,", " ", "b") > boundary("a", " ", "b")
    assert boundary("Dr.", " ", "Paz") < SENTENCE and boundary("ej.", " ", "por") < SENTENCE and boundary("3.", " ", "cm") < SENTENCE
    assert boundary("ingreso;", " ", "Una") == SENTENCE and boundary("ingreso;", " ", "una") < SENTENCE


@pytest.mark.parametrize(("limit", "overlap"), [(60, 15), (40, 0), (30, 10)])
def test_pieces_cover_the_text_and_fit(limit, overlap):
    rng = random.Random(limit)
    for _ in range(40):
        text = "  " + "".join(s + rng.choice([" ", "\n", "\r\n\r\n"]) for s in sentences(rng, rng.randrange(8, 40)))
        words = [m.span() for m in re.finditer(r"\S+", text)]
        pieces, lost = split_text(text, [], limit, overlap)
        end = 0
        for k, p in enumerate(pieces):
            assert p["text"] == text[p["start"] : p["end"]] or len(pieces) == 1
            assert len(p["text"].split()) == p["n_words"] <= limit
            shared = end - p["first_word"]
            assert shared >= 0 and (k == 0 or not overlap or abs(shared - overlap) <= max(1, overlap // 5))
            end = p["first_word"] + p["n_words"]
            if k < len(pieces) - 1:  # sentences are far shorter than a piece, so every cut stands at the end of one
                assert p["text"].endswith(".")
        assert end == len(words) and not lost


def test_no_cut_inside_an_entity():
    rng = random.Random(3)
    for _ in range(30):
        words = [f"w{i}" for i in range(rng.randrange(60, 200))]  # no punctuation at all
        text = " ".join(words)
        entities = [entity(text, " ".join(words[i : i + 6])) for i in range(4, len(words) - 6, 9)]
        pieces, lost = split_text(text, entities, 40, 10)
        assert not lost
        for p in pieces:
            assert all(p["text"][e["start"] : e["end"]] == e["text"] for e in p["entities"])


def test_an_entity_longer_than_a_piece():
    text = " ".join(f"w{i}" for i in range(100))
    pieces, lost = split_text(text, [{"start": 0, "end": len(text), "text": text, "label": "L", "normalized_term": None}], 30, 5)
    assert lost == 1 and all(p["n_words"] <= 30 for p in pieces)


def test_wrong_offsets():
    text = "asma y otra vez asma al fin"
    e = {"start": 14, "end": 18, "text": "asma", "label": "L", "normalized_term": None}
    held, lost = place(text, [e, {**e, "start": None}, {**e, "text": "gripe"}, {**e, "text": None, "start": 0, "end": 4}, {**e, "text": None, "end": 99}, None])
    assert [(h["start"], h["end"]) for h in held] == [(16, 20), (0, 4), (0, 4)] and lost == 2
    assert place(text, None) == ([], 0)


def test_dataframe(spark):
    rng = random.Random(4)
    long = " ".join(sentences(rng, 60))
    words = long.split()
    term = " ".join(words[3:5])
    rows = [(1, "d", long, [tuple(entity(long, term).values())], "x", "y"), (1, "d", long, None, "x", "y"), (2, None, long, [], None, None), (3, "s", "short", [], None, None), (4, "n", None, [], None, None), (5, "b", "  \n", None, None, None),
            (6, "e", " ".join(["w"] * 246), [], None, None), (7, "f", " ".join(["w"] * 247), [], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = split_oversized(df).collect()
    assert {r.row_id for r in out} == {1, 2, 7}
    assert {r.piece_id for r in out if r.row_id == 2} == {None}
    assert all(r.n_words <= 246 for r in out)
    assert any(e.text == term and r.text[e.start : e.end] == term for r in out for e in r.entities)
    assert sum(r.piece_no == 0 for r in out if r.row_id == 1) == 2
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, 50, 50)


def test_very_long_text(spark):
    text = ". ".join("Frase con unas cuantas palabras" for _ in range(40_000))
    df = spark.createDataFrame([(1, "d", text, [])], f"row_id long, doc_id string, text string, entities {ENTITIES}")
    r = split_oversized(df).agg(F.max("n_words"), F.count("*"), F.max("n_pieces")).first()
    assert r[0] <= 246 and r[1] == r[2] > 900


def test_inside_is_the_weakest():
    assert INSIDE < min(boundary("a", " ", "b"), boundary("a", "\n", "b"))
