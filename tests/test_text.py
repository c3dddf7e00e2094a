import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.text import strip, strip_chunk_suffix, unescape_unicode, word_count, word_spans, words


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def _column(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


TEXTS = ["", " ", None, "a", "  a b\tc\r\nd ", "x y z", "p\x1cq", "😀a 😀 b", "ñandú　fin", "﻿bom here", "w " * 300]


def test_words_match_python(spark):
    got = _column(_frame(spark, TEXTS), words("t"))
    assert got == [None if t is None else re.findall(r"\S+", t) for t in TEXTS]
    assert _column(_frame(spark, TEXTS), word_count("t")) == [None if t is None else len(t.split()) for t in TEXTS]


def test_spans_are_code_points(spark):
    for t, spans in zip(TEXTS, _column(_frame(spark, TEXTS), word_spans("t")), strict=True):
        if t is None:
            assert spans is None
        else:
            assert [(s.i, s.word, s.start, s.end) for s in spans] == [(i, m.group(), *m.span()) for i, m in enumerate(re.finditer(r"\S+", t))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n ñ😀.", max_size=60), min_size=1, max_size=8))
def test_spans_of_any_text(spark, texts):
    got = _column(_frame(spark, texts), word_spans("t"))
    assert [[(s.start, s.end) for s in spans] for spans in got] == [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]


def test_long_text(spark):
    spans = spark.createDataFrame([("ab " * 60_000,)], "t string").select(word_spans("t").alias("s")).select(F.size("s"), F.element_at("s", -1)["end"]).first()
    assert tuple(spans) == (60_000, 179_999)


def test_strip_and_suffix(spark):
    assert _column(_frame(spark, ["  a b \n", None, ""]), strip("t")) == ["a b", None, ""]
    assert _column(_frame(spark, ["d_chunk3", "d_chunk", "d_chunk3_chunk12", "_chunk1x", None]), strip_chunk_suffix("t")) == ["d", "d_chunk", "d_chunk3", "_chunk1x", None]


def test_unescape(spark):
    cases = {
        r"tard\u00edo": "tardío", r"\u00e1\u00F3": "áó", r"bad \u12 \uzzzz": r"bad \u12 \uzzzz", r"pair \ud83d\ude00!": "pair 😀!",
        r"half \ud83d.": "half \ufffd.", r"\ude00": "\ufffd", r"\\u0041": "\\A", "plain": "plain", "": "", None: None, r"\u0041BC": "ABC",
        r"\u{00e9}": r"\u{00e9}",
    }
    assert _column(_frame(spark, list(cases)), unescape_unicode("t")) == list(cases.values())
