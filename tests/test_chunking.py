import math
import re

import pytest

from quillon.operators.chunking import chunk_records
from quillon.schemas import ENTITIES


def model(text, entities, w, o):
    """From the closed form: ceil((n - w) / (w - o)) + 1 chunks of n > w words, chunk k from word k (w - o)."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    n = len(spans)
    if n <= w:
        return [(None, text, entities)]
    cuts = [(spans[k * (w - o)][0], spans[min(k * (w - o) + w, n) - 1][1]) for k in range(math.ceil((n - w) / (w - o)) + 1)]
    inside = lambda a, b: [(e[0] - a, e[1] - a, *e[2:]) for e in entities if a <= e[0] and e[1] <= b]
    return [(k, text[a:b], inside(a, b)) for k, (a, b) in enumerate(cuts)]


@pytest.mark.parametrize(("w", "o"), [(5, 0), (5, 2), (7, 6), (1, 0)])
def test_chunks_match_a_loop(spark, w, o):
    rows = []
    for n in range(0, 23):
        text = "  " + " \n ".join(f"w{i}" for i in range(n)) + " "
        entities = [(m.start(), min(len(text), m.end() + 4), "x", "L", None) for m in list(re.finditer(r"\S+", text))[::3]]
        rows.append((n, f"d{n}", text, entities, "extra"))
    df = spark.createDataFrame(rows, f"row_id long, doc_id string, text string, entities {ENTITIES}, n_words string")
    got = {}
    for r in chunk_records(df, w, o).orderBy("row_id", "chunk_no").collect():
        got.setdefault(r.row_id, []).append((r.chunk_no, r.text, [tuple(e) for e in r.entities]))
        assert r.doc_id == (r.orig_doc_id if r.chunk_no is None else f"{r.orig_doc_id}_chunk{r.chunk_no}")
    assert got == {n: model(t, e, w, o) for n, _, t, e, _ in rows}


def test_chunks_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, "a b c", None), (2, "x", None, []), (3, "y", "", None)], f"row_id long, doc_id string, text string, entities {ENTITIES}")
    out = {(r.row_id, r.chunk_no): (r.doc_id, r.text, r.entities) for r in chunk_records(df, 2, 1).collect()}
    assert out == {(1, 0): (None, "a b", []), (1, 1): (None, "b c", []), (3, None): ("y", "", [])}
    assert chunk_records(df.limit(0), 2, 1).count() == 0


def test_window_must_move(spark):
    df = spark.createDataFrame([], f"row_id long, doc_id string, text string, entities {ENTITIES}")
    for w, o in ((5, 5), (5, -1), (3, 9)):
        with pytest.raises(ValueError):
            chunk_records(df, w, o)
