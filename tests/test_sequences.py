import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import sequences as S
from quillon.functions.batches import aligned, counts_of
from quillon.functions.tags import IGNORED, LABELS

TEXTS = ["", "a", "neumonía adquirida  y\tasma", None, "x " * 400, "<|endoftext|>"]


@pytest.mark.parametrize("key", ["byte", "piece"])
def test_ids_are_framed_and_read_back(spark, key):
    v = S.vocabulary(key)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, t string")
    rows = df.select("k", "t", S.encoded("t", key).alias("ids"), S.framed_length("t", key).alias("n")).orderBy("k").collect()
    assert [r.ids is None for r in rows] == [t is None for t in TEXTS]
    assert all(r.ids[0] == v.begin and r.ids[-1] == v.end and len(r.ids) == r.n for r in rows if r.ids is not None)
    if key == "byte":
        masked = F.concat("ids", F.array(F.lit(IGNORED), F.lit(IGNORED)))
        back = df.select("k", S.encoded("t", key).alias("ids")).select("k", S.decoded_text(S.unmasked(masked, key), key).alias("t"))
        assert [r.t for r in back.orderBy("k").collect()] == TEXTS


def test_long_sequences_keep_their_frame(spark):
    v = S.vocabulary("byte")
    df = spark.createDataFrame([("palabra " * 900,)], "t string")
    ids = df.select(S.encoded("t", "byte", v.longest).alias("i")).first().i
    assert len(ids) == 512 and (ids[0], ids[-1]) == (v.begin, v.end)
    assert len(df.select(S.encoded("t", "byte").alias("i")).first().i) > 900


def test_unknown_vocabularies_are_named():
    with pytest.raises(ValueError, match="byte, piece, word"):
        S.vocabulary("nothing")


def test_batches_are_filled_up_to_their_longest(spark):
    rows = [(i, list(range(i % 7)), None if i == 3 else [1]) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, ids array<int>, other array<int>")
    out = S.collate(df, "k", 8, {"ids": 9, "other": IGNORED}).collect()
    assert sorted(r.k for r in out) == list(range(50)) and {r.batch for r in out} == set(range(7))
    for b in range(7):
        own = [r for r in out if r.batch == b]
        assert len(own) == (8 if b < 6 else 2) and {len(r.ids) for r in own} == {max(r.k % 7 for r in own)}
        assert all(r.ids == list(range(r.k % 7)) + [9] * (len(r.ids) - r.k % 7) for r in own)
    assert next(r for r in out if r.k == 3).other is None
    assert S.collate(df.limit(0), "k", 8, {"ids": 9}).count() == 0


def test_aligned_labels_of_odd_rows():
    import pyarrow as pa

    words = pa.array([[None, 0, 0, 1, None], None, [], [0, 5], [0, 0]], pa.list_(pa.int32()))
    tags = pa.array([["B-ENFERMEDAD", "O"], ["O"], ["O"], ["I-ENFERMEDAD"], None], pa.list_(pa.string()))
    assert aligned(words, tags, LABELS, IGNORED).to_pylist() == [[-100, 1, 2, 0, -100], None, [], [2, -1], None]
    assert aligned(words[1:4], tags[1:4], LABELS, IGNORED).to_pylist() == [None, [], [2, -1]]


def _steps(monkeypatch, *made):
    """The functions over batches that columns are made of, as the workers run them."""
    for kind in ("arrow_udf", "pandas_udf"):
        monkeypatch.setattr(F, kind, lambda _: lambda run: lambda *_: run)
    return [make() for make in made]


def _peak_mb(run, *batches):
    tracemalloc.start()
    try:
        out = list(run(iter(batches)))
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


RECORDS = [f"neumonía adquirida {i} y asma leve, " * 40 for i in range(1_500)]


def test_ids_of_a_batch_are_made_and_read_text_by_text(monkeypatch):
    encode, decode = _steps(monkeypatch, lambda: S.encoded("t", "byte"), lambda: S.decoded_text("ids", "byte"))
    next(encode(iter([pa.array(["a"])]))), next(decode(iter([pa.array([[64]], pa.list_(pa.int32()))])))  # the vocabulary is read
    peak, (ids,) = _peak_mb(encode, pa.array(RECORDS))
    assert peak < 25, f"{peak} MB for {ids.nbytes / 1e6} MB of ids"
    peak, (texts,) = _peak_mb(decode, ids)
    assert peak < 25 and texts.to_pylist() == RECORDS


@pytest.mark.parametrize("key", ["byte", "word", "piece"])
def test_lengths_of_a_batch_are_taken_text_by_text(monkeypatch, key):
    length, encode = _steps(monkeypatch, lambda: S.token_length("t", S.vocabulary(key).path()), lambda: S.encoded("t", key))
    next(length(iter([pd.Series(["a"])])))
    peak, (n,) = _peak_mb(length, pd.Series([*RECORDS, None, ""]))
    assert peak < 5 and n.isna().tolist() == [False] * len(RECORDS) + [True, False]
    (ids,) = encode(iter([pa.array([*RECORDS[:20], ""])]))
    assert [*n[:20], n.iloc[-1]] == [len(x) - 2 for x in ids.to_pylist()]


def test_words_of_a_batch_are_counted_in_lots():
    texts = [*RECORDS, None, "", "  ", "x " * 700_000, *RECORDS[:2]]
    for batch in (pa.array(texts), pa.array(texts)[3:], pa.array([], pa.string()), pa.array([None], pa.string())):
        _, (n,) = _peak_mb(counts_of, batch)
        assert n.to_pylist() == [None if t is None else len(t.split()) for t in batch.to_pylist()]
    peak, _ = _peak_mb(counts_of, pa.array(RECORDS * 4))
    assert peak < 60
