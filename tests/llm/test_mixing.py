import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.llm.mixing import TOKENIZER, mix_sources, source_name, token_count
from quillon.operators.prefix import hash_key

DOCS, TARGETS = "doc_id long, text string, source string, uses int", "source string, target_share double, max_repeats int"


def size(col):
    return F.coalesce(F.length(col), F.lit(0)).cast("long")


def model(docs, targets, keys, total=None):
    """The same mixture by a loop."""
    own = {s: [(keys[d], d, len(t or "")) for d, t, z in docs if z == s] for s in targets}
    tokens = {s: sum(n for *_, n in rows) for s, rows in own.items()}
    able = {s: w for s, (w, r) in targets.items() if tokens[s]}
    if not able:
        return {}
    share = {s: w / sum(able.values()) for s, w in able.items()}
    total = total if total is not None else min(tokens[s] * targets[s][1] / share[s] for s in able)
    out = {}
    for s in able:
        budget = min(int(share[s] * total + 1e-6), tokens[s] * targets[s][1])
        epochs, rest, run = budget // tokens[s], budget % tokens[s], 0
        for _, d, n in sorted(own[s]):
            run += n
            if n and (uses := epochs + (2 * run - n <= 2 * rest)):
                out[d] = uses
    return out


@pytest.mark.parametrize("total", [None, 3_000, 10**9])
def test_mixture_matches_a_loop(spark, total):
    rng = random.Random(5)
    docs = [(i, rng.choice([None, "", "x" * rng.randrange(1, 90)]) if i % 9 == 0 else "x" * rng.randrange(1, 90), rng.choice(["a"] * 6 + ["b", "c", "other", None])) for i in range(400)]
    targets = {"a": (0.4, 1), "b": (0.35, 3), "c": (0.2, 4), "none": (0.05, 2)}
    df = spark.createDataFrame([(*d, 7) for d in docs], DOCS)
    keys = {r.doc_id: r.k for r in df.select("doc_id", hash_key("doc_id", seed="42").alias("k")).collect()}
    mixture, report = mix_sources(df, spark.createDataFrame([(s, *v) for s, v in targets.items()], TARGETS), total, tokens=size)
    got = {r.doc_id: r.uses for r in mixture.collect()}
    assert got == model(docs, targets, keys, total)
    limit = {d: targets[s][1] for d, _, s in docs if s in targets}
    assert all(u <= limit[d] for d, u in got.items())
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"a", "b", "c", "none", "other", None}
    assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9
    if total is None:
        assert all(abs(rows[s].actual_share - rows[s].sought_share) < 0.02 for s in "abc")
        assert rows["none"].used_tokens == rows["other"].used_tokens == 0
    if total == 10**9:
        assert all(rows[s].most_uses == targets[s][1] for s in "abc")


def test_spellings(spark):
    df = spark.createDataFrame([(" Hospital-Norte ",), ("hospital norte",), ("HOSPITAL_NORTE\t",), ("",), (" ",), (None,)], "s string")
    assert [r.n for r in df.select(source_name("s").alias("n")).collect()] == ["hospital_norte"] * 3 + [None] * 3


def test_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, None)], TARGETS)
    mixture, report = mix_sources(docs, targets, tokens=size)
    assert mixture.count() == 0 and [r.used_tokens for r in report.collect()] == [0]
    some = spark.createDataFrame([(1, "abc", "a", 0)], DOCS)
    mixture, report = mix_sources(some, targets.limit(0), tokens=size)
    assert mixture.count() == 0 and [(r.source, r.docs) for r in report.collect()] == [("a", 1)]
    assert [r.uses for r in mix_sources(some, targets, tokens=size)[0].collect()] == [1]


def test_repeated_target_spellings_add_up(spark):
    docs = spark.createDataFrame([(i, "xx", "A b" if i % 2 else "c", 0) for i in range(40)], DOCS)
    targets = spark.createDataFrame([("a_b", 0.25, 3), ("A-B", 0.25, 2), ("c", 0.5, 2), (None, 9.0, 9)], TARGETS)
    rows = {r.source: r for r in mix_sources(docs, targets, tokens=size)[1].collect()}
    assert rows["a_b"].max_repeats == 2 and rows["a_b"].actual_share == rows["c"].actual_share == 0.5


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="the public tokenizer is not installed")
def test_token_counts(spark):
    df = spark.createDataFrame([("hola mundo",), ("",), (None,), ("<|endoftext|>",), ("palabra " * 50_000,)], "t string")
    n = [r.n for r in df.select(token_count("t").alias("n")).collect()]
    assert n[0] > 1 and n[1] == n[2] == 0 and n[3] > 1 and n[4] >= 50_000
