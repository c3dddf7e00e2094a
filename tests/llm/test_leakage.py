import random

import numpy as np
import pytest

from quillon.llm.leakage import BUCKETS, LEAST_SIMILAR, PASSAGE, PRINTS, RADIUS, Blocks, Index, fingerprints, leaked_items, passages, runs_of
from quillon.llm.normal import WordIds

WORDS = [f"p{i}" for i in range(300)]
OWN = [f"q{i}" for i in range(2000)]
DOCS, ITEMS = "doc_id long, text string, item_id string, seq string", "item_id long, text string, doc_id string"


def edits(a, b):
    """Least edits of a against any stretch of b, first and last word the same."""
    best = 10**6
    for s in [i for i, w in enumerate(b) if w == a[0]]:
        row = {s: 0}
        row = [10**6] * len(b)
        row[s] = 0
        for j in range(s + 1, len(b)):
            row[j] = row[j - 1] + 1
        for i in range(1, len(a)):
            now = [10**6] * len(b)
            for j in range(s, len(b)):
                diag = row[j - 1] if j else 10**6
                now[j] = min(diag + (a[i] != b[j]), row[j] + 1, (now[j - 1] if j else 10**6) + 1)
                if i == len(a) - 1 and a[i] == b[j]:
                    best = min(best, diag)
            row = now
    return best


def test_passages_match_brute_force():
    rng, ids = random.Random(1), WordIds()
    for _ in range(25):
        item = [rng.choice(WORDS) for _ in range(rng.randrange(20, 27))]
        text = [rng.choice(WORDS) for _ in range(rng.randrange(6))] + item[rng.randrange(3) :]
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(text))
            text[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [text[i], "extra"]])
        got = {(s, n): e for s, n, e, _ in passages(ids(item), ids(text))}
        want = {}
        for s in range(len(item) - PASSAGE + 1):
            for n in range(PASSAGE, len(item) - s + 1):
                e = edits(item[s : s + n], text)
                if e <= n // 7:
                    want[s] = (s, n, e)
        assert got == {(s, n): e for s, n, e in want.values()}


def test_index_finds_every_fingerprint_within_the_radius():
    rng = random.Random(2)
    prints = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    some = np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 24))) for p in rng.choices(prints.tolist(), k=300)], np.uint64)
    i, w = Blocks(prints).near(some)
    got = set(zip(i.tolist(), w.tolist(), strict=True))
    far = np.bitwise_count(some[:, None] ^ prints[None, :])
    assert got == {(int(a), int(b)) for a, b in np.argwhere(far <= RADIUS)}


def test_fingerprints_of_some_windows_are_those_of_all():
    rng, weight = np.random.default_rng(3), np.full(BUCKETS, 16, np.int32)
    ids = rng.integers(0, 2**32, 300, dtype=np.uint32)
    every = fingerprints(ids, weight, np.arange(281))
    some = np.unique(rng.integers(0, 281, 40))
    assert every.shape == (281, PRINTS) and (fingerprints(ids, weight, some) == every[some]).all()


def test_every_passage_keeps_a_run_and_nearly_every_one_is_a_candidate():
    """A fifth of the words rare, the rarest edited first, as many edits as allowed, lengths of 20 words and more."""
    rng, ids = random.Random(9), WordIds()
    weight = np.array([16 + (b % 5 == 0) * 16 for b in range(BUCKETS)], np.int32)
    found, n = 0, 400
    for k in range(n):
        item = [f"c{rng.randrange(400)}" for _ in range(rng.randrange(40, 80))]
        length = rng.choice([20, 20, 21, 24, 28, 39])
        s = rng.randrange(len(item) - length + 1)
        part = item[s : s + length]
        order = sorted(range(1, length - 1), key=lambda i: (-weight[ids([part[i]])[0] % BUCKETS], rng.random()))[: length // 7]
        for i in sorted(order, reverse=True):
            part[i : i + 1] = rng.choice([[f"n{rng.randrange(10**6)}"], [], [part[i], f"n{rng.randrange(10**6)}"]])
        text = ids([f"d{rng.randrange(10**6)}" for _ in range(30)] + part + [f"d{rng.randrange(10**6)}" for _ in range(30)])
        own = ids(item)
        if not passages(own, text):
            n -= 1
            continue
        assert np.isin(runs_of(text), runs_of(own)).any()
        found += len(Index.whole_items([own], weight).candidates(text, np.arange(len(text) - PASSAGE + 1))[0]) > 0
    assert n > 300 and found >= 0.995 * n


def cases(rng):
    items = [(k + 1, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30, 60)))) for k in range(12)]
    docs, want = [], set()
    for d in range(120):
        text = [rng.choice(OWN + WORDS[:50]) for _ in range(rng.randrange(20, 200))]
        if d % 3 == 0:
            k = rng.randrange(12)
            words = items[k][1].split()
            n = rng.choice([10, 12, 15, 20, 22, 28])
            s = rng.randrange(len(words) - n + 1)
            part = words[s : s + n]
            if n >= 20:
                for _ in range(rng.randrange(0, n // 7 + 1)):
                    part[rng.randrange(1, n - 1)] = rng.choice(OWN)
                want.add((k + 1, d))
            at = rng.randrange(len(text))
            text[at:at] = part
        text = " ".join(text)
        if d % 6 == 0:
            text = text.upper().replace(" ", ", ", 3).replace(" P", " <b>P", 1)
        docs.append((d, text, "clash", None))
    return docs, items, want


@pytest.mark.parametrize("per_task", [8_000, 60])
def test_planted_passages(spark, per_task):
    docs, items, want = cases(random.Random(3))
    out = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS), per_task).collect()
    assert {(r.item_id, r.doc_id) for r in out} == want
    assert all(r.n_words >= PASSAGE and r.edits <= r.n_words // 7 and 0 < r.covered <= 1 and r.similarity >= LEAST_SIMILAR for r in out)


def test_nulls_copies_and_nothing(spark):
    text = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(1, text, "", None), (1, text, "", None), (2, None, "", None), (3, "", "", None), (4, "a b", "", None)], DOCS)
    items = spark.createDataFrame([(7, text, ""), (8, text, ""), (9, None, ""), (10, "too short", "")], ITEMS)
    assert sorted((r.item_id, r.doc_id) for r in leaked_items(docs, items).collect()) == [(7, 1), (7, 1), (8, 1), (8, 1)]
    assert leaked_items(docs.limit(0), items).count() == leaked_items(docs, items.limit(0)).count() == 0
    assert leaked_items(docs, items.where("item_id > 8")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [rng.choice(OWN) for _ in range(120_000)]
    words[79_990:79_990] = WORDS[:25]  # across the edge of a slice
    words[39_990:39_990] = WORDS[100:125]
    docs = spark.createDataFrame([(1, " ".join(words), "", None)], DOCS)
    items = spark.createDataFrame([(1, " ".join(WORDS[:25]), ""), (2, " ".join(WORDS[100:125]), ""), (3, " ".join(WORDS[200:240]), "")], ITEMS)
    assert {(r.item_id, r.n_words) for r in leaked_items(docs, items).collect()} == {(1, 25), (2, 25)}


def test_items_shared_out_are_found_as_items_in_every_task(spark, monkeypatch):
    rng = random.Random(5)
    docs, items, want = cases(rng)
    hot = " ".join(WORDS[:30])
    docs += [(1000 + i, hot if i % 2 else f"uno {hot} dos", "clash", None) for i in range(90)] + [(1001, hot, "", None), (None, hot, "", None), (2000, None, "", None), (2001, "", "", None)]
    items += [(100, hot), (101, hot), (102, hot), (103, None), (104, "kurz")]
    monkeypatch.setattr("quillon.llm.leakage.PLACES_PER_TASK", 40)
    tables = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    one, two = (sorted(map(str, ((r.item_id, r.doc_id, r.n_words, r.edits) for r in leaked_items(*tables, n).collect()))) for n in (8_000, 60))
    assert one == two and len(one) >= len(want) + 3 * 92


def test_the_documents_are_read_once(spark, tmp_path):
    docs, items, _ = cases(random.Random(6))
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "docs"))
    plan = leaked_items(spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(*i, "clash") for i in items], ITEMS), 60)._jdf.queryExecution().toString()
    assert str(tmp_path / "docs") not in plan and plan.count("doc-runs") >= 1
