import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm.forest import spanning_forest
from quillon.llm.related import deal_groups, reference_number, related_groups

EDGE = "id string, u string, v string, weight int"


def components(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    out = defaultdict(set)
    for x in list(up):
        out[root(x)].add(x)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def check(spark, edges):
    labels, forest = spanning_forest(spark.createDataFrame(edges, EDGE))
    groups = defaultdict(set)
    for r in labels.collect():
        groups[r.root].add(r.node)
    real = [(u, v) for _, u, v, _ in edges if u is not None and v is not None and u != v]
    assert {frozenset(g) for g in groups.values()} == components(real)
    kept = {r.id for r in forest.collect()}
    tree = [(u, v) for i, u, v, _ in edges if i in kept]
    assert components(tree) == components(real)
    assert len(kept) == sum(len(g) - 1 for g in components(real))


def test_random_graphs(spark):
    rng = random.Random(9)
    for n, m in ((30, 20), (40, 60)):
        check(spark, [(f"e{i}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.randrange(3)) for i in range(m)])


def test_chain_star_and_parallel_edges(spark):
    check(spark, [(f"c{i}", f"n{i:03}", f"n{i + 1:03}", 0) for i in range(120)] + [(f"s{i}", "hub", f"m{i}", 1) for i in range(60)] + [("p1", "x", "y", 1), ("p2", "y", "x", 1), ("loop", "z", "z", 0), ("null", None, "x", 0)])


def test_no_edges(spark):
    labels, forest = spanning_forest(spark.createDataFrame([], EDGE))
    assert labels.count() == forest.count() == 0


def test_reference_number(spark):
    cases = {"PX-000000750": "750", " px750": "750", "px/0000000750": "750", "PX-0": None, "PX-000": None, "s/d": None, "-": None, "": None, None: None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r.n for r in df.orderBy("i").select(reference_number("c").alias("n")).collect()] == list(cases.values())


FILES = "filename string, patient_ref string, author_ref string, base string"


def groups_of(spark, docs, files):
    df = spark.createDataFrame([(d, "x") for d in docs], "doc_id string, base string")
    members, _ = related_groups(df, spark.createDataFrame(files, FILES))
    return {r.doc_id: r.group_id for r in members.collect()}


def test_ties(spark):
    docs = ["a", "a_chunk0", "a_chunk0", "b", "c", "d", "e", None, "z_chunk1", ""]
    files = [("a", "PX-1", "AU-7", ""), ("b", "px 001", None, ""), ("b", None, "AU 9", ""), ("c", None, "au/09", ""), ("ghost", "PX-5", "AU-8", ""), ("d", "PX-5", None, ""), ("e", None, "AU-8", ""), (None, "PX-1", None, "")]
    # a and b share a patient, b and c an author; d and e are tied only by a file that has no record.
    assert groups_of(spark, docs, files) == {"a": "a", "a_chunk0": "a", "b": "a", "c": "a", "d": "d", "e": "e", "z_chunk1": "z_chunk1", "": ""}


def test_ties_without_files_or_docs(spark):
    assert groups_of(spark, ["a", "a_chunk2", "b"], []) == {"a": "a", "a_chunk2": "a", "b": "b"}
    assert groups_of(spark, [], [("a", "1", "1", "")]) == {}


@pytest.mark.parametrize("sizes", [[1] * 500, [300] + [1] * 600, [40] * 10 + [3] * 50 + [1] * 300, [7, 7, 7]])
def test_dealing(spark, sizes):
    rows = [(f"d{g}-{k}", f"g{g}", "clash") for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, group_id string, split string")
    out = deal_groups(df).collect()
    assert len(out) == len(rows)
    per = defaultdict(set)
    for r in out:
        per[r.group_id].add(r.split)
    assert all(len(s) == 1 for s in per.values())
    if sizes.count(1) >= 300:
        share = Counter(r.split for r in out)
        assert all(abs(share[s] / len(rows) - want) < 0.01 for s, want in (("train", 0.8), ("dev", 0.1), ("test", 0.1)))
    assert {(r.doc_id, r.split) for r in deal_groups(df.repartition(7)).collect()} == {(r.doc_id, r.split) for r in out}


def test_dealing_nothing_and_wrong_shares(spark):
    df = spark.createDataFrame([], "doc_id string, group_id string")
    assert deal_groups(df).count() == 0 and "split" in deal_groups(df).columns
    with pytest.raises(ValueError):
        deal_groups(df, 0.8, 0.3, 0.1)


def test_hub_of_a_third(spark):
    docs = [f"d{i}" for i in range(900)]
    files = [(d, None, "AU-1" if i % 3 == 0 else None, "") for i, d in enumerate(docs)]
    sizes = Counter(groups_of(spark, docs, files).values())
    assert sorted(sizes.values())[-1] == 300 and len(sizes) == 601


def test_a_large_star_without_adaptive_execution(spark):
    """One hub with 200,000 edges (hot from 50,000 on), and a chain beside it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        star = spark.range(200_000).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("leaf"), "id").alias("u"), F.lit("hub").alias("v"), F.lit(0).alias("weight"))
        chain = spark.createDataFrame([(f"c{i}", f"n{i:03}", f"n{i + 1:03}", 1) for i in range(30)], EDGE)
        labels, forest = spanning_forest(star.unionByName(chain))
        assert sorted(r["count"] for r in labels.groupBy("root").count().collect()) == [31, 200_001]
        assert forest.count() == 200_030
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
