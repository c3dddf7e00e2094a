import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import integrity
from quillon.operators.integrity import ForeignKey, direct_orphans, file_reference, orphan_cascade, orphan_report

START = datetime(2024, 1, 1)


def _at(hours):
    return None if hours is None else START + timedelta(hours=hours)


def _model(children, parents):
    out = {}
    for row_id, key, t in children:
        if key is None:
            continue
        own = [(a, b) for k, a, b in parents if k == key and a is not None]
        if t is None:
            out[row_id] = "undated" if own else "missing"
        elif not any(a <= t and (b is None or b > t) for a, b in own):
            out[row_id] = "missing" if not own else "not_yet" if all(a > t for a, _ in own) else "deleted"
    return out


@pytest.mark.parametrize("per_task", [250_000, 3])
def test_direct_orphans_match_a_loop(spark, monkeypatch, per_task):
    monkeypatch.setattr(integrity, "REFS_PER_TASK", per_task)
    rng = random.Random(4)
    when = lambda: _at(rng.choice([None, *range(0, 100, 6)]))
    parents = [(rng.choice(["a", "b", "c", None]), when(), when()) for _ in range(20)]
    children = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), when()) for i in range(400)]
    child = spark.createDataFrame(children, "row_id long, k string, t timestamp")
    parent = spark.createDataFrame(parents, "k string, t timestamp, d timestamp")
    fk = ForeignKey("c", F.col("k"), "p", F.col("k"), at=F.col("t"), since=F.col("t"), until=F.col("d"))
    got = {r.row_id: r.kind for r in direct_orphans(child, parent, fk).collect()}
    assert got == _model(children, parents)
    assert direct_orphans(child, parent.limit(0), fk).where("kind <> 'missing'").count() == 0
    assert direct_orphans(child.limit(0), parent, fk).count() == 0


def test_bounds_of_time(spark):
    parent = spark.createDataFrame([("a", _at(5), _at(9)), ("b", _at(5), _at(5)), ("c", _at(5), None), ("c", _at(5), None)], "k string, since timestamp, until timestamp")
    child = spark.createDataFrame([(1, "a", _at(5)), (2, "a", _at(9)), (3, "b", _at(5)), (4, "c", _at(5)), (4, "c", _at(4))], "row_id long, k string, t timestamp")
    fk = ForeignKey("c", F.col("k"), "p", F.col("k"), at=F.col("t"), since=F.col("since"), until=F.col("until"))
    assert sorted((r.row_id, r.kind) for r in direct_orphans(child, parent, fk).collect()) == [(2, "deleted"), (3, "deleted"), (4, "not_yet")]


def test_cascade_reaches_a_fixpoint(spark):
    chain = spark.createDataFrame([(1, "r1", "gone"), (2, "r2", "r1"), (3, "r3", "r2"), (4, "r4", None), (5, "r5", "r4"), (6, "r2", "r4"), (7, None, "r5")], "row_id long, name string, up string")
    leaf = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3"), (4, None), (5, "nowhere")], "row_id long, of string")
    keys = [ForeignKey("chain", F.col("up"), "chain", F.col("name")), ForeignKey("leaf", F.col("of"), "chain", F.col("name"), strict=False)]
    got = sorted((r.child_table, r.row_id, r.origin, r.depth) for r in orphan_cascade({"chain": chain, "leaf": leaf}, keys).collect())
    # r2 has a second row with a live parent, so what points to it is no orphan.
    assert got == [("chain", 1, "direct", 0), ("chain", 2, "inherited", 1), ("leaf", 1, "inherited", 1)]
    report = {(r.child_table, r.origin): r.n_rows for r in orphan_report(orphan_cascade({"chain": chain, "leaf": leaf}, keys)).collect()}
    assert report == {("chain", "direct"): 1, ("chain", "inherited"): 1, ("leaf", "inherited"): 1}


def test_long_chains_and_the_depth_limit(spark):
    chain = spark.createDataFrame([(i, f"n{i}", f"n{i - 1}") for i in range(1, 8)], "row_id long, name string, up string")
    keys = [ForeignKey("chain", F.col("up"), "chain", F.col("name"))]
    got = {r.row_id: r.depth for r in orphan_cascade({"chain": chain}, keys).collect()}
    assert got == {i: i - 1 for i in range(1, 8)}
    with pytest.raises(ValueError):
        orphan_cascade({"chain": chain}, keys, max_depth=3)


def test_file_reference(spark):
    cases = {" a.txt\n": "a", "a_chunk3.txt": "a", "a_chunk3": "a", "a.txt.txt": "a.txt", "a.txt_chunk1": "a.txt", "A-1": "A-1", None: None, "": "", "a .txt": "a "}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r.r for r in df.orderBy("i").select(file_reference(F.col("c")).alias("r")).collect()] == list(cases.values())


def test_a_line_end_before_the_ending_belongs_to_the_name(spark):
    cases = {"a_chunk3\n.txt": "a_chunk3\n", "a_chunk3\u2028.txt": "a_chunk3\u2028", "a\n_chunk3.txt": "a\n", "a_chunk3.txt\n": "a"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r.r for r in df.orderBy("i").select(file_reference(F.col("c")).alias("r")).collect()] == list(cases.values())


def test_times_without_a_zone_do_not_follow_the_session(spark):
    at = lambda hour, minute: datetime(2024, 3, 31, hour, minute)
    parent = spark.createDataFrame([("a", at(2, 30), at(3, 0)), ("b", at(3, 0), None)], "k string, since timestamp_ntz, until timestamp_ntz")
    child = spark.createDataFrame([(1, "a", at(2, 45)), (2, "a", at(3, 0)), (3, "b", at(2, 30)), (4, "b", at(3, 0))], "row_id long, k string, t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Madrid"):  # where the hour after two is left out that day
            spark.conf.set("spark.sql.session.timeZone", name)
            for until, late in ((F.col("until"), [(2, "deleted"), (3, "not_yet")]), (None, [(3, "not_yet")])):
                fk = ForeignKey("c", F.col("k"), "p", F.col("k"), at=F.col("t"), since=F.col("since"), until=until)
                assert sorted((r.row_id, r.kind) for r in direct_orphans(child, parent, fk).collect()) == late
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
