"""Connected components by minimum-edge contraction, with the spanning forest they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import salted_join
from quillon.storage import keep, keep_counted

#: Each round at least halves the components that still have an edge, so 64 rounds do for any input.
MAX_ROUNDS = 64


def _roots(pick: DataFrame, n: int) -> DataFrame:
    """(c, root) from (c, parent), n rows, where every chain ends in a c that is its own parent: pointers are doubled."""
    hop = keep(pick, "hop")
    for _ in range(MAX_ROUNDS):
        up = hop.select(F.col("c").alias("parent"), F.col("parent").alias("above"))
        hop, seen = keep_counted(salted_join(hop, up, "parent", rows=n).select("c", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "hop", moved=F.col("moved"))
        if not seen["moved"]:
            return hop.select("c", F.col("parent").alias("root"))
    raise ValueError("pointers did not settle")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (id, u, v, weight) -> (labels (node, root), forest edge ids (id)), both written to the shared folder.

    A round lets every component pick its least edge by (weight, hash of id, id), keeps the picked edges as
    part of the forest, contracts along them and drops what became parallel or inner. As the order of edges is
    total, the only cycles among picks are pairs that picked the same edge; the smaller end becomes the root.
    Each pick is a map-side combined minimum and joins on hubs and roots are salted, so a hub or component with a third of all
    edges is never one task's group, and nothing but row counts comes to the driver. Loops, repeated edges and nulls (no edge) are fine; nodes without an edge to
    another node have no label; an empty table gives empty results.
    """
    spark = edges.sparkSession
    e, seen = keep_counted(edges.where("u is not null and v is not null and u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct("weight", F.xxhash64("id").alias("h"), "id").alias("w")), "edges")
    labels, nodes, forest = None, 0, []
    for _ in range(MAX_ROUNDS):
        n = seen["n"]
        if not n:
            break
        ends = e.select(F.col("u").alias("c"), F.struct("w", F.col("v").alias("to")).alias("m")).unionByName(e.select(F.col("v").alias("c"), F.struct("w", F.col("u").alias("to")).alias("m")))
        pick, seen = keep_counted(ends.groupBy("c").agg(F.min("m").alias("m")).select("c", F.col("m.to").alias("to"), F.col("m.w.id").alias("id")), "picks")
        picked = seen["n"]
        forest.append(pick.select("id").distinct())
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parents = salted_join(pick, back, "to", rows=picked).select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("parent"))
        roots = _roots(parents, picked)
        if labels is None:
            nodes = picked
            labels = keep(roots.select(F.col("c").alias("node"), "root"), "labels")
        else:
            step = roots.select(F.col("c").alias("root"), F.col("root").alias("above"))
            labels = keep(salted_join(labels, step, "root", "left", rows=nodes).select("node", F.coalesce("above", "root").alias("root")), "labels")
        a, b = roots.select(F.col("c").alias("u"), F.col("root").alias("ru")), roots.select(F.col("c").alias("v"), F.col("root").alias("rv"))
        both = salted_join(salted_join(e, a, "u", rows=n), b, "v", counted=e, rows=n)
        e, seen = keep_counted(both.where("ru <> rv").groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("w").alias("w")), "edges")
    else:
        raise ValueError("contraction did not settle")
    if labels is None:
        kind = edges.schema["u"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}"), edges.select("id").limit(0)
    out = forest[0]
    for f in forest[1:]:
        out = out.unionByName(f)
    return labels, out.distinct()
