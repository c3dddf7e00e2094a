"""Splits that keep related records together (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import strip_chunk_suffix
from quillon.llm.forest import spanning_forest
from quillon.operators.prefix import hash_key, prefix_sums
from quillon.operators.skew import salted_join
from quillon.storage import keep


def reference_number(col: Column | str) -> Column:
    """The number in a reference without leading zeros, whatever stands around it; null without one or for 0."""
    number = F.regexp_replace(F.regexp_extract(col, "([0-9]+)", 1), "^0+", "")
    return F.when(number != "", number)


def tie_edges(docs: DataFrame, files: DataFrame, doc_id: str = "doc_id", name: str = "filename", refs: tuple[str, ...] = ("patient_ref", "author_ref")) -> DataFrame:
    """Edges (id, u, v, weight, kind) between base ids that share a reference: a star around the least base of each.

    The stars have as many edges as there are references, never a group's pairs. weight is the place of the
    reference in refs, so that ties by the first kind are contracted first. Files without a record tie nobody.
    """
    bases = docs.select(strip_chunk_suffix(F.col(doc_id)).alias("base")).where("base is not null").distinct()
    kinds = F.array(*[F.struct(F.lit(i).alias("weight"), F.lit(r).alias("kind"), reference_number(F.col(r)).alias("number")) for i, r in enumerate(refs)])
    named = files.select(F.col(name).alias("base"), F.explode(kinds).alias("r")).select("base", "r.*").where("number is not null")
    named = keep(named.join(bases, "base", "left_semi").distinct(), "ties")
    hubs = named.groupBy("kind", "number").agg(F.min("base").alias("hub"))
    star = salted_join(named, hubs, ["kind", "number"]).where("base <> hub")
    return star.select(F.concat_ws("|", "kind", "number", "base").alias("id"), F.col("base").alias("u"), F.col("hub").alias("v"), "weight", "kind")


def related_groups(docs: DataFrame, files: DataFrame, doc_id: str = "doc_id", **how) -> tuple[DataFrame, DataFrame]:
    """(members (doc_id, group_id, size), forest edges (id, u, v, weight, kind)).

    members has each distinct doc_id once, with the number of those in its group; group_id is the least doc_id of its group in byte order. Doc_ids that
    are equal without an ending _chunk<digits> are one node from the start. A null doc_id is no record; an empty
    one is an id like any other. With no files every base is a group of its own.
    """
    edges = keep(tie_edges(docs, files, doc_id, **how), "tie-edges")
    labels, ids = spanning_forest(edges)
    ids = docs.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct().withColumn("base", strip_chunk_suffix(F.col("doc_id"))), ids
    own = keep(ids[0].join(labels.withColumnRenamed("node", "base"), "base", "left").select("doc_id", F.coalesce("root", "base").alias("root")), "roots")
    first = own.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size"))
    return salted_join(own, first, "root").select("doc_id", "group_id", "size"), edges.join(ids[1], "id", "left_semi")


def _dealt(rank: str, first: str, held: float, dev: float) -> Column:
    """Split by place: of held x n places, evenly spaced, dev / held go to dev and the others to test."""
    if held <= 0:
        return F.lit(first)
    at = lambda r, f: F.floor(F.col(r) * F.lit(f) + F.lit(1e-9))
    before = lambda r, f: F.floor((F.col(r) - 1) * F.lit(f) + F.lit(1e-9))
    share = dev / held
    turn = F.floor(at(rank, held) * F.lit(share) + F.lit(1e-9)) > F.floor((at(rank, held) - 1) * F.lit(share) + F.lit(1e-9))
    return F.when(at(rank, held) == before(rank, held), first).when(turn, "dev").otherwise("test")


def deal_groups(members: DataFrame, train: float = 0.8, dev: float = 0.1, test: float = 0.1, seed: str = "42") -> DataFrame:
    """(doc_id, group_id) -> the same with split, whole groups only.

    Groups are stratified by size: one band for each size up to 8, then one for each doubling. In a band they
    stand in hash order and every (1/held-out share)-th goes to dev or test in turn; a group larger than a
    held-out split's whole share stays in train. The band of the smallest groups is dealt last, in the
    proportions that make up for what the larger ones left over. Deterministic for a seed.
    """
    if min(train, dev, test) < 0 or abs(train + dev + test - 1) > 1e-9:
        raise ValueError("the three shares must be non-negative and sum to 1")
    members = keep(members.select("doc_id", "group_id"), "members")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("size"))
    banded = keep(sizes.withColumn("band", F.when(F.col("size") <= 8, F.col("size")).otherwise(6 + F.floor(F.log2("size"))).cast("int")).withColumn("key", hash_key("group_id", seed=seed)), "groups")
    total, n, least = banded.agg(F.sum("size"), F.count("*"), F.min("band")).first()
    if not total:
        return members.withColumn("split", F.lit(None).cast("string"))
    ranked = keep(prefix_sums(banded, ["band"], "key", ["group_id"], F.lit(1), n, out="place"), "ranked")
    large = ranked.where(F.col("band") > least).withColumn("split", _dealt("place", "train", dev + test, dev))
    for s, share in (("dev", dev), ("test", test)):
        large = large.withColumn("split", F.when((F.col("split") == s) & (F.col("size") > share * total), "train").otherwise(F.col("split")))
    large = keep(large, "dealt")
    got = {r["split"]: r["n"] for r in large.groupBy("split").agg(F.sum("size").alias("n")).collect()}  # three rows at most
    need = {s: max(0.0, share * total - got.get(s, 0)) for s, share in (("train", train), ("dev", dev), ("test", test))}
    left = sum(need.values()) or 1.0
    small = ranked.where(F.col("band") == least).withColumn("split", _dealt("place", "train", (need["dev"] + need["test"]) / left, need["dev"] / left))
    return salted_join(members, large.unionByName(small).select("group_id", "split"), "group_id").select("doc_id", "group_id", "split")
