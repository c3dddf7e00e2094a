"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import BLANK, strip
from quillon.operators.prefix import hash_key, prefix_sums
from quillon.operators.skew import salted_join
from quillon.storage import keep, spread

#: A public tokenizer's merge ranks (see the folder's own description), and the pattern that goes with them.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(col: Column | str, path: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Tokens of each text in a public byte-level BPE read from path on every worker; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(col)


def source_name(col: Column | str) -> Column:
    """One spelling per source: no outer blanks, lower case, runs of blanks or - as _; null and blank are null."""
    name = F.regexp_replace(F.lower(strip(col)), f"(?:{BLANK}|-)+", "_")
    return F.when(name != "", name)


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: str = "42", tokens=token_count, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(mixture (doc_id, source, n_tokens, uses), report per source).

    docs has doc_id (unique), text and source; targets has source, target_share and max_repeats (null: 1).
    Sources are one when source_name makes them equal; targets that become equal add up, with the smaller of
    their max_repeats. Targets without a token to give are met by nobody, so the others' shares are scaled to
    sum to 1. The mixture's size is total_tokens, or else the largest at which every such share can be held.
    A source's budget is its share of that, at most max_repeats times what it has: whole epochs of all its
    records, then one more use of the records that stand first in hash order, as far as the running sum of
    tokens says; the record that straddles the budget is in if the larger part of it fits. Records without
    tokens and those of sources without a target have 0 uses; they stay out of the mixture and in the report.
    """
    goals = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r")).where("source is not null").groupBy("source").agg(F.sum("w").alias("target_share"), F.min("r").alias("max_repeats"))
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")))
    sized = keep(rows.select("doc_id", source_name("source").alias("source"), tokens(F.col("text")).alias("n_tokens")), "sized")
    held = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = goals.join(held, "source", "full_outer").select("source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    plan = keep(plan, "mix-plan")
    able = plan.where("target_share > 0 and tokens > 0 and max_repeats > 0")
    shares = able.agg(F.sum("target_share").alias("all")).first()["all"] or 0.0
    if total_tokens is None:
        total_tokens = able.agg(F.min(F.col("tokens") * F.col("max_repeats") / (F.col("target_share") / F.lit(shares or 1.0))).alias("most")).first()["most"] or 0
    on = (F.col("target_share") > 0) & (F.col("tokens") > 0) & (F.col("max_repeats") > 0)
    sought = F.when(on, F.col("target_share") / F.lit(shares or 1.0)).otherwise(F.lit(0.0))
    budget = F.least(F.floor(sought * F.lit(float(total_tokens)) + F.lit(1e-6)), F.col("tokens") * F.coalesce("max_repeats", F.lit(0))).cast("long")
    plan = plan.withColumn("sought_share", sought).withColumn("budget", F.when(on, budget).otherwise(0))
    cuts = plan.where("budget > 0").select("source", "budget", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), F.col("tokens").alias("_all"))
    n = sized.count()
    some = salted_join(sized.where("n_tokens > 0"), cuts, "source", counted=sized, rows=n).withColumn("key", hash_key("doc_id", seed=seed))
    summed = prefix_sums(some, ["source"], "key", ["doc_id"], F.col("n_tokens"), n)
    rest = F.col("budget") - F.col("epochs") * F.col("_all")
    mixture = keep(summed.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(F.col("running") * 2 - F.col("n_tokens") <= rest * 2, 1).otherwise(0)).alias("uses")).where("uses > 0"), "mixture")
    used = mixture.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    whole = mixture.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("uses")), F.lit(0)).alias("w")).first()["w"]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = plan.join(used, plan["source"].eqNullSafe(used["source"]), "left").select(
        plan["source"], "target_share", "sought_share", "max_repeats", "docs", "tokens", "budget", zero("used_docs"), zero("used_tokens"), zero("most_uses"),
        (F.coalesce("used_tokens", F.lit(0)) / F.lit(float(whole or 1))).alias("actual_share"))
    return mixture, report
