"""Sets of entities per document, and scores of predicted sets against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.tags import entity_names, token_outcome
from quillon.functions.text import strip_chunk_suffix


def entity_pairs(df: DataFrame, names: Column, doc_id: Column | str = "doc_id") -> DataFrame:
    """Distinct (doc_id, entity) over the chunks of each document; documents without an entity have no pair."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return df.select(strip_chunk_suffix(key).alias("doc_id"), F.explode_outer(entity_names(names)).alias("entity")).where("doc_id is not null and entity is not null").distinct()


def outcomes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, entity, outcome TP, FP or FN): a full outer join of two distinct sets of pairs on the whole pair, so that a
    document with many entities is spread like any other."""
    t, p = truth.select("doc_id", "entity", F.lit(1).alias("t")), predicted.select("doc_id", "entity", F.lit(1).alias("p"))
    both = t.join(p, ["doc_id", "entity"], "full_outer")
    return both.select("doc_id", "entity", F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), "TP").when(F.col("p").isNotNull(), "FP").otherwise("FN").alias("outcome"))


def row_outcomes(df: DataFrame, truth: Column, predicted: Column, doc_id: Column | str = "doc_id") -> DataFrame:
    """outcomes of entity_pairs(df, truth) and entity_pairs(df, predicted) where both stand in the same rows: one
    pass and one shuffle, in place of two distincts and a join."""
    marked = lambda names, t: F.transform(F.coalesce(entity_names(names), F.array().cast("array<string>")), lambda e: F.struct(e.alias("entity"), F.lit(t).alias("t")))
    return mark_outcomes(df, F.concat(marked(truth, True), marked(predicted, False)), doc_id)


def mark_outcomes(df: DataFrame, marks: Column, doc_id: Column | str = "doc_id") -> DataFrame:
    """outcomes from marks array<struct<entity,t>> of each row: names, and whether they are true ones or predicted."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = df.select(strip_chunk_suffix(key).alias("doc_id"), marks.alias("x"))
    rows = rows.select("doc_id", F.explode_outer("x").alias("x")).where("doc_id is not null and x is not null").select("doc_id", "x.entity", "x.t")
    both = rows.groupBy("doc_id", "entity").agg(F.bool_or("t").alias("t"), F.bool_or(~F.col("t")).alias("p"))
    return both.select("doc_id", "entity", F.when(F.col("t") & F.col("p"), "TP").when(F.col("p"), "FP").otherwise("FN").alias("outcome"))


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def scores(counted: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and f1; all 0 where nothing is true or predicted."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return counted.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * p * r, p + r))


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == x).alias(x.lower()) for x in ("TP", "FP", "FN")]


def micro_scores(found: DataFrame) -> DataFrame:
    """outcomes -> one row: counts summed over all documents, then precision, recall and F1 once."""
    return scores(found.agg(*_counts()))


def doc_scores(found: DataFrame) -> DataFrame:
    """outcomes -> the same for each document."""
    return scores(found.groupBy("doc_id").agg(*_counts()))


def micro_prf1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return micro_scores(outcomes(truth, predicted))


def per_doc_prf1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return doc_scores(outcomes(truth, predicted))


def best_epoch(log: DataFrame, by: str = "model_key") -> DataFrame:
    """The epoch with the highest eval_f1 per model, the earliest of equal ones; rows without eval_f1 do not count."""
    return log.where("eval_f1 is not null").groupBy(by).agg(F.max(F.struct("eval_f1", (-F.col("epoch")).alias("e"))).alias("m")).select(by, (-F.col("m.e")).alias("epoch"), F.col("m.eval_f1").alias("eval_f1"))


def metric_pivot(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, phase, metric, value) with one column per phase, baseline and finetuned."""
    return metrics.groupBy(*by, "metric").pivot("phase", ["baseline", "finetuned"]).agg(F.max("value"))


def training_curves(log: DataFrame, by: str = "model_key") -> DataFrame:
    """The log as (by, step, epoch, series, value), only the values that are there."""
    series = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in ("loss", "eval_loss", "eval_f1")])
    return log.select(by, "step", "epoch", F.explode(series).alias("s")).select(by, "step", "epoch", "s.series", "s.value").where("value is not null")


def results_summary(metrics: DataFrame, by: str = "model_key") -> DataFrame:
    """One nested row per model: baseline and finetuned, each with precision, recall and f1."""
    value = lambda phase, m: F.max(F.when((F.col("phase") == phase) & (F.col("metric") == m), F.col("value"))).alias(m)
    flat = metrics.groupBy(by).agg(*[value(p, m).alias(f"{p}_{m}") for p in ("baseline", "finetuned") for m in ("precision", "recall", "f1")])
    nest = lambda p: F.struct(*[F.col(f"{p}_{m}").alias(m) for m in ("precision", "recall", "f1")]).alias(p)
    return flat.select(by, nest("baseline"), nest("finetuned"))


def word_scores(df: DataFrame, truth: str, predicted: dict[str, str], by: str) -> DataFrame:
    """(by, phase, metric, value): precision, recall and F1 over words for every phase -> column of predicted tags, in one pass;
    counts are summed inside each record, so that a few numbers a record are grouped and not its words."""
    names = ("TP", "FP", "FN")
    n = lambda col, x: F.size(F.filter(F.zip_with(truth, col, token_outcome), lambda o: o == x))
    counts = df.select(by, *[n(col, x).alias(f"{phase}_{x}") for phase, col in predicted.items() for x in names])
    sums = counts.groupBy(by).agg(*[F.sum(f"{phase}_{x}").alias(f"{phase}_{x}") for phase in predicted for x in names])
    phases = F.array(*[F.struct(F.lit(phase).alias("phase"), *[F.col(f"{phase}_{x}").alias(x.lower()) for x in names]) for phase in predicted])
    scored = scores(sums.select(by, F.explode(phases).alias("p")).select(by, "p.*"))
    return scored.select(by, "phase", F.explode(F.create_map(*[x for m in ("precision", "recall", "f1") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


def token_confusion(df: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    """(keys, i, truth, predicted, outcome) word by word; the longer array is cut to the other."""
    n = F.least(F.size(truth), F.size(predicted))
    pairs = F.zip_with(F.slice(truth, F.lit(1), n), F.slice(predicted, F.lit(1), n), lambda t, p: F.struct(t.alias("truth"), p.alias("predicted"), token_outcome(t, p).alias("outcome")))
    return df.select(*keys, F.posexplode_outer(pairs).alias("i", "x")).where("x is not null").select(*keys, "i", "x.truth", "x.predicted", "x.outcome")


# The colours of the confusion view, and what its legend calls them.
COLOURS = {"TP": "#b6e3a5", "FP": "#f4a3a3", "FN": "#f7c98d", "TN": "transparent"}
LEGEND = {"TP": "Acierto", "FP": "Falso positivo", "FN": "Se le escapó (FN)"}


def confusion_html(tokens: Column, truth: Column, predicted: Column, title: str) -> Column:
    """A record's words as HTML, coloured by outcome, text escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    rows = F.arrays_zip(tokens.alias("w"), truth.alias("t"), predicted.alias("p"))
    span = lambda r: F.concat(F.lit('<span style="background-color:'), colour[token_outcome(F.coalesce(r["t"], F.lit("O")), F.coalesce(r["p"], F.lit("O")))], F.lit('">'), safe(r["w"]), F.lit("</span>"))
    return F.concat(F.lit(f"<div><b>{title}</b> "), F.array_join(F.transform(rows, span), " "), F.lit("</div>"))


def confusion_view(tokens: Column, truth: Column, rows: dict[str, Column]) -> Column:
    """A legend, and below each other one confusion_html for every title and tags of rows (the truth itself may be one)."""
    legend = "<div>" + " ".join(f'<span style="background-color:{COLOURS[k]}">{v}</span>' for k, v in LEGEND.items()) + "</div>"
    return F.concat(F.lit(legend), *[confusion_html(tokens, truth, tags, title) for title, tags in rows.items()])
