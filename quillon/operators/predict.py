"""Predictions in Arrow batches, and a gazetteer that stands in for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that are handed to the tasks at most; the automaton of more should be built in passes.
MAX_TERMS = 200_000


def predict(col: Column | str, make: Callable[[], Callable[[list], list]], returns: str) -> Column:
    """make() is called once per task and gives a function of a list of values; its answers are the column. The shape in
    which a trained model is run: loaded once, called by batch."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = make()
        for values in batches:
            yield pd.Series(answer(values.tolist()), dtype=object)

    return run(col)


def gazetteer(texts: Column | str, terms: list[tuple[str, str]]) -> Column:
    """array<string>: the codes of the terms (code, term) that occur in each text, as written, in ascending order."""
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms; look for them in passes")

    def make() -> Callable[[list], list]:
        import ahocorasick

        by: dict[str, list[str]] = {}
        for code, term in terms:
            if term:
                by.setdefault(term, []).append(code)
        auto = ahocorasick.Automaton()
        for term, codes in by.items():
            auto.add_word(term, codes)
        if by:
            auto.make_automaton()
        return lambda values: [None if v is None else sorted({c for _, codes in auto.iter(v) for c in codes}) if by else [] for v in values]

    return predict(texts, make, "array<string>")


def gazetteer_terms(dictionary: DataFrame, code: str = "code", term: str = "term") -> list[tuple[str, str]]:
    """The dictionary on the driver; more than MAX_TERMS rows are an error, not a cut."""
    rows = dictionary.select(code, term).where(F.col(term).isNotNull() & (F.col(term) != "")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms; look for them in passes")
    return sorted((r[0], r[1]) for r in rows)
