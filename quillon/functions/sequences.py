"""Model sequences: vocabularies by key, framed ids with the words they belong to, decoding, padding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.tags import IGNORED
from quillon.functions.tokenizers import FOLDER, decoder, text_ids, token_length
from quillon.operators.prefix import hash_key, prefix_sums


@dataclass(frozen=True)
class Vocabulary:
    """A public tokenizer's file, the ids that frame a sequence and fill it up, and the longest sequence its model takes."""

    file: str
    begin: int
    end: int
    pad: int
    longest: int | None

    def path(self, folder: str = FOLDER) -> str:
        return f"{folder}/{self.file}"


#: Special ids as the files define them; a vocabulary without padding fills up with its end or unknown piece.
REGISTRY = {
    "byte": Vocabulary("byte_bpe_50k.json", 50256, 50256, 50256, 512),
    "word": Vocabulary("word_bpe_49k.json", 49406, 49407, 49407, 512),
    "piece": Vocabulary("piece_bpe_32k.model", 1, 2, 0, None),
}


def vocabulary(key: str) -> Vocabulary:
    """The vocabulary registered under key; unknown keys are an error that names those there are."""
    if key not in REGISTRY:
        raise ValueError(f"no vocabulary {key!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[key]


def framed_length(col: Column | str, key: str, folder: str = FOLDER) -> Column:
    """Number of pieces of each text with the two that frame it; null for a null text."""
    return token_length(col, vocabulary(key).path(folder)) + 2


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=pa.array([r is None for r in rows], pa.bool_()))


def encoded(col: Column | str, key: str, most: int | None = None, folder: str = FOLDER) -> Column:
    """array<int>: framed ids of each text, the frame kept and the rest cut where there are more than `most` (null: never)."""
    v = vocabulary(key)
    path = v.path(folder)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = text_ids(path)
        for texts in batches:
            yield _lists([None if t is None else np.array([v.begin, *encode(t)[: None if most is None else most - 2], v.end], np.int32) for t in texts.to_pylist()])

    return run(col)


def decoded_text(ids: Column | str, key: str, folder: str = FOLDER) -> Column:
    """The text of ids, framing and padding left out; ids must be a vocabulary's own (see unmasked)."""
    v = vocabulary(key)
    path, special = v.path(folder), {v.begin, v.end, v.pad}

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = decoder(path)
        for lists in batches:
            rows = (x.as_py() for x in lists)  # a row at a time: Python's numbers of a whole batch take ten times the batch
            yield pa.array([None if x is None else decode([i for i in x if i not in special]) for x in rows], pa.string())

    return run(ids)


def unmasked(ids: Column, key: str) -> Column:
    """ids with the padding piece in place of what is ignored in training."""
    return F.transform(ids, lambda i: F.when(i == IGNORED, F.lit(vocabulary(key).pad)).otherwise(i))


def padded(ids: Column, length: Column, pad: int) -> Column:
    """ids filled up with pad on the right to length; longer ones stay."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(ids))))


def collate(df: DataFrame, key: str, size: int, columns: dict[str, int], seed: str = "42") -> DataFrame:
    """df (unique key) in batches of size rows, in hash order: batch, and every array of columns (name -> what fills it up) as
    long as its longest in the batch. A batch is a window of size rows, never more; null arrays stay null."""
    n = df.count()
    if not n:
        return df.withColumn("batch", F.lit(0).cast("long"))
    ranked = prefix_sums(df.withColumn("_h", hash_key(key, seed=seed)).withColumn("_all", F.lit(0)), ["_all"], "_h", [key], F.lit(1), n, out="_place")
    batch = ranked.withColumn("batch", F.floor((F.col("_place") - 1) / F.lit(size)).cast("long"))
    for name, pad in columns.items():
        batch = batch.withColumn(name, padded(F.col(name), F.max(F.size(name)).over(Window.partitionBy("batch")), pad))
    return batch.drop("_h", "_all", "_place")
