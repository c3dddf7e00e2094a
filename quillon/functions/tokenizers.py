"""Subword tokenizers in Arrow batches. Vocabularies are files of public tokenizers, read from a path on every worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public tokenizers; a parameter everywhere.
FOLDER = "/opt/tokenizers"

#: Records whose pieces are held at once.
ROWS = 500


@lru_cache(maxsize=8)
def _model(path: str):
    """(ids, pieces, number of pieces) of one text each, by the tokenizer of a file. In the calling thread: a task has one core."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda t: model.encode(t, num_threads=1)), (lambda t: model.encode(t, out_type=str, num_threads=1)), (lambda t: len(model.encode(t, num_threads=1)))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    encode = lambda t: model.encode(t, add_special_tokens=False)
    return (lambda t: encode(t).ids), (lambda t: encode(t).tokens), (lambda t: len(encode(t)))


def text_ids(path: str):
    """ids(text) -> list of ids. One text at a time: what a tokenizer holds of a text is a hundred times an id's size."""
    return _model(path)[0]


def text_pieces(path: str):
    """pieces(text) -> list of pieces."""
    return _model(path)[1]


def text_length(path: str):
    """length(text) -> number of pieces, without a list of them."""
    return _model(path)[2]


@lru_cache(maxsize=8)
def decoder(path: str):
    """decode(list of ids) -> text."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).decode
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda ids: model.decode(ids, skip_special_tokens=False)


def token_pieces(col: Column | str, path: str) -> Column:
    """struct<n:int,pieces:array<string>> of each text without special tokens; null for a null text."""

    @F.pandas_udf("struct<n:int,pieces:array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = text_pieces(path)
        for texts in batches:
            rows = [None if t is None else pieces(t) for t in texts]
            yield pd.DataFrame({"n": pd.Series([None if r is None else len(r) for r in rows], dtype="Int32"), "pieces": rows})

    return run(col)


def token_length(col: Column | str, path: str) -> Column:
    """Number of pieces of each text without special tokens; null for a null text."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        length = text_length(path)
        for texts in batches:
            yield pd.Series([None if t is None else length(t) for t in texts], dtype="Int32")

    return run(col)


def word_pieces(tokens: Column | str, path: str, limit: int | None = None) -> Column:
    """array<struct<piece:string,word:int>> of a list of words; each word is encoded for itself, with the blank before it
    that the vocabulary expects. All pieces, unless limit names the most that a model takes. Null for null tokens."""

    @F.arrow_udf("array<struct<piece:string,word:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces_of = text_pieces(path)
        known: dict[str, list[str]] = {}
        for batch in batches:
            for at in range(0, max(len(batch), 1), ROWS):  # long records: the pieces of a whole batch would fill the worker
                lists = batch.slice(at, ROWS).to_pylist()
                if len(known) > 500_000:
                    known.clear()
                for w in {w for ws in lists if ws is not None for w in ws if w is not None and w not in known}:
                    known[w] = pieces_of(" " + w)
                pieces, words, ends = [], [], [0]
                for ws in lists:
                    for i, w in enumerate(ws or ()):
                        if w is not None:
                            pieces += known[w]
                            words += [i] * len(known[w])
                    if limit is not None:
                        del pieces[ends[-1] + limit :], words[ends[-1] + limit :]
                    ends.append(len(pieces))
                values = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(words, pa.int32())], names=["piece", "word"])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([ws is None for ws in lists], pa.bool_()))

    return run(tokens)
