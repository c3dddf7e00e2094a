"""Text expressions: array expressions of the JVM, and words and their offsets in Arrow batches. Offsets are code points everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.batches import counts_of, spans_of

#: One blank and one other character, as Python's \s and \S see them (U+001C to U+001F are blanks there, not in Java).
BLANK = r"(?U:[\s\x1c-\x1f])"
SOLID = r"(?U:[^\s\x1c-\x1f])"


def strip_chunk_suffix(col: Column | str) -> Column:
    """The id without an ending _chunk<digits>; what stands before a last line end is no ending."""
    return F.regexp_replace(col, r"_chunk[0-9]+\z", "")


def words(col: Column | str) -> Column:
    """Longest runs of characters that are not blank, in order. Null stays null; a blank text has none."""
    return F.regexp_extract_all(col, F.lit(f"{SOLID}+"), F.lit(0))


def word_count(col: Column | str) -> Column:
    """Number of words; null for a null text."""
    return F.arrow_udf(counts_of, "int")(col)


def strip(col: Column | str) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, evaluated once. What a lambda captures is evaluated again for every element,
    and merging projections can move any expression into a lambda; a bound variable stays a value."""
    return F.get(F.transform(F.array(value), body), 0)


def word_spans(text: Column | str) -> Column:
    """array<struct<i:int,word:string,start:int,end:int>>: the words of text with half-open offsets, found for a whole
    batch at once. A null text has null words, a blank one none."""
    return F.arrow_udf(spans_of, "array<struct<i:int,word:string,start:int,end:int>>")(text)


def unescape_unicode(col: Column | str) -> Column:
    r"""Literal \uXXXX as the character; anything malformed stays. Two halves of a surrogate pair become one
    character, a half on its own U+FFFD. Null stays null."""
    whole = F.col(col) if isinstance(col, str) else col
    high, low = r"\\u([dD][89abAB][0-9a-fA-F]{2})", r"\\u([dD][c-fC-F][0-9a-fA-F]{2})"
    # A pair is marked first, so that both halves are decoded together; what is left of the surrogates has no partner.
    paired = F.regexp_replace(whole, high + low, "\\\\u{$1$2}")
    single = F.regexp_replace(paired, r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}", "\ufffd")
    parts = F.split(single, r"(?=\\u\{[dD][89abAB][0-9a-fA-F]{2}[dD][c-fC-F][0-9a-fA-F]{2}\})|(?=\\u[0-9a-fA-F]{4})")

    def one(p: Column) -> Column:
        pair, char = p.rlike(r"^\\u\{[dD][89abAB][0-9a-fA-F]{2}[dD][c-fC-F][0-9a-fA-F]{2}\}"), p.rlike(r"^\\u[0-9a-fA-F]{4}")
        return (
            F.when(pair, F.concat(F.decode(F.unhex(F.substring(p, 4, 8)), "UTF-16BE"), p.substr(F.lit(13), F.length(p))))
            .when(char, F.concat(F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"), p.substr(F.lit(7), F.length(p)))).otherwise(p)
        )

    return F.when(whole.contains("\\u"), F.array_join(F.transform(parts, one), "")).otherwise(whole)
