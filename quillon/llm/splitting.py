"""Splitting oversized items at natural boundaries (problem 3), by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import word_count
from quillon.storage import spread

ENTITY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.string()), ("normalized_term", pa.string())])
PIECE = "row_id long, doc_id string, piece_id string, piece_no int, n_pieces int, text string, n_words int, first_word int, start int, end int, entities array<struct<start:int,end:int,text:string,label:string,normalized_term:string>>, n_lost_entities int"

#: How much a boundary between two words holds its sides apart; the lowest are merged first.
INSIDE, WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH = range(6)

_WORD = re.compile(r"\S+")
_ENDS_SENTENCE = re.compile(r"[.!?…;]['\"”’»)\]]*$")
_ENDS_CLAUSE = re.compile(r"[,;:]['\"”’»)\]]*$")
_STARTS = re.compile(r"^['\"“‘«(\[¿¡]*[^\W_]")
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("dr. dra. sr. sra. p. ej. sd. neo. insuf. infecc. hemorr. fig. vs. aprox. máx. mín. núm. pág. etc. mr. mrs. st. no. e.g. i.e.".split())


def boundary(left: str, gap: str, right: str) -> int:
    """Strength of the boundary between two words with the blanks in gap."""
    breaks = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
    if breaks > 1:
        return PARAGRAPH
    stop = _ENDS_SENTENCE.search(left)
    first = _STARTS.match(right)
    capital = bool(first) and first.group()[-1].isupper()
    if stop and left.lower() not in ABBREVIATIONS and (capital if stop.group()[0] == ";" else breaks or capital or not first or not first.group()[-1].islower()):
        return SENTENCE
    if breaks:
        return LINE
    return CLAUSE if _ENDS_CLAUSE.search(left) else WORD


def place(text: str, entities: list[dict] | None) -> tuple[list[dict], int]:
    """Entities whose offsets hold their text, those with wrong offsets moved to the nearest place that does;
    and how many stand nowhere in the text. An entity without text keeps offsets that lie in the text."""
    out, lost = [], 0
    for e in entities or []:
        if e is None:
            continue
        a, b, words = e["start"], e["end"], e["text"]
        inside = a is not None and b is not None and 0 <= a < b <= len(text)
        if inside and (words is None or text[a:b] == words):
            out.append(e)
            continue
        if not words:
            lost += 1
            continue
        near = a if a is not None else 0
        after, before = text.find(words, max(near, 0)), text.rfind(words, 0, max(near, 0) + len(words))
        spots = [s for s in (after, before) if s >= 0]
        if not spots:
            lost += 1
            continue
        s = min(spots, key=lambda x: (abs(x - near), x))
        out.append({**e, "start": s, "end": s + len(words)})
    return out, lost


def cut_points(text: str, words: list[tuple[int, int]], spans: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(from, core, to) in words for every piece: words from..core repeat the piece before, core..to are new."""
    n = len(words)
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    # One blank after a letter or digit is what most words have between them: no end of anything.
    plain = [text[b - 1].isalnum() and c - b == 1 and text[b] == " " for b, c in zip(ends, starts[1:], strict=False)]
    strength = [WORD if plain[i] else boundary(text[starts[i] : ends[i]], text[ends[i] : starts[i + 1]], text[starts[i + 1] : ends[i + 1]]) for i in range(n - 1)]
    for a, b in spans:  # a boundary lies inside an entity that begins before it and ends after it
        for i in range(max(0, bisect_right(ends, a)), min(n - 1, bisect_left(starts, b) - 1)):
            strength[i] = INSIDE
    room = limit - overlap
    # Atoms: runs without a sentence end or line break in them; a run too long for a piece falls apart into its words.
    atoms, at = [], 0
    for i in range(n):
        if i == n - 1 or strength[i] >= LINE:
            atoms.extend([(at, i + 1)] if i + 1 - at <= room else [(k, k + 1) for k in range(at, i + 1)])
            at = i + 1
    # Merge over the weakest boundary first, from the left where equal, while it fits with the words that repeat.
    end = {a: b for a, b in atoms}
    head = {b: a for a, b in atoms}
    heap = [(strength[b - 1], b) for _, b in atoms[:-1]]
    heapq.heapify(heap)
    while heap:
        _, b = heapq.heappop(heap)
        a, c = head[b], end[b]
        if c - a + (overlap if a else 0) <= limit:
            del end[b], head[b]
            end[a], head[c] = c, a
    cores = sorted(end.items())
    out, last = [], 0
    for a, b in cores:
        first = a
        if a:
            least = max(last + 1, b - limit, 0)
            aim = max(a - overlap, least)
            near = [k for k in range(max(least, aim - overlap // 5), min(a - overlap // 2, aim + overlap // 5) + 1) if strength[k - 1] != INSIDE] if overlap else []
            first = min(near, key=lambda k: (-(strength[k - 1] if strength[k - 1] >= LINE else 0), abs(k - aim), k)) if near else (aim if overlap else a)
        out.append((first, a, b))
        last = first
    return out


def split_text(text: str, entities: list[dict] | None, limit: int, overlap: int) -> tuple[list[dict], int]:
    """Pieces of one text with their own entities, and how many entities stand nowhere or in no piece whole."""
    words = [m.span() for m in _WORD.finditer(text)]
    held, lost = place(text, entities)
    if len(words) <= limit:
        cuts = [(0, 0, len(words))]
    else:
        cuts = cut_points(text, words, [(e["start"], e["end"]) for e in held], limit, overlap)
    pieces, placed = [], set()
    for first, _, to in cuts:
        a, b = (words[first][0], words[to - 1][1]) if len(cuts) > 1 else (0, len(text))
        own = []
        for i, e in enumerate(held):
            if a <= e["start"] and e["end"] <= b:
                own.append({**e, "start": e["start"] - a, "end": e["end"] - a})
                placed.add(i)
        pieces.append({"text": text[a:b], "n_words": to - first, "first_word": first, "start": a, "end": b, "entities": own})
    return pieces, lost + len(held) - len(placed)


def _run(limit: int, overlap: int):
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.string()), ("piece_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("text", pa.string()), ("n_words", pa.int32()), ("first_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("entities", pa.list_(ENTITY)), ("n_lost_entities", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_pylist():
                pieces, lost = split_text(r["text"], r["entities"], limit, overlap)
                for k, p in enumerate(pieces):
                    piece_id = None if r["doc_id"] is None else f"{r['doc_id']}_chunk{k}"
                    rows.append({"row_id": r["row_id"], "doc_id": r["doc_id"], "piece_id": piece_id, "piece_no": k, "n_pieces": len(pieces), **p, "n_lost_entities": lost})
                    size += len(p["text"])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def split_oversized(df: DataFrame, limit: int = 246, overlap: int = 50) -> DataFrame:
    """Records of df (row_id, doc_id, text, entities, ...) with more than limit words, in pieces: PIECE.

    A word is a longest run of characters that are not blank. A piece has at most limit words, the repeated ones
    counted, and begins about overlap words (within a fifth) before its own part: at a sentence or line where one is that near,
    else at a word outside entities. Own parts are grown from sentences, lines and paragraphs by merging
    over the weakest boundary first; a sentence too long for a piece is cut at clauses, then at words, and inside
    an entity only when the entity itself is too long. Offsets are code points, half open, into the piece; an
    entity with wrong offsets is moved to its nearest occurrence; n_lost_entities counts those of the record that
    occur nowhere or fit no piece whole. A piece's text is the record's between its first and last word, so the
    own parts with the gaps between them give the record back. Records within the limit, null and blank texts
    have no pieces; null entities are none; rows that repeat are split each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = "array<struct<start:int,end:int,text:string,label:string,normalized_term:string>>"
    large = df.where(word_count("text") > limit).select("row_id", "doc_id", "text", F.col("entities").cast(kind).alias("entities"))
    return spread(large).mapInArrow(_run(limit, overlap), PIECE)
