"""Words, tags and names of whole Arrow batches at once.

A batch's texts are one buffer of bytes: blanks, word edges, code-point offsets and the words under an entity are found by
array operations over it, without a step for each word. Array expressions of the JVM do the same element by element,
interpreted, at several times the CPU seconds (README); everything that is cheap there stays there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = pa.struct([("i", pa.int32()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
CUT = pa.struct([("chunk_no", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
#: Blank bytes of ASCII, and the blanks of two and three bytes, as Python's \s sees them.
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

#: Bytes of texts whose words are counted at once; the arrays over them take some thirty times as many.
LOT = 1 << 20


def _lots(texts: pa.Array) -> list[pa.Array]:
    """texts in slices of LOT bytes and a text at most; one at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // LOT)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def _blank(raw: np.ndarray) -> np.ndarray:
    out = _ASCII[raw]
    for first in {w[0] for w in _WIDE}:
        at = np.flatnonzero(raw == first)
        if len(at):
            for wide in (w for w in _WIDE if w[0] == first):
                hit = at
                for k in range(1, len(wide)):
                    hit = hit[raw[np.minimum(hit + k, len(raw) - 1)] == wide[k]]
                for k in range(len(wide)):
                    out[hit + k] = True
    return out


class Words:
    """Words of a batch of texts: lists (offsets by text), starts and ends in code points from the batch's beginning, and base,
    the code points before each text."""

    def __init__(self, texts: pa.Array) -> None:
        self.null = texts.is_null().to_numpy(zero_copy_only=False)
        raw, at = _bytes(texts)
        solid = ~_blank(raw)
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        open_ = solid & (edge[:-1] | np.append(True, ~solid[:-1])[: len(raw)])
        close = solid & (edge[1:] | np.append(~solid[1:], True)[: len(raw)])
        first, last = np.flatnonzero(open_), np.flatnonzero(close) + 1
        self.lists = np.searchsorted(first, at).astype(np.int32)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.starts, self.ends, self.base = points[first], points[last], points[at]
        self._sizes, self._data = last - first, raw[solid]

    def counts(self) -> pa.Array:
        return pa.array(np.diff(self.lists), pa.int32(), mask=self.null)

    def strings(self) -> pa.StringArray:
        offsets = np.concatenate([[0], np.cumsum(self._sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(self._sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self._data.tobytes()))

    def _row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lists) - 1), np.diff(self.lists))

    def listed(self, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.lists), values, mask=pa.array(self.null))

    def spans(self) -> pa.ListArray:
        row = self._row()
        columns = [np.arange(len(row)) - self.lists[row], None, self.starts - self.base[row], self.ends - self.base[row]]
        arrays = [self.strings() if c is None else pa.array(c.astype(np.int32)) for c in columns]
        return self.listed(pa.StructArray.from_arrays(arrays, fields=list(WORD)))

    def cuts(self, window: int, overlap: int) -> pa.ListArray:
        """Windows of each text: at most `window` words are one chunk with the outer blanks and no number, else chunk k has
        the words from k x (window - overlap)."""
        n, step = np.diff(self.lists).astype(np.int64), window - overlap
        whole = n <= window
        many = np.where(whole, 1, -(-(n - window) // step) + 1)
        row = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        size = np.where(whole[row], n[row], np.minimum(window, n[row] - k * step))
        at = self.lists[row] + k * step
        full = whole[row]
        pad = np.append(self.starts, 0), np.append(self.ends, 0)
        start = np.where(full, 0, pad[0][np.where(full, 0, at)] - self.base[row])
        end = np.where(full, self.base[row + 1] - self.base[row], pad[1][np.where(full, 0, at + size - 1)] - self.base[row])
        columns = [pa.array(k.astype(np.int32), mask=full), *(pa.array(c.astype(np.int32)) for c in (np.where(full, 0, k * step), size, start, end))]
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(CUT)), mask=pa.array(self.null))

    def fours(self) -> pa.Array:
        """Pieces of at most four characters that each text's words make."""
        sums = np.concatenate([[0], np.cumsum(-(-(self.ends - self.starts) // 4))])
        return pa.array(np.diff(sums[self.lists]).astype(np.int32), mask=self.null)

    def tags(self, entities: pa.Array, name: str) -> pa.ListArray:
        """One tag a word: B for the first word an entity overlaps, I for its others, the later entity winning."""
        row, start, end = _offsets(entities)
        lo, hi = self.lists[row], self.lists[row + 1]
        first = np.clip(np.searchsorted(self.ends, self.base[row] + start, "right"), lo, hi)
        stop = np.clip(np.searchsorted(self.starts, self.base[row] + end, "left"), lo, hi)
        n = np.maximum(stop - first, 0)
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tags = np.zeros(len(self.starts), np.int8)
        tags[at] = np.where(at == np.repeat(first, n), 1, 2)  # where places repeat the last one stays
        return self.listed(pa.DictionaryArray.from_arrays(pa.array(tags), pa.array(["O", f"B-{name}", f"I-{name}"])).cast(pa.string()))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(entities: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the entities that have both offsets, in order."""
    flat = entities.flatten()
    row = np.repeat(np.arange(len(entities)), _lengths(entities))
    start, end = (pc.struct_field(flat, [flat.type.get_field_index(c)]) for c in ("start", "end"))
    some = pc.and_(start.is_valid(), end.is_valid()).to_numpy(zero_copy_only=False)
    return row[some], *(c.filter(pa.array(some)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (start, end))


class _Spans(Words):
    """Words that come as lists of structs."""

    def __init__(self, words: pa.Array) -> None:
        self.null = words.is_null().to_numpy(zero_copy_only=False)
        n = _lengths(words)
        self.lists = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        flat = words.flatten()
        start, end = (pc.struct_field(flat, [flat.type.get_field_index(c)]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
        longest = np.zeros(len(n), np.int64)
        longest[n > 0] = end[self.lists[1:][n > 0] - 1]
        self.base = np.concatenate([[0], np.cumsum(longest)])
        row = self._row()
        self.starts, self.ends = start + self.base[row], end + self.base[row]


def decoded(tokens: pa.Array, tags: pa.Array) -> pa.ListArray:
    """Names that tags mark in tokens, in small letters, each once, in order: B opens one, I goes on with an open one."""
    null = pc.or_(tokens.is_null(), tags.is_null()).to_numpy(zero_copy_only=False)
    one, two = _lengths(tokens), _lengths(tags)
    n = np.where(null, 0, np.minimum(one, two))
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(one) - one, n) + within
    marks = tags.flatten().take(pa.array(np.repeat(np.cumsum(two) - two, n) + within))
    begins, goes_on = (pc.fill_null(pc.starts_with(marks, c), False).to_numpy(zero_copy_only=False) for c in ("B", "I"))
    stops = np.append(np.flatnonzero(~goes_on | (within == 0)), len(within))
    first = np.flatnonzero(begins)
    last = stops[np.searchsorted(stops, first, "right")]
    size = last - first
    inside = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words = tokens.flatten().take(pa.array(at[inside])).to_pylist()
    row = np.repeat(np.arange(len(n)), n)[first].tolist()
    names: list[dict[str, None]] = [{} for _ in range(len(n))]
    k = 0
    for r, s in zip(row, size.tolist(), strict=True):
        name = " ".join(w for w in words[k : k + s] if w is not None).strip().lower()
        k += s
        if name:
            names[r][name] = None
    ends = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([v for x in names for v in x], pa.string()), mask=pa.array(null))


def aligned(word_ids: pa.Array, tags: pa.Array, labels: tuple[str, ...], ignored: int) -> pa.ListArray:
    """Labels of pieces: ignored without a word, the word's tag for its first piece, for the others that tag as I."""
    null = pc.or_(word_ids.is_null(), tags.is_null()).to_numpy(zero_copy_only=False)
    n, m = _lengths(word_ids), _lengths(tags)
    row = np.repeat(np.arange(len(n)), n)
    word = pc.fill_null(word_ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = (word >= 0) & (word < m[row])
    marks = tags.flatten()
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    codes, within = (pc.fill_null(pc.index_in(x, pa.array(labels, pa.string())), -1).to_numpy(zero_copy_only=False) for x in (marks, pc.replace_substring_regex(marks, "^B-", "I-")))
    at = (np.cumsum(m) - m)[row][known] + word[known]
    out = np.where(word < 0, ignored, -1)
    out[known] = np.where(same[known], within[at], codes[at])
    some = ~null[row]
    ends = np.concatenate([[0], np.cumsum(np.where(null, 0, n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out[some].astype(np.int32)), mask=pa.array(null))


def aligned_of(labels: tuple[str, ...], ignored: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for word_ids, tags in batches:
            yield aligned(word_ids, tags, labels, ignored)

    return run


def spans_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield Words(texts).spans()


def counts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.concat_arrays([Words(lot).counts() for lot in _lots(texts)])


def fours_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield Words(texts).fours()


def cuts_of(window: int, overlap: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield Words(texts).cuts(window, overlap)

    return run


def tagged(name: str):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, entities in batches:
            words = Words(texts)
            yield pa.StructArray.from_arrays([words.listed(words.strings()), words.tags(entities, name)], names=["tokens", "tags"])

    return run


def tags_of(name: str):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, entities in batches:
            yield _Spans(words).tags(entities, name)

    return run


def both(one: pa.ListArray, two: pa.ListArray) -> pa.ListArray:
    """Names of two lists a row, each with whether it is of the first."""
    n, m = _lengths(one), _lengths(two)
    ends = np.concatenate([[0], np.cumsum(n + m)])
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], n + m)
    first = within < np.repeat(n, n + m)
    at = np.empty(ends[-1], np.int64)
    at[first], at[~first] = np.arange(n.sum()), n.sum() + np.arange(m.sum())
    names = pa.concat_arrays([one.flatten(), two.flatten()]).take(pa.array(at))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([names, pa.array(first)], names=["entity", "t"]))


def both_of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for tokens, truth, predicted in batches:
        yield both(decoded(tokens, truth), decoded(tokens, predicted))


def names_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for tokens, tags in batches:
        yield decoded(tokens, tags)
