"""Word sequences with case, accents, punctuation and spacing set aside, and distances between them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
# The letter before the hyphen is looked at last, so that the search runs from hyphen to hyphen.
_HYPHEN = re.compile(r"[-\u00ad\u2010](?<=[^\W\d_][-\u00ad\u2010])[ \t]*(?:\r\n?|\n)[ \t]*(?=[^\W\d_])")
_WIDE = re.compile("[^\x00-\x7f]")
#: What is no letter or digit of ASCII becomes a blank.
_BREAKS = {c: " " for c in range(128) if not chr(c).isalnum()}
_CACHE_SIZE = 1_000_000


def plain(text: str) -> str:
    """Lower case without accents (combining marks after decomposition)."""
    return _folded(text, None)


def _folded(text: str, sign: str | None) -> str:
    """plain(text), with other signs than those of ASCII replaced by sign. Few different ones stand in a text, so each is
    replaced everywhere at once."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text)
    for c in set(_WIDE.findall(text)):
        if unicodedata.combining(c):
            text = text.replace(c, "")
        elif sign is not None and not c.isalnum():
            text = text.replace(c, sign)
    return text


def normal_words(text: str | None, markup: bool = False) -> list[str]:
    """Runs of letters and digits of the plain text. With markup, inline tags vanish and words cut by a hyphen
    at a line end are joined first. Null and empty texts have none."""
    if not text:
        return []
    if markup:
        text = _HYPHEN.sub("", _TAG.sub(" ", text) if "<" in text else text)
    bare = _folded(text, " ")
    return bare.translate(_BREAKS).split() if bare.isascii() else _WORD.findall(bare)


class WordIds:
    """32-bit hashes of words, remembered per worker; the memory is emptied when full, which costs time only."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_SIZE:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
            out = list(map(known.get, words))
        return np.array(out, dtype=np.uint32)


def _least(plus: int, minus: int, n: int, column: int, left: int) -> int:
    """The least total that any cell of a column can come to: its own value, and what lengths then still differ by."""
    size = -(-n // 8)
    up, down = (np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), count=n, bitorder="little").view(np.int8) for v in (plus, minus))
    values = column + np.concatenate([[0], np.cumsum(up - down, dtype=np.int32)])
    return int((values + np.abs(np.arange(n, -1, -1) - left)).min())


class Pattern:
    """A word sequence prepared to be held against many others: for every word a number whose bits are its places."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.size = ids, len(ids)
        self.places: dict[int, int] = {}
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        edges = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
        width = -(-self.size // 8)
        for a, b in zip(edges.tolist(), [*edges.tolist()[1:], self.size], strict=True):
            at = order[a:b]
            if b - a <= 4:
                self.places[int(ids[at[0]])] = sum(1 << k for k in at.tolist())
            else:
                raw = np.zeros(width * 8, np.uint8)
                raw[at] = 1
                self.places[int(ids[at[0]])] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")

    def distance(self, b: np.ndarray, limit: int) -> int:
        """Words changed, left out or added to turn this sequence into b, or limit + 1 if there are more than limit.

        One bit-parallel column step per word of b, the places in this sequence being the bits of one integer. Now and then all
        of a column is read: where even its best cell cannot end within the limit, the rest is not needed.
        """
        n, left = self.size, len(b)
        if abs(n - left) > limit:
            return limit + 1
        if not n or not left:
            return min(max(n, left), limit + 1)
        full, places = (1 << n) - 1, self.places
        plus, minus = full, 0
        look = max(48, left // 24)
        for w in b.tolist():
            if left % look == 0 and left < len(b) and _least(plus, minus, n, len(b) - left, left) > limit:
                return limit + 1
            eq = places.get(w, 0)
            side = eq | minus
            zero = ((((eq & plus) + plus) ^ plus) | side) & full
            up = minus | (full ^ (zero | plus))
            down = plus & zero
            up = ((up << 1) | 1) & full
            plus = ((down << 1) & full) | (full ^ (zero | up))
            minus = up & zero
            left -= 1
        return min(len(b) + plus.bit_count() - minus.bit_count(), limit + 1)


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Pattern(a).distance(b, limit), common ends cut off first."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    return Pattern(a).distance(b, limit)
