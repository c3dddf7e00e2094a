"""Garbled text from wrong character encoding (problem 4): multi-pattern matching of precomputed garbled sequences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.storage import keep, spread

#: Encodings that text is written in, and those it is taken for. Order decides between equal readings.
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437")
TAKEN_FOR = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "iso8859-2", "iso8859-15", "cp1253", "cp866", "koi8-r")
CYRILLIC = ("cp1251", "cp866", "koi8-r")
#: A form that could be a misreading of another one must be so many times rarer than it in the column, and the other must
#: stand so often; a form with characters that cannot stand where they do needs one correct one only.
RARER, PROOF = 5, 3
#: Proved misreadings that travel with every task; more are joined to their rows.
MOST_PROVED = 100_000

OUT = "row_id long, span string, restored string, status string, encodings array<string>, n_replaced int"


def _characters() -> list[str]:
    """Characters that are written outside ASCII: Latin and Greek letters, combining accents, and the signs of running text."""
    letters = [chr(c) for c in (*range(0xC0, 0x180), *range(0x386, 0x3CF)) if chr(c).isalpha()]
    return letters + [chr(c) for c in range(0x300, 0x329)] + list("¡¿«»°ºª±·§µ¢£¥©®¬¹²³¼½¾¨´¸€–—‘’‚“”„†‡•…‰‹›™ �")


def _signs() -> list[str]:
    """What else stands in texts, or comes up where a text was misread more than once: signs, boxes, pictures, controls."""
    return [chr(c) for c in (*range(0x80, 0xC0), 0x192, 0x2C6, 0x2C7, *range(0x2D8, 0x2DE), 0xF8FF, 0xFB01, 0xFB02, *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x2070, 0x20D0), *range(0x2100, 0x2800))]


def _misread(raw: bytes, encoding: str) -> str:
    """raw as shown in a wrong encoding; bytes it does not know stay as control characters."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=1)
def sequences() -> tuple[dict[str, list[tuple[str, str, bool]]], dict[str, dict[tuple[str, str], str]]]:
    """(long, short). long: garbled sequence of two characters or more -> [(original, pair, lost)] for one misreading, deeper
    ones being undone one by one, and (lost) for two if their soft hyphen was lost. short: one character -> {pair: original}."""
    long: dict[str, list[tuple[str, str, bool]]] = {}
    short: dict[str, dict[tuple[str, str], str]] = {}

    def add(garbled: str, original: str, pair: str, lost: bool = False) -> None:
        if (original, pair, lost) not in long.setdefault(garbled, []):
            long[garbled].append((original, pair, lost))

    for wrong in TAKEN_FOR:
        cyrillic = [chr(c) for c in (*range(0x400, 0x460), 0x490, 0x491)] if wrong in CYRILLIC else []  # of deeper layers
        for c in dict.fromkeys([*_characters(), *_signs(), *cyrillic]):
            once = _misread(c.encode("utf-8"), wrong)
            add(once, c, f"utf-8>{wrong}")
            if not once.isupper() and not once.islower() and any(not x.isalpha() for x in once):
                if once.lower() != once and c.lower() != c.upper():
                    add(once.lower(), c.lower(), f"utf-8>{wrong}")
            twice = _misread(once.encode("utf-8"), wrong)
            if "\xad" in twice:
                add(twice.replace("\xad", ""), c, f"utf-8>{wrong}", True)
    for written in WRITTEN[1:]:
        for wrong in TAKEN_FOR:
            if written == wrong:
                continue
            for c in _characters():
                try:
                    garbled = _misread(c.encode(written), wrong)
                except UnicodeEncodeError:
                    continue
                if garbled != c and len(garbled) == 1:
                    short.setdefault(garbled, {}).setdefault((written, wrong), c)
    return {k: v for k, v in long.items() if len(k) > 1}, short


@lru_cache(maxsize=1)
def automaton():
    """All garbled sequences, of one character and more: (sequence, readings of a long one or null)."""
    import ahocorasick

    long, short = sequences()
    out = ahocorasick.Automaton()
    for garbled in short:
        out.add_word(garbled, (garbled, None))
    for garbled, readings in long.items():
        out.add_word(garbled, (garbled, readings))
    out.make_automaton()
    return out


_COMMON = frozenset("'’‘“”\"«»-‐‑‒–—―−/\\.,;:()[]{}%&+*=<>!?¡¿ºª°·•…_#@|~$€£§©®™")
_LOST = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
_USUAL = frozenset("áéíóúñüçãõâêôàèìòùäößåîÁÉÍÓÚÑÜÇÃÕÂÊÔÀÈÌÒÙÄÖÅÎ¿¡«»…–°±ºª")
#: Signs that stand at a word's end or start in any text, but not between two letters; and those between letters of units only.
_OUTER, _BETWEEN = frozenset("°¿¡≤≥≈±×÷→←↑↓"), frozenset("·∙⋅")
#: What the characters of a word are; other ASCII signs and blanks part words.
_BREAKS = r"\x00-/:-@\[-`{-\x7f\xa0\u2000-\u200b\u2028\u2029\u202f\u3000"
_PART = re.compile(f"[^{_BREAKS}]+")
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôû")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def _odd(text: str, i: int) -> bool:
    """Whether the character at i cannot stand where it does in any text of Latin letters.

    Box and block signs and control characters never; other signs not right between letters or next to one where no word
    has them; a capital not after a small letter; a sharp s not after a consonant; a small accented letter not
    after a capital that follows a small one."""
    c = text[i]
    if c < "\x80":
        return False
    if "─" <= c <= "▟" or "\x80" <= c <= "\x9f":
        return True
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if c.isalpha():
        if c == "ß":
            return not before.isalpha() or before.lower() not in _VOWELS
        if c.isupper():
            if text[max(0, i - 2) : i] == "Mc" or text[max(0, i - 3) : i] == "Mac":
                return False
            return before.isalpha() and (after.islower() or before.islower() and not after.isupper())
        return c.islower() and before.isupper() and text[i - 2 : i - 1].islower() and not after.isalpha()
    if c in _BETWEEN:  # units are short
        part = next((m.group() for m in _PART.finditer(text) if m.start() <= i < m.end()), "")
        return after.islower() and sum(x.isalpha() for x in part) > 4 and not (before.lower() == after.lower() == "l")
    if c in _OUTER:
        return before.islower() and after.islower()
    if "⁰" <= c <= "ₜ":  # of formulas
        return False
    if c in "¹²³":
        return after.islower()
    if c in _COMMON or unicodedata.category(c)[0] in "MZ" or c == "\xad":
        return False
    return before.isalpha() or after.isalpha()


def _fits(text: str, i: int, c: str) -> bool:
    """Whether c may stand at i: a letter in the case around it, or a sign where there is no word to break."""
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if c.isalpha():
        if c in "ºª":
            return before.isdigit() or before == "."
        near = [x for x in (before, after) if x.isalpha() and x.isascii()]
        if not near:
            return True
        return any(x.isupper() for x in near) if c.isupper() else any(x.islower() for x in near)
    return not (before.isalpha() and after.isalpha()) or c in "–—’·"


def _readings(part: str) -> dict[str, list[tuple[str, str]]]:
    """What a word may have been before one pair of single-byte encodings garbled it -> those pairs. All that the pair
    knows is read back; what it does not know stays."""
    short, out = sequences()[1], {}
    hits = [end for end, (_, readings) in automaton().iter(part) if readings is None]
    for pair in {p for i in hits for p in short[part[i]]}:
        chars = list(part)
        for i in hits:
            chars[i] = short[part[i]].get(pair, part[i])
        word = "".join(chars)
        if word != part:
            out.setdefault(word, []).append(pair)
    return out


def _rank(pair: tuple[str, str]) -> tuple[int, int]:
    return WRITTEN.index(pair[0]), TAKEN_FOR.index(pair[1])


def _undo_single(text: str, proved: Mapping[str, list[str]]) -> tuple[str, set[str], int, bool]:
    """(text, pairs, replacements, ambiguous): words garbled by one-byte encodings, read back.

    A word is garbled if proved (word -> lower-case originals, best first) knows it or if a character cannot
    stand where it does. One pair for the whole text is sought among those that explain its proved words, or else
    most of the others; a word whose best pairs give different readings is ambiguous and takes the first of them. Words
    beside stay as they are; the text is ambiguous if one of them would be a word by the pair as well."""
    if text.isascii():
        return text, set(), 0, False
    found: list[tuple[int, int, dict[str, list[tuple[str, str]]], bool]] = []
    others: list[tuple[int, str]] = []
    for m in _PART.finditer(text):
        part = m.group()
        if part.isascii():
            continue
        known = proved.get(part)
        odd = [i for i in range(*m.span()) if _odd(text, i)]
        if known:
            fine = {w: p for w, p in _readings(part).items() if w.lower() in known}
            cased = {w: p for w, p in fine.items() if not any(_odd(w, i) for i in range(len(w)))}
            found.append((*m.span(), cased or fine, True))
        elif odd:
            fine = {}
            for word, pairs in _readings(part).items():
                whole = text[: m.start()] + word + text[m.end() :]
                moved = [i for i in odd if word[i - m.start()] != text[i]]
                if moved and all(_fits(text, i, word[i - m.start()]) for i in moved) and not any(_odd(whole, i) for i in moved):
                    fine[word] = pairs
            if fine:
                found.append((*m.span(), fine, False))
        else:
            others.append((m.start(), part))
    votes: dict[tuple[str, str], list[int]] = {}
    for a, b, readings, known in found:
        for word, pairs in readings.items():
            changed = [x for x, y in zip(word, text[a:b], strict=True) if x != y]
            for pair in pairs:
                v = votes.setdefault(pair, [0, 0, 0])
                v[0] += known
                v[1] += len(changed)
                v[2] += sum(x in _USUAL for x in changed)
    out, used, n, unsure, at = [], set(), 0, False, 0
    for a, b, readings, _ in found:
        best = max(votes[p] for pairs in readings.values() for p in pairs)
        top = {w: [p for p in pairs if votes[p] == best] for w, pairs in readings.items()}
        words = sorted((min(map(_rank, pairs)), w) for w, pairs in top.items() if pairs)
        unsure |= len(words) > 1
        word = words[0][1]
        pair = min(top[word], key=_rank)
        out += [text[at:a], word]
        at = b
        used.add(f"{pair[0]}>{pair[1]}")
        n += sum(x != y for x, y in zip(word, text[a:b], strict=True))
    for a, part in others if used else ():
        for word, pairs in _readings(part).items():
            if used & {f"{p[0]}>{p[1]}" for p in pairs}:
                moved = [i for i, (x, y) in enumerate(zip(part, word, strict=True)) if x != y]
                unsure |= all(word[i] in _USUAL and _fits(text, a + i, word[i]) for i in moved)
    return "".join([*out, text[at:]]), used, n, unsure


def _undo_long(text: str) -> tuple[str, set[str], int]:
    """One misreading undone: of the pairs whose garbled sequences stand in the text, the one that explains most of it has
    its sequences replaced, longest first from the left, and nothing else."""
    if text.isascii():
        return text, set(), 0
    hits: dict[str, list[tuple[int, int, str]]] = {}
    matched = [(end - len(g) + 1, end + 1, readings) for end, (g, readings) in automaton().iter(text) if readings is not None]
    if not matched:
        return text, set(), 0
    covered = {i for a, b, _ in matched for i in range(a, b)}
    crossed = {i for a, b, readings in matched for i in range(a + 1, b) if not all(lost for *_, lost in readings)}
    free = {_script(c) for i, c in enumerate(text) if i not in covered and c.isalpha() and c >= "\x80"}
    latin = any(c.isascii() and c.isalpha() or c.isalpha() and _script(c) == "LATIN" for c in text)
    for a, b, readings in matched:
        seq = text[a:b]
        if all(x.isalpha() for x in seq):  # letters of another script are garbled only among Latin ones
            strange = {_script(x) for x in seq} - {"LATIN"}
            if strange & free or strange and not latin:
                continue
        for original, pair, lost in readings:
            if lost and (b in crossed or not (text[b : b + 1].islower() or not text[b : b + 1].isalpha() and text[max(0, a - 1) : a].islower())):
                continue  # a lost soft hyphen, but not inside a word of small letters, or what follows belongs to it
            hits.setdefault(pair, []).append((a, b, original))
    best: tuple[int, str, list[tuple[int, int, str]]] = (0, "", [])
    for pair in sorted(hits, key=lambda p: TAKEN_FOR.index(p.split(">")[1])):
        own, at = [], 0
        for a, b, original in sorted(hits[pair], key=lambda h: (h[0], -h[1])):
            if a >= at:
                own.append((a, b, original))
                at = b
        best = max(best, (sum(b - a for a, b, _ in own), pair, own), key=lambda x: x[0])
    out, at = [], 0
    for a, b, original in best[2]:
        out += [text[at:a], original]
        at = b
    return "".join([*out, text[at:]]), {best[1]} if best[2] else set(), len(best[2])


def _undo_lost(text: str) -> tuple[str, int]:
    """A lone capital A with tilde before a small letter, or after one: its soft hyphen was lost, so it was an i with acute."""
    out, n = list(text), 0
    for i, c in enumerate(text):
        if c == "Ã":
            before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
            if (before.isalpha() and after.islower()) or (before.islower() and not after.isalpha()):
                out[i], n = "í", n + 1
    return "".join(out), n


def repair(text: str, proved: Mapping[str, list[str]] | None = None) -> tuple[str, str | None, list[str], int]:
    """(restored, status, encoding pairs, replacements). status: null (nothing garbled), restored, ambiguous (several pairs
    explain a word as well; restored has the first), or irreparable (replacement characters, or signs of garbling that no
    pair explains; what could be restored is)."""
    now, pairs, n = text, set(), 0
    while True:  # every layer makes the text shorter
        then, found, k = _undo_long(now)
        if not k:
            break
        now, pairs, n = then, pairs | found, n + k
    then, k = _undo_lost(now)
    if k:
        now, pairs, n = then, pairs | {"utf-8>cp1252"}, n + k
    now, found, k, unsure = _undo_single(now, proved or {})
    pairs, n = pairs | found, n + k
    broken = "�" in now or bool(_LOST.search(now)) or any(_odd(now, i) for i in range(len(now)) if now[i] >= "\x80")
    if broken:
        return now, "irreparable", sorted(pairs), n
    return now, ("ambiguous" if unsure else "restored") if n else None, sorted(pairs), n


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (word, n, original, odd) for every reading of the word by a pair of one-byte encodings."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("word", "n", "original", "odd")}
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if _undo_long(word)[2]:
                continue
            odd = any(_odd(word, i) for i in range(len(word)))
            for original in sorted({w.lower() for w in _readings(word)} - {word.lower()}):
                for k, v in zip(out, (word, n, original, odd), strict=True):
                    out[k].append(v)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def parts(col: Column | str) -> Column:
    """The words of a text that hold a character outside ASCII."""
    return F.filter(F.split(col, f"[{_BREAKS}]+"), lambda w: w.rlike(r"[^\x00-\x7F]"))


def proved_misreadings(texts: DataFrame, text: str = "span") -> DataFrame:
    """(word, originals): words of the column that another word of it, much more frequent, turns into when it is misread by a pair
    of one-byte encodings; originals in small letters. What the clean rows hold is the evidence; no word list is used."""
    words = keep(texts.select(F.explode(parts(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    readings = words.mapInArrow(_candidates, "word string, n long, original string, odd boolean")
    right = words.groupBy(F.lower("word").alias("original")).agg(F.sum("n").alias("m"))
    sure = readings.join(right, "original").where(F.col("m") >= F.when(F.col("odd"), F.lit(1)).otherwise(F.greatest(F.lit(PROOF), F.col("n") * RARER)))
    best = sure.groupBy("word").agg(F.max("m").alias("best"), F.collect_list(F.struct((-F.col("m")).alias("m"), "original")).alias("o"))  # at most one for each pair
    return best.select("word", F.transform(F.filter(F.array_sort("o"), lambda x: -x["m"] * RARER >= F.col("best")), lambda x: x["original"]).alias("originals"))


def _run(known: dict[str, list[str]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("row_id", "span", "restored", "status", "encodings", "n_replaced")}
            own = batch.column("proved").to_pylist() if known is None else [None] * batch.num_rows
            for row_id, span, proved in zip(batch.column("row_id").to_pylist(), batch.column("span").to_pylist(), own, strict=True):
                restored, status, pairs, n = repair(span, known if known is not None else {p["word"]: p["originals"] for p in proved or []})
                if status is not None:
                    for k, v in zip(rows, (row_id, span, restored, status, pairs, n), strict=True):
                        rows[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return run


def restore_encoding(df: DataFrame, text: str = "span", most_proved: int = MOST_PROVED) -> DataFrame:
    """Rows of df (row_id, text) that show characters read in a wrong encoding: OUT.

    Garbled forms of every written character are computed for all pairs of encodings and matched with one automaton;
    sequences of two characters or more are replaced wherever they stand, layer by layer until none is left. Where one byte
    became one wrong character, words are read back that the column's own frequent words prove to be misread, and words with a
    character that cannot stand where it does; only those words change. status is restored, ambiguous where several pairs
    explain a word equally well, or irreparable. Rare letters, decomposed accents and literal escapes are left alone. Null and empty
    texts, and rows in ASCII, have no row here; rows that repeat come out each. Up to most_proved misread words travel
    with every task, more are joined to their rows.
    """
    some = df.select(F.col("row_id").cast("long").alias("row_id"), F.col(text).alias("span")).where(F.col("span").rlike(r"[^\x00-\x7F]|\p{L}\?\p{L}"))
    proved = proved_misreadings(some)
    few = proved.limit(most_proved + 1).collect()
    if len(few) <= most_proved:
        return spread(some).mapInArrow(_run({r["word"]: list(r["originals"]) for r in few}), OUT)
    words = some.select("span").distinct().select("span", F.explode(F.array_distinct(parts("span"))).alias("word"))
    own = words.join(proved, "word").groupBy("span").agg(F.collect_list(F.struct("word", "originals")).alias("proved"))  # words of one text
    return some.join(own, "span", "left").select("row_id", "span", "proved").mapInArrow(_run(None), OUT)
