"""Evaluation texts leaking into training text (problem 6): SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.normal import WordIds, normal_words
from quillon.storage import keep, spread

#: Words of the shortest passage that counts, and of every fingerprinted window. Items are longer, but a passage may be as
#: short as this, so windows of an item's own length would miss quotations of a part.
PASSAGE = 20
#: One word in so many may be changed, left out or added.
ONE_IN = 7
#: Every passage holds a run of so many unchanged words: 21 words with 3 edits leave 18 in 4 runs, 35 with 5 leave 30 in 6.
RUN = 5
#: Of L words with L // 7 edits, each of which breaks three threes of neighbours, at least L - 2 - 3 (L // 7) threes are left, 10 of
#: 21 words; the fuller one of the windows at both ends of a passage has half of them or more.
THREES = 6
BITS, BLOCKS = 64, 4
#: Hamming radius within which every pair of fingerprints is found.
RADIUS = 15
#: Independent fingerprints of a window; a candidate lies within RADIUS by one of them at least.
PRINTS = 2
#: Word hashes share so many counters of document frequencies, a table of fixed size however large the vocabulary.
BUCKETS = 1 << 20
#: Bits of the filter by which texts are searched for runs of items, if these are too many for one task (16 MB).
FILTER_BITS = 1 << 27
#: Runs of items that one task looks for; beyond it runs are shared out among tasks. Item windows that are indexed at once (about 20 kB each).
RUNS_PER_TASK, WINDOWS_AT_ONCE = 6_000, 4_000
#: Places of runs in texts that one task should hold at most.
PLACES_PER_TASK, MOST_BUCKETS = 50_000, 1 << 18
#: Share of an item window's weighted shingles that a candidate must have: each of up to five edits breaks three of about
#: forty, words pushed out of the window as many, and a word weighs at most twice another. The best window of the worst of
#: 3,000 passages with as many edits as allowed, a third of them on the heaviest words, had 0.67.
LEAST_SIMILAR = 0.5

LEAK = "item_id long, doc_id long, first_word int, n_words int, edits int, covered double, similarity double"


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signs(ids: np.ndarray) -> np.ndarray:
    """BITS x PRINTS signs (+1, -1) for each word id, by a mixing of its bits."""
    seeds = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = _mixed(ids.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + seeds)
    bits = np.unpackbits(h.view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def runs_of(ids: np.ndarray, size: int = RUN) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            h = (h ^ ids[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


@dataclass(frozen=True)
class Weights:
    """Weights of words by bucket of their hash, 16 to 32: inverse document frequency, damped so that no word outweighs
    two others. Words of no item weigh nothing anywhere."""

    buckets: bytes
    values: bytes

    @staticmethod
    def of(counts: list[tuple[int, int]], n_docs: int) -> Weights:
        at = np.array([b for b, _ in counts], np.int32)
        n = np.array([c for _, c in counts], np.float64)
        rare = 1 - np.log1p(n) / np.log1p(max(n_docs, 1))
        return Weights(at.tobytes(), np.clip(16 + 16 * rare, 16, 32).astype(np.int32).tobytes())

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int32)
        out[np.frombuffer(self.buckets, np.int32)] = np.frombuffer(self.values, np.int32)
        return out


@lru_cache(maxsize=2)
def _table(weights: Weights) -> np.ndarray:
    return weights.table()


def fingerprints(ids: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(len(starts), PRINTS) SimHashes of the windows of PASSAGE words from the given (ascending) starts."""
    # Only words of a wanted window are summed up; a window's words stay side by side.
    edges = np.bincount(starts, minlength=len(ids) + 1)[: len(ids) + 1] - np.bincount(starts + PASSAGE, minlength=len(ids) + 1)[: len(ids) + 1]
    covered = np.flatnonzero(np.cumsum(edges)[:-1])
    first = np.searchsorted(covered, starts)
    words, back = np.unique(ids[covered], return_inverse=True)
    sums = np.zeros((len(covered) + 1, BITS * PRINTS), np.int32)
    np.cumsum((_signs(words) * weight[words & np.uint32(BUCKETS - 1)][:, None])[back], axis=0, out=sums[1:])
    bits = sums[first + PASSAGE] - sums[first] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


@lru_cache(maxsize=1)
def _masks() -> np.ndarray:
    width = BITS // BLOCKS
    return np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)], np.uint16)


class Blocks:
    """One fingerprint of many windows, and for each of the BLOCKS blocks of its bits a table from a value to the windows
    whose block is within RADIUS // BLOCKS of it. Two fingerprints within RADIUS differ by no more than that in at
    least one block, so looking up every block finds every such pair."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints, self.tables, width = prints, [], BITS // BLOCKS
        masks = _masks()
        for b in range(BLOCKS):
            own = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.uint16)
            values, back = np.unique(own, return_inverse=True)
            order = np.argsort(back, kind="stable").astype(np.int32)
            size = np.bincount(back, minlength=len(values))
            near = (values[:, None] ^ masks[None, :]).ravel()
            of = np.repeat(np.arange(len(values), dtype=np.int32), len(masks))
            by = np.argsort(near, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << width))])
            self.tables.append((at, of[by], order, np.concatenate([[0], np.cumsum(size)])))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, window) of all pairs within RADIUS."""
        width, one, two = BITS // BLOCKS, [], []
        for b, (at, of, order, own) in enumerate(self.tables):
            v = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            i, j = _spread(at[v], at[v + 1])
            values = of[j]
            k, w = _spread(own[values], own[values + 1])
            i, w = i[k], order[w]
            hit = np.bitwise_count(prints[i] ^ self.prints[w]) <= RADIUS
            one.append(i[hit])
            two.append(w[hit])
        return np.concatenate(one), np.concatenate(two)


class Runs:
    """Tells which runs may be an item's: a bit for each of their hashes, and the hashes themselves where given."""

    def __init__(self, bits: np.ndarray, exact: np.ndarray | None = None) -> None:
        self.bits, self.exact, self.mask = bits, exact, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def of(hashes: np.ndarray) -> Runs:
        size = 1 << 20
        while size < 16 * len(hashes):
            size *= 2
        at = np.unique(hashes & np.uint64(size - 1)).astype(np.int64)
        bits = np.zeros(size // 8, np.uint8)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return Runs(bits, hashes)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        some = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        if self.exact is not None and len(some):
            some = some[np.isin(hashes[some], self.exact)]
        return some


class Index:
    """Windows of word sequences (owners) from the given starts, their fingerprints and weighted shingles."""

    def __init__(self, seqs: list[np.ndarray], owner: np.ndarray, start: np.ndarray, weight: np.ndarray) -> None:
        self.seqs, self.owner, self.start, self.weight = seqs, owner, start, weight
        self.words = np.array([seqs[k][s : s + PASSAGE] for k, s in zip(owner.tolist(), start.tolist(), strict=True)], np.uint32).reshape(-1, PASSAGE)
        flat = fingerprints(self.words.ravel(), weight, np.arange(len(self.words)) * PASSAGE) if len(self.words) else np.empty((0, PRINTS), np.uint64)
        self.prints = [Blocks(np.ascontiguousarray(flat[:, p])) for p in range(PRINTS)]
        self.shingles = [(x, _turns(x), self._weights(x)) for x in (self.words.astype(np.uint64), _pairs(self.words))]
        self.whole = np.maximum(sum(w.sum(axis=1) for _, _, w in self.shingles), 1)
        self.threes = Runs.of(np.unique(np.concatenate([np.empty(0, np.uint64), *(runs_of(s, 3) for s in seqs)])))

    def _weights(self, shingles: np.ndarray) -> np.ndarray:
        own = self.weight[self.words & np.uint32(BUCKETS - 1)]
        return own if shingles.shape[1] == PASSAGE else (own[:, 1:] + own[:, :-1]) / 2

    @staticmethod
    def whole_items(seqs: list[np.ndarray], weight: np.ndarray) -> Index:
        owner = np.repeat(np.arange(len(seqs)), [len(s) - PASSAGE + 1 for s in seqs])
        start = np.concatenate([np.arange(len(s) - PASSAGE + 1) for s in seqs]) if seqs else np.empty(0, int)
        return Index(seqs, owner, start, weight)

    def similarity(self, words: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Weighted share of the shingles (words, and pairs of neighbours at their words' mean weight) of each item
        window that stand, as often, in the words (a row of PASSAGE) beside it."""
        out = np.empty(len(windows))
        for a in range(0, len(windows), 2_000):
            w = windows[a : a + 2_000]
            got = np.zeros(len(w))
            for have, (own, turn, weight) in zip((words[a : a + 2_000].astype(np.uint64), _pairs(words[a : a + 2_000])), self.shingles, strict=True):
                times = (have[:, :, None] == own[w][:, None, :]).sum(axis=1)
                got += (weight[w] * (times > turn[w])).sum(axis=1)
            out[a : a + 2_000] = got / self.whole[w]
        return out

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, window, similarity) for the windows of ids from starts that are near a window of the index, of those with
        at least THREES runs of three words of an owner."""
        if len(starts):
            known = np.zeros(len(ids) + 1, np.int32)
            known[self.threes.hits(runs_of(ids, 3)) + 1] = 1
            known = np.cumsum(known)
            starts = starts[known[starts + PASSAGE - 2] - known[starts] >= THREES]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(starts) and len(self.words):
            prints = fingerprints(ids, self.weight, starts)
            for a in range(0, len(starts), 2_000):
                found = [blocks.near(np.ascontiguousarray(prints[a : a + 2_000, p])) for p, blocks in enumerate(self.prints)]
                i, w = (np.concatenate(x) for x in zip(*found, strict=True))
                pair = np.unique(i.astype(np.int64) * len(self.words) + w)
                i, w = starts[a + pair // len(self.words)], pair % len(self.words)
                similar = self.similarity(ids[i[:, None] + np.arange(PASSAGE)], w)
                fine = similar >= LEAST_SIMILAR
                out.append((i[fine], w[fine], similar[fine]))
        if not out:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pairs(words: np.ndarray) -> np.ndarray:
    return (words[:, :-1].astype(np.uint64) << np.uint64(32)) | words[:, 1:].astype(np.uint64)


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges a[k]..b[k]: the k and the members of all of them."""
    n = b - a
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + a[k]


def _turns(rows: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value in its row."""
    same = rows[:, :, None] == rows[:, None, :]
    return np.tril(same, -1).sum(axis=2)


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges a[k]..b[k]: the k and the members of all of them."""
    n = b - a
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + a[k]


def passages(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item start, words, edits, last text word) for each start of the item: its longest stretch of PASSAGE to
    2 x PASSAGE - 1 words that stands in the text with at most one word in ONE_IN changed, left out or added, the
    first and last words being the same. A longer passage always holds one of such a length."""
    n, m = len(item), len(text)
    starts = n - PASSAGE + 1
    if starts < 1 or m < PASSAGE - PASSAGE // ONE_IN:
        return []
    far, most = 10_000, (2 * PASSAGE - 1) // ONE_IN
    same = item[:, None] == text[None, :]
    own = np.arange(starts)
    row = np.where(same[:starts], 0, far)
    step = np.arange(m)
    best: dict[int, tuple[int, int, int]] = {}
    for length in range(2, min(2 * PASSAGE, n + 1)):
        alive = own <= n - length
        if length % 4 == 0:  # edits only grow with the length
            alive &= row.min(axis=1) <= most
        if not alive.all():
            own, row = own[alive], row[alive]
            if not len(own):
                break
        before = np.full(row.shape, far)
        before[:, 1:] = row[:, :-1]
        match = np.where(same[own + length - 1], before, far)
        now = np.minimum(np.minimum(match, before + 1), row + 1)
        row = np.minimum.accumulate(now - step, axis=1) + step
        if length >= PASSAGE:
            fine = match <= length // ONE_IN
            for k in np.flatnonzero(fine.any(axis=1)):
                e = int(match[k].argmin())
                best[int(own[k])] = (length, int(match[k, e]), e)
    return [(s, *v) for s, v in sorted(best.items())]


def _slices(batch: pa.RecordBatch, size: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, row, place in row) of the rows, joined up to size words; longer rows in slices that overlap by a window."""
    parts, rows, places, n = [], [], [], 0
    for i, raw in enumerate(batch.column("seq")):
        seq = np.frombuffer(raw.as_buffer(), np.uint32)
        for a in range(0, max(1, len(seq) - PASSAGE + 1), size):
            part = seq[a : a + size + PASSAGE - 1]
            if len(part) < PASSAGE:
                continue
            parts.append(part)
            rows.append(np.full(len(part), i))
            places.append(np.arange(a, a + len(part)))
            n += len(part)
            if n >= size:
                yield np.concatenate(parts), np.concatenate(rows), np.concatenate(places)
                parts, rows, places, n = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(rows), np.concatenate(places)


def _words(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            seqs = [ids(normal_words(t, markup=True)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column(name), pa.array(seqs, pa.binary())], names=["row", name, "seq"])

    return run


def _ids(batch: pa.RecordBatch | pa.Table, name: str = "seq") -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint32) for v in batch.column(name).to_pylist()]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = np.unique(np.concatenate([np.empty(0, np.uint32), *_ids(batch)]) & np.uint32(BUCKETS - 1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32))], names=["bucket"])


def _frequencies(wanted: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BUCKETS, bool)
        own[np.frombuffer(wanted, np.int32)] = True
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for seq in batch.column("seq"):
                at = np.frombuffer(seq.as_buffer(), np.uint32) & np.uint32(BUCKETS - 1)
                counts[np.unique(at[own[at]])] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    return run


def _around(hits: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Starts of windows that lie in one row and hold a run that begins at one of hits."""
    edges = np.zeros(len(row) + 1, np.int32)
    np.add.at(edges, np.maximum(hits - (PASSAGE - RUN), 0), 1)
    np.add.at(edges, hits + 1, -1)
    n = len(row) - PASSAGE + 1
    some = np.flatnonzero(np.cumsum(edges)[:n] > 0)
    return some[(row[some] == row[some + PASSAGE - 1]) & (place[some + PASSAGE - 1] - place[some] == PASSAGE - 1)]


@dataclass(frozen=True)
class Items:
    """Items few enough for one task: ids and word ids."""

    ids: tuple[int, ...]
    seqs: tuple[bytes, ...]


@lru_cache(maxsize=2)
def _index(items: Items, weights: Weights) -> tuple[Index, Runs]:
    seqs = [np.frombuffer(s, np.uint32) for s in items.seqs]
    return Index.whole_items(seqs, _table(weights)), Runs.of(np.unique(np.concatenate([np.empty(0, np.uint64), *map(runs_of, seqs)])))


def _find(items: Items, weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, runs = _index(items, weights)
        for batch in batches:
            spots: dict[tuple[int, int], list[tuple[int, float]]] = {}
            for ids, row, place in _slices(batch):
                starts = _around(runs.hits(runs_of(ids)), row, place)
                for s, w, x in zip(*(v.tolist() for v in index.candidates(ids, starts)), strict=True):
                    spots.setdefault((int(row[s]), int(index.owner[w])), []).append((int(place[s]), x))
            out = {c: [] for c in ("item_id", "doc_id", "first_word", "n_words", "edits", "covered", "similarity")}
            ids = batch.column("doc_id").to_pylist()
            for (i, k), found in sorted(spots.items()):
                hit = _verified(index.seqs[k], np.frombuffer(batch.column("seq")[i].as_buffer(), np.uint32), found)
                if hit:
                    for c, v in zip(out, (items.ids[k], ids[i], *hit), strict=True):
                        out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _verified(item: np.ndarray, text: np.ndarray, found: list[tuple[int, float]]) -> tuple[int, int, int, float, float] | None:
    """The longest proved stretch around the candidate windows: (first word, words, edits, share of the item covered, similarity)."""
    regions: list[list[int]] = []
    for p, _ in sorted(found):
        if regions and p - regions[-1][1] <= 2 * PASSAGE:
            regions[-1][1] = p + PASSAGE
        else:
            regions.append([p, p + PASSAGE])
    hits, covered = [], np.zeros(len(item), bool)
    for a, b in regions:
        a, b = max(0, a - 2 * PASSAGE), b + 2 * PASSAGE
        for at in range(a, max(a + 1, b - 2 * PASSAGE), 2_000):  # slices overlap by more than a stretch with its edits
            for s, length, edits, end in passages(item, text[at : min(b, at + 2_000 + 3 * PASSAGE)]):
                hits.append((length, -edits, -(at + end)))
                covered[s : s + length] = True
    if not hits:
        return None
    length, edits, end = max(hits)
    return max(0, -end - length + 1), length, -edits, float(covered.mean()), max(x for _, x in found)


#: Words kept on each side of a run: what a stretch of the item, or of a text with its edits, that holds the run can reach.
ITEM_SIDE, TEXT_SIDE = 2 * PASSAGE, 2 * PASSAGE + PASSAGE // 2
PLACES = "bucket int, run long, row long, id long, at int, n int, seq binary"


def _places(name: str, side: int, buckets: int, filter_bits: bytes | None, least: int):
    """Runs of the rows (those in the filter) with the words around them, by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(np.frombuffer(filter_bits, np.uint8)) if filter_bits is not None else None
        for batch in batches:
            out = {c: [] for c in ("bucket", "run", "row", "id", "at", "n", "seq")}
            for row, own, seq in zip(batch.column("row").to_pylist(), batch.column(name).to_pylist(), _ids(batch), strict=True):
                if len(seq) < least:
                    continue
                hashes = runs_of(seq)
                for p in (range(len(hashes)) if runs is None else runs.hits(hashes).tolist()):
                    a = max(0, p - side)
                    for c, v in zip(out, (int(hashes[p] % np.uint64(buckets)), int(hashes[p].view(np.int64)), row, own, p, len(seq), seq[a : p + RUN + side].tobytes()), strict=True):
                        out[c].append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


STRETCH = "item_row long, item_id long, item_words int, doc_row long, doc_id long, start int, n_words int, edits int, last_word int, similarity double"


def _held(weights: Weights):
    """Places of runs in items against places of the same runs in texts: candidates among windows that hold the run, and proved stretches."""

    def run(key: tuple, items: pa.Table, texts: pa.Table) -> pa.Table:
        out = {c: [] for c in ("item_row", "item_id", "item_words", "doc_row", "doc_id", "start", "n_words", "edits", "last_word", "similarity")}
        if items.num_rows and texts.num_rows:
            items, texts = items.sort_by("run"), texts.sort_by("run")
            one, two = (t.drop_columns("seq").to_pydict() for t in (items, texts))
            own, others = _ids(items), _ids(texts)
            known = np.array(two["run"])
            step = WINDOWS_AT_ONCE // (PASSAGE - RUN + 1)
            for a in range(0, len(own), step):
                lot = range(a, min(a + step, len(own)))
                lo, hi = np.searchsorted(known, [one["run"][lot[0]]]), np.searchsorted(known, [one["run"][lot[-1]]], "right")
                if lo[0] == hi[0]:
                    continue
                spans = [(k, s) for k in lot for s in _holding(one["at"][k], ITEM_SIDE, len(own[k]))]
                index = Index([own[k] for k in lot], np.array([k - a for k, _ in spans], int), np.array([s for _, s in spans], int), _table(weights))
                for j in range(int(lo[0]), int(hi[0])):
                    text = others[j]
                    best: dict[int, float] = {}
                    for _, w, x in zip(*(v.tolist() for v in index.candidates(text, np.array(_holding(two["at"][j], TEXT_SIDE, len(text)), int))), strict=True):
                        k = a + int(index.owner[w])
                        if one["run"][k] == two["run"][j]:
                            best[k] = max(x, best.get(k, 0.0))
                    for k, x in best.items():
                        for s, length, edits, end in passages(own[k], text):
                            values = (one["row"][k], one["id"][k], one["n"][k], two["row"][j], two["id"][j], max(0, one["at"][k] - ITEM_SIDE) + s, length, edits, max(0, two["at"][j] - TEXT_SIDE) + end, x)
                            for c, v in zip(out, values, strict=True):
                                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _holding(at: int, side: int, n: int) -> range:
    """Starts of windows of a slice of n words around the run at `at` that hold the run."""
    p = min(at, side)
    return range(max(0, p - (PASSAGE - RUN)), min(p, n - PASSAGE) + 1)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate([np.empty(0, np.uint64), *map(runs_of, (s for s in _ids(batch) if len(s) >= PASSAGE))]) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["place", "bit"])


def _shared_out(texts: DataFrame, items: DataFrame, weights: Weights, n_runs: int, per_task: int) -> DataFrame:
    """LEAK where the items' runs are too many for one task: places of runs on both sides are shuffled by the run's hash.

    Texts are searched once, through a filter of FILTER_BITS; what does not hold a run of an item is not shuffled. A bucket of more than
    PLACES_PER_TASK places on either side is cut into blocks by salts, so that a run in a third of all texts is spread."""
    spark = texts.sparkSession
    words = np.zeros(FILTER_BITS // 64, np.int64)
    set_bits = items.mapInArrow(_bits, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most FILTER_BITS / 64 rows
    words[set_bits.column("place").to_numpy()] = set_bits.column("bit").to_numpy()
    buckets = min(-(-n_runs // per_task), MOST_BUCKETS)
    own = keep(items.mapInArrow(_places("item_id", ITEM_SIDE, buckets, None, PASSAGE), PLACES), "item-runs")
    found = keep(texts.mapInArrow(_places("doc_id", TEXT_SIDE, buckets, words.tobytes(), 1), PLACES), "doc-runs")
    salts = lambda side, name, most: side.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    cut = F.broadcast(salts(own, "i", per_task).join(salts(found, "j", PLACES_PER_TASK), "bucket"))  # at most MOST_BUCKETS rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("row", "at"), F.col(n)).cast("int")
    left = own.join(cut, "bucket").withColumns({"x": salt("i"), "y": every("j")}).drop("i", "j")
    right = found.join(cut, "bucket").withColumns({"x": every("i"), "y": salt("j")}).drop("i", "j")
    proved = left.groupBy("bucket", "x", "y").cogroup(right.groupBy("bucket", "x", "y")).applyInArrow(_held(weights), STRETCH)
    best = proved.groupBy("item_row", "item_id", "item_words", "doc_row", "doc_id").agg(
        F.max(F.struct("n_words", (-F.col("edits")).alias("e"), (-F.col("last_word")).alias("l"))).alias("b"),
        F.collect_set(F.struct("start", "n_words")).alias("s"), F.max("similarity").alias("similarity"))  # at most as many as the item has words
    covered = F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["n_words"] - 1)))))
    return best.select("item_id", "doc_id", F.greatest(F.lit(0), -F.col("b.l") - F.col("b.n_words") + 1).alias("first_word"), F.col("b.n_words").alias("n_words"),
                       (-F.col("b.e")).alias("edits"), (covered / F.col("item_words")).alias("covered"), "similarity")


def leaked_items(docs: DataFrame, items: DataFrame, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """(item_id, doc_id, ...): LEAK, one row per document of docs (doc_id, text) and item of items (item_id, text) of which it
    holds a passage: at least PASSAGE words in order, at most one in ONE_IN changed, left out or added, case,
    accents, punctuation, spacing, inline tags and hyphens at line ends set aside.

    Windows of PASSAGE words of both are fingerprinted over words weighted by their inverse document frequency in all
    documents, in a document those that hold RUN words of an item, as every passage does; a multi-index finds all pairs of
    fingerprints within RADIUS; a candidate window must have LEAST_SIMILAR of the item window's weighted shingles, and an alignment then
    proves the passage. n_words and edits are those of its longest proved stretch, covered the share of the item's words in any
    around a candidate. The documents are read once, whatever the number of items: up to runs_per_task runs of items go to every task, more are
    shared out by their hash and only the places of texts that hold them are shuffled. Items and documents below PASSAGE
    words, null and empty texts have no rows; copies among items or documents, and repeated rows, are found each.
    """
    spark = docs.sparkSession
    numbered = lambda df, name: df.select(F.monotonically_increasing_id().alias("row"), F.col(name).cast("long").alias(name), "text").where("text is not null")
    seqs = keep(spread(numbered(docs, "doc_id")).mapInArrow(_words("doc_id"), "row long, doc_id long, seq binary"), "doc-words")
    own = keep(numbered(items, "item_id").mapInArrow(_words("item_id"), "row long, item_id long, seq binary"), "item-words").where(F.octet_length("seq") >= 4 * PASSAGE)
    n_runs = own.agg(F.sum(F.octet_length("seq") / 4 - (RUN - 1))).first()[0]
    if not n_runs:
        return spark.createDataFrame([], LEAK)
    wanted = own.mapInArrow(_buckets, "bucket int").distinct().toArrow().column("bucket").to_numpy()  # at most BUCKETS rows
    counts = seqs.mapInArrow(_frequencies(wanted.astype(np.int32).tobytes()), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS, np.int64)
    n[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    weights = Weights.of([(int(b), int(n[b])) for b in wanted], seqs.count())
    if n_runs <= runs_per_task:
        rows = own.orderBy("item_id", "row").collect()  # at most runs_per_task runs
        return seqs.mapInArrow(_find(Items(tuple(r["item_id"] for r in rows), tuple(bytes(r["seq"]) for r in rows)), weights), LEAK)
    return _shared_out(seqs, own, weights, int(n_runs), runs_per_task)
