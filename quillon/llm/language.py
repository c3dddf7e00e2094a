"""Document language with confidence, and the stretches of documents in several languages (problem 8)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.storage import spread

#: Longest character n-gram within a word and its two ends.
GRAM = 4
#: Labelled rows that the classifier is fitted on at most, first in hash order.
MAX_SAMPLES = 20_000
#: Codes and names of the languages.
NAMES = {
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "en": ("en", "eng", "english", "inglés", "ingles"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugués"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francés", "frances"),
    "de": ("de", "deu", "ger", "german", "deutsch", "alemán", "aleman"),
    "it": ("it", "ita", "italian", "italiano"),
}

#: Letters from which an n-gram tells that a text is in none of the languages, and the share of samples that are doubted for it.
LONG_GRAM, RARE = 3, 0.02

_TOKEN = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_STOP = re.compile(r"[.!?;:…][\"'”’»)\]]*(?:\s|$)|\n\s*\n|\|")
_CACHE_SIZE, _LONG_WORD = 500_000, 60


def grams(word: str) -> Iterator[str]:
    """Character n-grams of a lower-case word, its ends marked by blanks; the whole word is one too."""
    w = f" {word} "
    for n in range(1, GRAM + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]
    if len(w) > GRAM:
        yield w


def _tokens(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@dataclass
class Model:
    """Sparse weights by n-gram (idf multiplied in), bias, the temperature of the calibrated confidence, and how many of their
    long n-grams texts of these languages have weights for (quantiles of held-out samples)."""

    langs: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float = 1.0
    held_out: float = float("nan")
    typical: np.ndarray | None = None
    _ids: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ids": {}, "_rows": None}

    def _row(self, word: str) -> np.ndarray:
        k = len(self.langs)
        row = np.zeros(k + 3)
        for g in grams(word):
            x = self.weights.get(g)
            if x is not None:
                row[:k] += x
            row[k] += 1
            if len(g) >= LONG_GRAM:
                row[k + 1] += 1
                row[k + 2] += x is not None
        return row

    def _add(self, word: str) -> None:
        if self._rows is None or len(self._ids) > _CACHE_SIZE:
            self._ids, self._rows = {}, np.zeros((1024, len(self.langs) + 3))
        k = len(self._ids)
        if k == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        self._rows[k] = self._row(word)
        self._ids[word] = k

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's part in the logits, before division by the length norm; its number of n-grams; and of its long ones,
        how many there are and how many have weights. Remembered
        per worker; the memory is emptied when full, and words too long to be met again are not remembered, which costs time only."""
        at = list(map(self._ids.get, words))
        if None in at:
            out = np.empty((len(words), len(self.langs) + 3))
            for i, w in enumerate(words):
                if len(w) > _LONG_WORD:
                    out[i] = self._row(w)
                    continue
                if w not in self._ids:
                    self._add(w)
                out[i] = self._rows[self._ids[w]]
        else:
            out = self._rows[at] if at else np.empty((0, len(self.langs) + 3))
        return out[:, :-3], out[:, -3], out[:, -2:]

    def logits(self, words: list[str]) -> np.ndarray:
        z, n, _ = self.words(words)
        return self.bias + z.sum(axis=0) / math.sqrt(max(n.sum(), 1.0))

    def sure(self, logits: np.ndarray, k: int, long: np.ndarray) -> float:
        """Confidence in language k: its calibrated probability among the known ones, less where so few of the text's long n-grams
        have weights as in less than RARE of the held-out samples, as in text of a language that is none of them."""
        p = float(self.probabilities(logits)[k])
        if self.typical is None or not long[0]:
            return p
        below = (np.searchsorted(self.typical, long[1] / long[0], "right") + 1) / (len(self.typical) + 1)
        return p * min(1.0, float(below) / RARE)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()


def _fit(samples: list[tuple[str, list[str]]], langs: list[str], alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> Model:
    """Follow the regularised leader, proximal, per coordinate, on multinomial logistic loss."""
    seen: Counter[str] = Counter()
    bags = []
    for lang, words in samples:
        bag = Counter(g for w in words for g in grams(w))
        seen.update(bag.keys())
        bags.append((langs.index(lang), bag))
    ids = {g: i for i, g in enumerate(seen)}
    idf = np.array([math.log((1 + len(bags)) / (1 + seen[g])) + 1.0 for g in ids])
    data = []
    for y, bag in bags:
        at = np.array([ids[g] for g in bag])
        tf = np.array(list(bag.values()), dtype=float)
        data.append((y, at, tf * idf[at] / math.sqrt(max(tf.sum(), 1.0))))
    k = len(langs)
    z, n = np.zeros((len(ids) + 1, k)), np.zeros((len(ids) + 1, k))
    last = len(ids)  # the bias is the last coordinate and is not penalised

    def weights(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    def bias() -> np.ndarray:
        return -z[last] / ((beta + np.sqrt(n[last])) / alpha)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            y, at, x = data[j]
            w, b = weights(at), bias()
            o = x @ w + b
            p = np.exp(o - o.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            z[last] += p - (np.sqrt(n[last] + p * p) - np.sqrt(n[last])) / alpha * b
            n[last] += p * p
    w = weights(np.arange(len(ids)))
    kept = {g: w[i] * idf[i] for g, i in ids.items() if w[i].any()}
    return Model(langs, kept, bias())


def _views(lang: str, text: str) -> list[tuple[str, list[str]]]:
    """A sample as it is, without accents, and its halves: documents lack accents and stretches are short."""
    words, bare = _tokens(text), _tokens(_bare(text))
    half = len(words) // 2
    out = [(lang, words), (lang, bare)]
    if half >= 4:
        out += [(lang, words[:half]), (lang, bare[half:])]
    return [v for v in out if v[1]]


def train(samples: list[tuple[str, str]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4, folds: int = 4, seed: int = 42) -> Model:
    """(lang, text) -> a calibrated model. The temperature is the one at which folds held out in turn are least
    surprising; held_out is their accuracy. Samples without letters or language are left out."""
    samples = [(a, t) for a, t in samples if a and t and _tokens(t)]
    langs = sorted({a for a, _ in samples})
    if not langs:
        raise ValueError("no labelled samples")
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    fold = np.empty(len(samples), int)
    fold[order] = np.arange(len(samples)) % folds
    fit = lambda own: _fit([v for s in own for v in _views(*s)], langs, alpha, beta, l1, l2, epochs, seed)
    logits, truth, typical = [], [], []
    for k in range(folds):
        own = [s for s, f in zip(samples, fold, strict=True) if f != k]
        if len({a for a, _ in own}) < len(langs):
            continue
        model = fit(own)
        for (a, t), f in zip(samples, fold, strict=True):
            if f == k:
                for _, words in _views(a, t):
                    long = model.words(words)[2].sum(axis=0)
                    typical.append(long[1] / max(long[0], 1.0))
                    logits.append(model.logits(words))
                    truth.append(langs.index(a))
    model = fit(samples)
    if logits:
        o, y = np.array(logits), np.array(truth)

        def loss(temperature: float) -> float:
            s = o / temperature
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.1, 10, 81)), key=loss)
        model.held_out = float((o.argmax(axis=1) == y).mean())
        model.typical = np.quantile(typical, np.linspace(0, 1, 1_000))
    return model


@dataclass(frozen=True)
class Stretch:
    lang: str
    confidence: float
    start: int
    end: int
    n_words: int
    sentence: bool


def _sentence(spans: Iterable[tuple[int, int]], text: str, run: int) -> bool:
    """Whether the words at spans hold a run of so many words of two letters or more without a number or slash between."""
    now, end = 0, None
    for a, b in spans:
        if end is not None and any(c.isdigit() or c in "/|<>=" for c in text[end:a]):
            now = 0
        end = b
        if b - a >= 2:
            now += 1
            if now >= run:
                return True
    return False


def _constant(e: np.ndarray, least: float) -> int | None:
    """The language that explains all words together best, if no stretch of words gains more than `least` by another one: a path with
    changes, of which each costs that much, cannot be better then."""
    k = int(e.sum(axis=0).argmax())
    gain = np.cumsum(e - e[:, k : k + 1], axis=0)
    before = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(e.shape[1]), gain[:-1]]), axis=0), 0.0)
    return k if (gain - before).max() <= least else None


@dataclass(frozen=True)
class Options:
    """switch, at_stop: what a change of language costs inside a sentence and where one ends. window: words of which the best
    language must differ somewhere before changes are looked for. least: words of the shortest stretch; run, from one sentence
    end to another. run: running words that make a sentence."""

    switch: float = 9.0
    at_stop: float = 3.0
    window: int = 8
    least: int = 5
    run: int = 4


@dataclass
class _Mixed:
    """A text that may hold several languages: what each word says for each, and what a change before it costs."""

    text: str
    spans: list[tuple[int, int]]
    sums: np.ndarray
    n: np.ndarray
    long: np.ndarray
    e: np.ndarray
    cost: np.ndarray


def _begin(model: Model, text: str, how: Options) -> list[Stretch] | _Mixed:
    """The stretches of a text that is in one language throughout, or what is needed to look for changes."""
    low = text.lower()
    same = len(low) == len(text)  # else a character has a longer small form: offsets must be those of the text
    words = _TOKEN.findall(low) if same else _tokens(text)
    if not words:
        return []
    found = lambda: (m.span() for m in _TOKEN.finditer(low if same else text))
    z, n, long = model.words(words)
    root = math.sqrt(max(float(n.mean()), 1.0))
    sums = np.cumsum(np.vstack([np.zeros(z.shape[1]), z]), axis=0)
    size = min(how.window, len(words))
    best = (sums[size:] - sums[:-size]).argmax(axis=1)
    whole = int(best[0]) if (best == best[0]).all() else None
    if whole is None:
        e = z / root
        e = e - e.max(axis=1, keepdims=True)
        e = np.maximum(e - np.log(np.exp(e).sum(axis=1, keepdims=True)), -4.0)
        whole = _constant(e, min(how.switch, how.at_stop))
    if whole is not None:
        o = model.bias + sums[-1] / math.sqrt(max(float(n.sum()), 1.0))
        last = words[-1] if same else _TOKEN.findall(text)[-1]
        end = (low if same else text).rfind(last) + len(last)
        return [Stretch(model.langs[whole], model.sure(o, whole, long.sum(axis=0)), next(found())[0], end, len(words), _sentence(found(), text, how.run))]
    spans = list(found())
    cost = np.full(len(words), how.switch)
    stops = np.searchsorted(np.array([s[0] for s in spans]), [m.start() for m in _STOP.finditer(text)])
    cost[stops[(stops > 0) & (stops < len(words))]] = how.at_stop
    return _Mixed(text, spans, sums, n, long, e, cost)


#: Words of texts whose paths are sought side by side.
SIDE_BY_SIDE = 200_000


def _paths(texts: list[_Mixed]) -> list[list[int]]:
    """The most probable language of every word of each text. Texts of like length go side by side, a step for each word of the
    longest: the end of a shorter one is filled up with words that say nothing and before which no change is possible."""
    out: list[list[int]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i].cost), reverse=True)
    while order:
        most = len(texts[order[0]].cost)
        lot = order[: max(1, SIDE_BY_SIDE // most)]
        order = order[len(lot) :]
        scores = np.zeros((most, len(lot), texts[lot[0]].e.shape[1]))
        cost = np.full((most, len(lot)), np.inf)
        for k, i in enumerate(lot):
            scores[: len(texts[i].cost), k] = texts[i].e
            cost[: len(texts[i].cost), k] = texts[i].cost
        for t in range(1, most):
            scores[t] += np.maximum(scores[t - 1], scores[t - 1].max(axis=1, keepdims=True) - cost[t][:, None])
        top, best = scores.max(axis=2), scores.argmax(axis=2)
        path = np.empty((most, len(lot)), np.int64)
        path[-1] = state = best[-1]
        at = np.arange(len(lot))
        for t in range(most - 1, 0, -1):
            path[t - 1] = state = np.where(scores[t - 1, at, state] >= top[t - 1] - cost[t], state, best[t - 1])
        for k, i in enumerate(lot):
            out[i] = path[: len(texts[i].cost), k].tolist()
    return out


def _end(model: Model, x: _Mixed, path: list[int], how: Options) -> list[Stretch]:
    runs: list[tuple[int, int, int]] = []
    a = 0
    at_end = lambda i: i in (0, len(path)) or x.cost[i] <= how.at_stop
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[a]:
            short = i - a < (how.run if at_end(a) and at_end(i) else how.least)
            if runs and (short or runs[-1][2] == path[a]):
                runs[-1] = (runs[-1][0], i, runs[-1][2])
            elif runs and len(runs) == 1 and runs[0][1] - runs[0][0] < how.least:
                runs[0] = (runs[0][0], i, path[a])
            else:
                runs.append((a, i, path[a]))
            a = i
    out = []
    for a, b, k in runs:
        o = model.bias + (x.sums[b] - x.sums[a]) / math.sqrt(max(float(x.n[a:b].sum()), 1.0))
        out.append(Stretch(model.langs[k], model.sure(o, k, x.long[a:b].sum(axis=0)), x.spans[a][0], x.spans[b - 1][1], b - a, _sentence(x.spans[a:b], x.text, how.run)))
    return out


def stretches_of(model: Model, texts: list[str], how: Options = Options()) -> list[list[Stretch]]:
    """Each text as stretches of one language each, in order.

    If every window of words is best explained by the same language the text is one stretch. Else the most probable
    sequence of languages over the words is sought, a change costing at_stop where a sentence ends and switch
    elsewhere, so that a few foreign words inside a sentence change nothing; stretches of fewer than least words
    join the one before. Confidence is Model.sure over the stretch's words."""
    out = [_begin(model, t, how) for t in texts]
    mixed = [i for i, x in enumerate(out) if isinstance(x, _Mixed)]
    for i, path in zip(mixed, _paths([out[i] for i in mixed]), strict=True):
        out[i] = _end(model, out[i], path, how)
    return out


def stretches(model: Model, text: str, **options) -> list[Stretch]:
    return stretches_of(model, [text], Options(**options))[0]


def label_language(col: Column | str) -> Column:
    """The language a label names, whatever its spelling (code, region, name); null for placeholders and other languages."""
    first = F.lower(F.regexp_extract(col, r"(?U)(\p{L}+)", 1))
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(first.isin(*names), lang).otherwise(out)
    return out


STRETCHES = "doc_id long, label string, stretch_no int, lang string, confidence double, start int, end int, n_words int, sentence boolean"


#: Characters of texts that are worked on at once.
CHARACTERS = 4_000_000


def _run(model: Model, options: dict):
    how = Options(**options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, texts = (batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHARACTERS):
                    size += len(texts[b])
                    b += 1
                rows = [(i, k, s) for i, own in zip(range(a, b), stretches_of(model, texts[a:b], how), strict=True) for k, s in enumerate(own)]
                a = b
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i, _, _ in rows], pa.int64()), pa.array([labels[i] for i, _, _ in rows], pa.string()), pa.array([k for _, k, _ in rows], pa.int32()),
                    *(pa.array([getattr(s, c) for _, _, s in rows], t) for c, t in (("lang", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("sentence", pa.bool_()))),
                ], names=["doc_id", "label", "stretch_no", "lang", "confidence", "start", "end", "n_words", "sentence"])

    return run


def fit_language_model(samples: DataFrame, max_samples: int = MAX_SAMPLES, **options) -> Model:
    """samples (lang, text, ...), of which at most max_samples, first in hash order of the text, are fitted on."""
    rows = samples.select("lang", "text").where("lang is not null and text is not null").orderBy(F.xxhash64("text", "lang"), "text").limit(max_samples)
    return train([(r["lang"], r["text"]) for r in rows.collect()], **options)


def language_stretches(docs: DataFrame, model: Model, **options) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> STRETCHES; label is docs.lang. Offsets are code points, half open. sentence:
    whether the stretch holds running words, not only measurements. Null texts and texts without letters have none.
    The model is a few thousand weights, fixed in size by its samples, and travels with the task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"), "text").where("text is not null")
    return spread(rows).mapInArrow(_run(model, options), STRETCHES)


def document_languages(found: DataFrame) -> DataFrame:
    """Stretches -> one row per document: its main language by words in sentences, mean confidence over its
    words, how many languages have a sentence, and whether the label names the only one of them."""
    said = found.where("sentence").groupBy("doc_id", "label", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    main = said.groupBy("doc_id", "label").agg(F.max_by(F.struct("lang", "n", "c"), F.struct("n", "lang")).alias("m"), F.count("*").cast("int").alias("n_langs"))
    return main.select("doc_id", "label", F.col("m.lang").alias("lang"), (F.col("m.c") / F.col("m.n")).alias("confidence"), "n_langs",
                       ((F.col("n_langs") == 1) & label_language("label").eqNullSafe(F.col("m.lang"))).alias("label_right"))


def language_cases(found: DataFrame) -> DataFrame:
    """(doc_id, lang): one row per language with a sentence, for documents with several or whose label is null, a
    placeholder or another language."""
    said = found.where("sentence").select("doc_id", "label", "lang").distinct()
    per = said.groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))  # at most as many as the model knows
    return per.where((F.size("langs") > 1) | ~label_language("label").eqNullSafe(F.col("langs")[0])).select("doc_id", F.explode("langs").alias("lang"))
