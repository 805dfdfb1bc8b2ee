"""Reading level of each document by a linear pairwise ranker with isotonic calibration.

Learning: a bounded sample of the rated documents is cut into sentences (by the rule tables of
``sentences``), and each sentence has features of syntax (length of sentences and words, commas, joined
clauses) and vocabulary (words; in Chinese characters and pairs of characters). A linear ranker learns
from pairs of sentences of documents of different level which one is from the harder document. In later
rounds sentences that read unlike their document's level count less, so that headings, quotations and
stray sentences don't blur the weights. A second set of weights on the same features tells how surely a
sentence shows its document's level at all.

Scoring: every sentence of every document gets the ranker's score, on a scale on which the calibrated
bounds of its language lie at 1.5, 2.5 and 3.5. A ranker of the same kind orders documents by how those
scores are distributed (quantiles and the share beyond each bound, by number and by sureness), so that
passages of another style don't decide as long as they are the smaller part. Isotonic regression on the
rated sample turns its scores into levels.

Texts are worked on in batches: one pass of a pattern (in Chinese, of array operations) over all
sentences of a batch, then sums by sentence and by document.

Bounds: the sample has at most ``max_labelled`` documents, chosen by hash, and none longer than
``max_label_chars``; so at most their product comes to the driver. All documents are scored, and whole.
The model is a few thousand weights.

Defined results: a document with null text, null or small ``n_chars`` or in another language has no
row; several ratings of a document are averaged; without ratings of two different levels no model can
be learned and ``ValueError`` is raised; repeated rows give repeated results; ratings with null level
or of unknown documents are ignored; a text without any sentence has the lowest level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.confusables import consistent_text
from linkloom.llm.sentences import sentence_spans

LANGUAGES = ("en", "es", "zh")
BOUNDS = (1.5, 2.5, 3.5)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
N_SYNTAX = 6
SMOOTH, WORD_SCALE = 3, 8.0
_TOKEN = re.compile(r"\n|[,;]|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_OTHER, _END, _COMMA, _JOIN = range(4)  # the first ids of a vocabulary
_LONG_WORD = 9
# Frequent function words that only one of these languages has; a Latin text in none of the first two has no level.
_FUNCTION = {
    word: lang
    for lang, words in {
        "en": "the of and is was are were that to for with it by from on not which had has this be at an my we they",
        "es": "el los las y del su al lo fue más como ha había está es mi muy unas aunque quienes según cuando",
        "fr": "les des du est dans une et pour qui avec sur au il elle pas ce cette sont",
        "de": "der das und ist nicht mit den von zu ein eine dem auf für sich sind",
        "it": "il che di per gli della è sono nel alla dei",
        "pt": "os não uma em com são dos ao pela",
    }.items()
    for word in words.split()
}
_SPANISH_LETTERS = re.compile("[ñáéíóú¿¡]")


def language_of(text: str) -> str | None:
    """en, es or zh by script, function words and, where these don't tell, letters; None for another language."""
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        han = 3 * int(((points >= 0x3400) & (points < 0xA000)).sum())
        latin = int((((points | 32) >= 97) & ((points | 32) <= 122)).sum())
        other = int(((points >= 0x370) & (points < 0x1E00)).sum())
        if other > max(han, latin):
            return None
        if han > latin:
            return "zh"
    words = text.lower().split()
    counts = Counter(map(_FUNCTION.get, words))
    counts.pop(None, None)
    if counts:
        best = max(sorted(counts), key=counts.__getitem__)
        return best if best in LANGUAGES else None
    if len(words) < 5:
        return None
    # without any function word: Spanish words end in few letters
    soft = sum(w.strip(".,;:!?")[-1:] in ("a", "o", "e", "s", "n") for w in words)
    return "es" if _SPANISH_LETTERS.search(text) or soft > 0.85 * len(words) else "en"


class Vocabulary(dict):
    """Word -> id; a word without one has the id of all others."""

    def __missing__(self, word: str) -> int:
        return _OTHER


@dataclass
class Units:
    """The sentences of a batch of texts of one language: the document and the syntax of each, its vocabulary as (sentence, id) pairs."""

    doc: np.ndarray
    syntax: np.ndarray
    at: np.ndarray
    ids: np.ndarray


def sentences_of(texts: list[str], lang: str) -> tuple[list[str], np.ndarray]:
    """The sentences of texts and the text that each is from."""
    parts, doc = [], []
    for i, text in enumerate(texts):
        text = consistent_text(text)
        spans = sentence_spans(text, lang)
        parts.extend([text[a:b] for a, b in spans])
        doc.extend([i] * len(spans))
    return parts, np.array(doc, dtype=np.int64)


def _words(parts: list[str], lang: str) -> list[str]:
    """All tokens of all sentences; a line feed ends a sentence."""
    return _TOKEN.findall("\n".join([*parts, ""]).lower())


def _characters(parts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, code) of each ideograph and each pair of them."""
    han = (points >= 0x3400) & (points < 0xA000)
    one, two = np.flatnonzero(han), np.flatnonzero(han[:-1] & han[1:])
    return np.concatenate([one, two]), np.concatenate([points[one], points[two] << 32 | points[two + 1]])


def _count(at: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weight, n)[:n].astype(float)


def units(parts: list[str], doc: np.ndarray, lang: str, vocabulary: Vocabulary | np.ndarray) -> Units:
    """The features of sentences of documents, in the vocabulary of a model."""
    n = len(parts)
    if lang == "zh":
        points = _characters(parts)
        at = np.cumsum(points == 10) - (points == 10)
        where, codes = _grams(points)
        known = np.minimum(np.searchsorted(vocabulary, codes), max(0, len(vocabulary) - 1))
        ids = np.where(vocabulary[known] == codes, known + _JOIN + 1, _OTHER) if len(vocabulary) else np.zeros(len(codes), dtype=np.int64)
        han = (points >= 0x3400) & (points < 0xA000)
        letters = _count(at[han], n)
        runs = _count(at[1:][han[1:] & ~han[:-1]], n) + _count(at[:1][han[:1]], n)
        commas = _count(at[np.isin(points, [0x2C, 0x3B, 0xFF0C, 0xFF1B, 0x3001])], n)
        joined = _count(at[points == ord("也")], n)
        count, mean_size, long_share = letters / 1.6, letters / np.maximum(1, runs), np.zeros(n)
        at = at[where]
    else:
        tokens = _words(parts, lang)
        ids = np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        ends = ids == _END
        at = np.cumsum(ends) - ends
        word = ~ends & (ids != _COMMA)
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        commas, joined = _count(at[ids == _COMMA], n), _count(at[ids == _JOIN], n)
        at, ids, sizes = at[word], ids[word], sizes[word]
        count = _count(at, n)
        mean_size = _count(at, n, sizes) / np.maximum(1, count)
        long_share = _count(at[sizes >= _LONG_WORD], n) / np.maximum(1, count)
    syntax = np.stack([np.log1p(count), mean_size / 5, long_share * 2, commas / 5, joined / 5, np.ones(n)], 1)
    return Units(doc, syntax, at, ids)


def vocabulary_of(parts: list[str], lang: str, n_words: int, least: int = 3) -> Vocabulary | np.ndarray:
    """The most frequent words (characters and pairs of them) of sentences."""
    if lang == "zh":
        codes, counts = np.unique(_grams(_characters(parts))[1], return_counts=True)
        order = np.lexsort((codes, -counts))[:n_words]
        return np.sort(codes[order][counts[order] >= least])
    counts = Counter(_words(parts, lang))
    fixed = {"\n": _END, ",": _COMMA, ";": _COMMA, "and" if lang == "en" else "y": _JOIN}
    best = sorted((w for w, c in counts.items() if c >= least and w not in fixed), key=lambda w: (-counts[w], w))[:n_words]
    return Vocabulary(fixed | {w: k for k, w in enumerate(best, _JOIN + 1)})


def n_ids(vocabulary: Vocabulary | np.ndarray) -> int:
    return _JOIN + 1 + len(vocabulary) if isinstance(vocabulary, np.ndarray) else 1 + max(vocabulary.values())


@dataclass
class Linear:
    """Weights of the sentence features of one language."""

    syntax: np.ndarray
    words: np.ndarray

    def __call__(self, u: Units) -> np.ndarray:
        n = len(u.doc)
        return u.syntax @ self.syntax + _count(u.at, n, self.words[u.ids]) / (_count(u.at, n) + SMOOTH)


@dataclass
class Model:
    """By language: vocabulary, sentence ranker with its bounds, sureness; then the document ranker with its bounds."""

    vocabulary: dict[str, Vocabulary | np.ndarray] = field(default_factory=dict)
    harder: dict[str, Linear] = field(default_factory=dict)
    sentence_cuts: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    sure: dict[str, Linear] = field(default_factory=dict)
    weights: np.ndarray | None = None
    cuts: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def sentence_levels(self, u: Units, lang: str) -> np.ndarray:
        """Scores on the scale of levels: linear between the bounds, and beyond them as in the next piece."""
        scores, (a, b, c) = self.harder[lang](u), self.sentence_cuts[lang]
        if not (np.isfinite([a, b, c]).all() and a < b < c):
            return np.clip(1.0 + np.searchsorted([a, b, c], scores, side="right"), 1, 4)
        low, high = 1.5 + (scores - a) / (b - a), 3.5 + (scores - c) / (c - b)
        return np.clip(np.where(scores < a, low, np.where(scores > c, high, np.interp(scores, [a, b, c], BOUNDS))), 0.5, 4.5)

    def sureness(self, u: Units, lang: str) -> np.ndarray:
        """0.0025 to 1: a sentence that shows its document's level no better than by chance hardly counts."""
        chance = 1 / (1 + np.exp(-self.sure[lang](u)))
        return np.clip(2 * chance - 1, 0.05, 1) ** 2

    def documents(self, u: Units, lang: str, n_docs: int) -> np.ndarray:
        """How the sentence levels are distributed over each document; once for all languages and once for its own."""
        parts = distribution(self.sentence_levels(u, lang), self.sureness(u, lang), u.doc, n_docs)
        out = np.zeros((n_docs, 1 + len(LANGUAGES), parts.shape[1]))
        out[:, 0] = out[:, 1 + LANGUAGES.index(lang)] = parts
        return out.reshape(n_docs, -1)

    def levels(self, texts: list[str], lang: str) -> np.ndarray:
        """The level of each text."""
        scores = self.documents(units(*sentences_of(texts, lang), lang, self.vocabulary[lang]), lang, len(texts)) @ self.weights
        return 1 + np.searchsorted(self.cuts[lang], scores, side="right")


def _within(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by document and value, number of values and position of the first one of each document."""
    count = np.bincount(doc, minlength=n_docs)
    return np.lexsort((values, doc)), count, np.cumsum(count) - count


def distribution(values: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Quantiles, mean and shares beyond each bound of the values of each document, by number and by weight; a document without any has zeros."""
    order, count, first = _within(values, doc, n_docs)
    has = count > 0
    if not has.any():
        return np.zeros((n_docs, 2 * len(QUANTILES) + 1 + 4 * len(BOUNDS)))
    v, d, weight = values[order], doc[order], weights[order]
    by_number = [v[np.minimum(len(v) - 1, first + (q * np.maximum(0, count - 1) + 0.5).astype(int))] for q in QUANTILES]
    total = _count(d, n_docs, weight)
    running = np.cumsum(weight)
    before = np.concatenate([[0.0], running])[first]
    reached = d + (running - before[d]) / total[d]
    at = np.arange(n_docs)
    by_weight = [v[np.clip(np.searchsorted(reached, at + q), first, np.maximum(first, first + count - 1)).clip(0, len(v) - 1)] for q in QUANTILES]
    mean = _count(d, n_docs, v) / np.maximum(1, count)
    shares = []
    for bound in BOUNDS:
        for share in (_count(d[v > bound], n_docs) / np.maximum(1, count), _count(d[v > bound], n_docs, weight[v > bound]) / np.maximum(1e-9, total)):
            shares += [share, 1 / (1 + np.exp(-12 * (share - 0.5)))]
    out = np.stack([x / 4 for x in by_number] + [x / 4 for x in by_weight] + [mean / 4] + shares, 1)
    return np.where(has[:, None], out, 0.0)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``y`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, n = blocks.pop()
            u, w1, m = blocks.pop()
            blocks.append([(u * w1 + v * w2) / (w1 + w2), w1 + w2, m + n])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _cuts(scores: np.ndarray, levels: np.ndarray) -> tuple[float, float, float]:
    """Where the calibrated level passes 1.5, 2.5 and 3.5."""
    order = np.argsort(scores, kind="stable")
    fitted, at = isotonic(levels[order], np.ones(len(order))), scores[order]
    out = []
    for bound in BOUNDS:
        k = int(np.searchsorted(fitted, bound, side="right"))
        out.append(-np.inf if k == 0 else np.inf if k == len(at) else float(at[k - 1] + at[k]) / 2)
    return tuple(out)


def _calibrate(scores: np.ndarray, levels: np.ndarray, langs: np.ndarray) -> dict[str, tuple[float, float, float]]:
    """Level bounds by language; a language with few ratings takes those of all."""
    pooled, cuts = _cuts(scores, levels), {}
    for g in LANGUAGES:
        own = langs == g
        cuts[g] = _cuts(scores[own], levels[own]) if own.sum() >= 40 and len(set(levels[own])) >= 4 else pooled
    return cuts


def _descend(gradient: Callable[[np.ndarray], np.ndarray], w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a rate that falls to a tenth."""
    w, m, v = w.copy(), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w -= rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return w


@dataclass
class Rows:
    """A sparse matrix of features: entries (row, column, value)."""

    n: int
    width: int
    at: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.at], self.width)

    def some(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        kept = new[self.at] >= 0
        return Rows(len(rows), self.width, new[self.at[kept]], self.col[kept], self.val[kept])


def rank(x: Rows, levels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, n_pairs: int, steps: int, l2: float, w: np.ndarray | None = None) -> np.ndarray:
    """Weights under which the harder row of a pair scores higher (logistic loss)."""
    a, b = rng.integers(0, len(levels), (2, n_pairs * 2))
    differ = levels[a] != levels[b]
    a, b = a[differ][:n_pairs], b[differ][:n_pairs]
    a, b = np.where(levels[a] > levels[b], a, b), np.where(levels[a] > levels[b], b, a)
    gap = np.minimum(2.0, levels[a] - levels[b]) * weight[a] * weight[b]

    # the gradient of the mean pair loss is Xᵀ(sum of pair weights by row), so no pair matrix is made
    def gradient(w: np.ndarray) -> np.ndarray:
        s = x.times(w)
        g = -gap / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        return x.back(np.bincount(a, g, x.n) - np.bincount(b, g, x.n)) / max(1e-9, gap.sum()) + l2 * w

    return _descend(gradient, np.zeros(x.width) if w is None else w, steps, 0.1)


def _agreement(x: Rows, agrees: np.ndarray, steps: int, l2: float) -> np.ndarray:
    """Weights of a logistic regression: does a sentence read like its document's level?"""
    return _descend(lambda w: x.back(1 / (1 + np.exp(-np.clip(x.times(w), -30, 30))) - agrees) / x.n + l2 * w, np.zeros(x.width), steps, 0.05)


def _medians(scores: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The median score of the sentences of each document; 0 for one without any."""
    order, count, first = _within(scores, doc, n_docs)
    has = count > 0
    out = np.zeros(n_docs)
    out[has] = (scores[order][(first + (count - 1) // 2)[has]] + scores[order][(first + count // 2)[has]]) / 2
    return out


def fit(
    texts: list[str],
    levels: np.ndarray,
    n_words: int = 1500,
    n_pairs: int = 60_000,
    n_sentences: int = 25_000,
    rounds: int = 3,
    steps: int = 200,
    l2: float = 1e-3,
    seed: int = 7,
) -> Model:
    """Learn the rankers from rated texts; a round learns from at most ``n_sentences`` of their sentences and ``n_pairs`` pairs."""
    langs = np.array([language_of(t) or "" for t in texts])
    known = langs != ""
    levels, langs = np.asarray(levels, dtype=float)[known], langs[known]
    texts = [t for t, k in zip(texts, known, strict=True) if k]
    if len(set(levels)) < 2:
        raise ValueError("ratings of at least two levels are needed")
    model, sample, base, width, n = Model(), {}, {}, 0, 0
    entries, of_doc = [], []
    for lang in LANGUAGES:
        docs = np.flatnonzero(langs == lang)
        parts, doc = sentences_of([texts[i] for i in docs], lang)
        model.vocabulary[lang] = vocabulary_of(parts, lang, n_words)
        u = sample[lang] = units(parts, docs[doc] if len(doc) else doc, lang, model.vocabulary[lang])
        base[lang], k = width, len(doc)
        entries += [(n + np.arange(k), np.full(k, width + j), u.syntax[:, j]) for j in range(N_SYNTAX)]
        entries.append((n + u.at, width + N_SYNTAX + u.ids, WORD_SCALE / (_count(u.at, k) + SMOOTH)[u.at]))
        of_doc.append(u.doc)
        width, n = width + N_SYNTAX + n_ids(model.vocabulary[lang]), n + k
    if not n:
        raise ValueError("ratings of texts with sentences are needed")
    doc = np.concatenate(of_doc)
    at, col, val = map(np.concatenate, zip(*entries, strict=True))
    # columns on a common scale; rare ones aren't raised above a bound
    spread = np.sqrt(_count(col, width, val**2) / n)
    scale = np.where(spread > 0, 1 / (spread + 0.02 * spread.max()), 0.0)
    x = Rows(n, width, at, col, val * scale[col])

    def by_language(w: np.ndarray) -> dict[str, Linear]:
        w = w * scale
        return {g: Linear(w[b : b + N_SYNTAX], WORD_SCALE * w[b + N_SYNTAX : b + N_SYNTAX + n_ids(model.vocabulary[g])]) for g, b in base.items()}

    rng = np.random.default_rng(seed)
    target, weight, w = levels[doc], np.ones(n), None
    for _ in range(rounds):
        chosen = np.sort(rng.choice(n, min(n, n_sentences), replace=False))
        some = x.some(chosen)
        w = rank(some, target[chosen], weight[chosen], rng, n_pairs, steps, l2, w)
        model.harder = by_language(w)
        scores = np.concatenate([model.harder[g](u) for g, u in sample.items()])
        model.sentence_cuts = _calibrate(_medians(scores, doc, len(texts)), levels, langs)
        agrees = np.abs(np.concatenate([model.sentence_levels(u, g) for g, u in sample.items()]) - target) < 0.75
        weight = np.where(agrees, 1.0, 0.15)
    model.sure = by_language(_agreement(some, agrees[chosen].astype(float), steps // 2, l2))
    by_doc = sum(model.documents(u, g, len(texts)) for g, u in sample.items())
    scale = 1 / (by_doc.std(0) + 0.05)
    at, col = map(np.ravel, np.indices(by_doc.shape))
    full = Rows(len(texts), by_doc.shape[1], at, col, (by_doc * scale).ravel())
    model.weights = scale * rank(full, levels, np.ones(len(texts)), rng, n_pairs, steps, 10 * l2)
    model.cuts = _calibrate(by_doc @ model.weights, levels, langs)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_label_chars: int) -> pd.DataFrame:
    """At most ``max_labelled`` rated documents of bounded length with the mean of their ratings, chosen by hash."""
    rated = labels.where("reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    usable = docs.where(F.length("text") <= max_label_chars).select("doc_id", "text")
    return chosen.join(usable, "doc_id").toPandas()


def reading_levels(docs: DataFrame, labels: DataFrame, min_chars: int = 200, max_labelled: int = 3000, max_label_chars: int = 20_000) -> DataFrame:
    """(doc_id, reading_level): one row for each document in English, Spanish or Chinese with ``min_chars`` or more."""
    sample = labelled_sample(docs, labels, max_labelled, max_label_chars).sort_values(["doc_id", "text"])
    model = fit(list(sample["text"]), sample["level"].to_numpy())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), list(batch["text"])
            langs = [language_of(t) for t in texts]
            for lang in LANGUAGES:
                own = [i for i, g in enumerate(langs) if g == lang]
                if own:
                    levels = model.levels([texts[i] for i in own], lang)
                    yield pd.DataFrame({"doc_id": ids[own], "reading_level": levels.astype("int32")})

    long_enough = docs.where(f"n_chars >= {int(min_chars)} and text is not null and doc_id is not null").select("doc_id", "text")
    return long_enough.mapInPandas(score, "doc_id long, reading_level int")
