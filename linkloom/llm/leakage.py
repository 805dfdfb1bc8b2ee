"""Evaluation texts leaking into training text: latent semantic retrieval and an alignment check.

1. *Terms.* Texts are brought to one form (look-alikes, case, spacing), cut into words (single
   characters in Chinese) and, in Chinese, adjacent characters form the terms. The terms of the held-out
   passages are the columns of the TF-IDF matrix; their document frequencies are counted over the whole
   corpus.
2. *Latent space.* A randomised SVD of the TF-IDF matrix of all passages, in overlapping windows, gives
   the latent space. Each step of the subspace iteration is one distributed pass: a partition turns its
   rows A_p into A_p' (A_p X), a matrix of terms by rank, and only the sum of these matrices, whose size
   is bounded by the vocabulary of the passages, reaches the driver.
3. *Candidates.* Every window of every document is projected into the space and looks for passage windows with a
   cosine of ``min_cosine`` or more, which make document and passage a candidate pair. The passage windows are clustered
   around centres, about twice the root of their number, and a window is compared with the clusters whose centre has a
   cosine of ``min_centre`` or more only; so ten times the passages cost about three times the work. The index loses a
   pair only if all windows of the pair miss all its clusters (recall is measured in the tests).
4. *Check.* Common word triples of the pair are chained in order, chains are cut where the texts drift
   apart, and the longest common subsequence of the stretch must cover ``min_share`` of the passage.
   The answer check asks that the pieces that only this passage has (names, numbers and what is said of
   them) stand in the stretch too, as other texts follow the same patterns of sentence.

The corpus is never shuffled: counting, retrieval and check are map-side passes; a model of the held-out set is
broadcast to the executors, whose size grows with that set and not with the corpus.

Defined results: null or blank texts and passages leak nothing; a null id stays null; a passage shorter
than four terms leaks nothing; repeated rows give repeated results of a document, so the pairs are made
distinct; empty tables give an empty result; other columns are ignored; texts are processed whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.confusables import consistent_text

_WORD = re.compile("[\u3400-\u9fff]|[^\\W_\u3400-\u9fff]+(?:[.,][0-9]+)*")
_HAN = re.compile("[\u3400-\u9fff]")


# Characters whose consistent form may be another letter; texts without any needn't be brought to one form.
_UNUSUAL = re.compile("[^\x00-\x7f¡-¬®-ÿ\u3400-\u4dbf\u4e00-\u9fff，。！？、；：“”‘’（）《》…—–]")


def words_of(text: str | None) -> list[str]:
    """Words, in Chinese characters, in a form that ignores case, punctuation, spacing and characters' form."""
    if not text:
        return []
    if not text.isascii() and _UNUSUAL.search(text):
        text = consistent_text(text)
    return _WORD.findall(text.lower())


def terms_of(words: list[str]) -> list[str]:
    """One term for each word; a Chinese character is taken together with the next one."""
    joined = "".join(words)
    if joined.isascii() or not _HAN.search(joined):
        return words
    first, last = "\u3400", "\u9fff"  # characters are words of their own, so plain comparison tells them
    return [w + n if first <= w <= last and first <= n <= last else w for w, n in zip(words, [*words[1:], " "])]


@dataclass(frozen=True)
class Settings:
    """Parameters; ``block`` is half a window, in words."""

    rank: int = 96
    block: int = 16
    passes: int = 2
    min_cosine: float = 0.42
    min_centre: float = 0.2
    min_share: float = 0.36
    min_answers: float = 0.5
    max_drift: int = 30
    seed: int = 11


def _document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, over the whole corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch["text"]:
                df.update(vocabulary.keys() & set(terms_of(words_of(text))))
                n += 1
        yield pd.DataFrame({"term": [-1, *map(vocabulary.get, df)], "n": [n, *df.values()]})

    counted = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by_term = dict(zip(counted["term"], counted["n"], strict=True))
    return np.array([by_term.get(k, 0) for k in range(len(vocabulary))], dtype=float), int(by_term.get(-1, 0))


def _window_rows(words: list[str], vocabulary: dict[str, int], idf: np.ndarray, settings: Settings, step: int) -> np.ndarray:
    """TF-IDF rows of the overlapping windows of one passage."""
    at = [vocabulary[t] for t in terms_of(words)]
    width = 2 * settings.block
    rows = []
    for a in range(0, max(1, len(at) - width + step), step):
        row = np.zeros(len(idf), dtype=np.float32)
        np.add.at(row, at[a : a + width], 1)
        rows.append(row * idf)
    return np.array(rows, dtype=np.float32)


def _latent_space(items: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, settings: Settings) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the leading right singular vectors."""
    n, rank = len(idf), min(settings.rank, len(idf))
    x = np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((n, rank)))[0].astype(np.float32)
    for _ in range(settings.passes):

        def product(batches: Iterator[pd.DataFrame], x: np.ndarray = x) -> Iterator[pd.DataFrame]:
            total = np.zeros((n, rank), dtype=np.float64)
            for batch in batches:
                for passage in batch["passage"]:
                    words = words_of(passage)
                    if words:
                        a = _window_rows(words, vocabulary, idf, settings, settings.block // 2)
                        total += a.T @ (a @ x)
            used = np.flatnonzero(np.any(total != 0, axis=1))
            if len(used):
                yield pd.DataFrame({"term": used, "row": list(total[used])})

        parts = items.select("passage").mapInPandas(product, "term long, row array<double>")
        summed = parts.select("term", F.posexplode("row").alias("k", "v")).groupBy("term", "k").agg(F.sum("v").alias("v")).toPandas()
        y = np.zeros((n, rank))
        y[summed["term"], summed["k"]] = summed["v"]
        x = np.linalg.qr(y)[0].astype(np.float32)
    return x


def _clusters(windows: np.ndarray, seed: int, rounds: int = 6) -> tuple[np.ndarray, list[np.ndarray]]:
    """Unit centres (spherical k-means) and the windows of each."""
    k = min(len(windows), max(1, round(2 * len(windows) ** 0.5)))
    centres = windows[np.sort(np.random.default_rng(seed).choice(len(windows), k, replace=False))]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(windows[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(windows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, windows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
    nearest = np.concatenate([np.argmax(windows[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(windows), 4096)])
    order = np.argsort(nearest, kind="stable")
    return centres, np.split(order, np.searchsorted(nearest[order], np.arange(1, k)))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = defaultdict(int)
    for k, t in enumerate(a):
        masks[t] |= 1 << k
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (i, j), both increasing."""
    pairs = sorted(pairs, key=lambda p: (p[1], -p[0]))
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tails, i)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(i)
            at.append(k)
        else:
            tails[p] = i
            at[p] = k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


@dataclass(frozen=True)
class Passage:
    """A held-out passage, prepared for the check."""

    item_id: int
    words: list[str]
    triples: dict[tuple, list[int]]
    answers: frozenset


def _prepared(items: pd.DataFrame) -> list[Passage]:
    words = [words_of(p) for p in items["passage"]]
    pairs = [Counter(zip(w, w[1:])) for w in words]
    owners: Counter = Counter()
    for p in pairs:
        owners.update(p.keys())
    out = []
    for item_id, w, p in zip(items["item_id"], words, pairs, strict=True):
        if len(w) < 4:
            continue
        triples = defaultdict(list)
        for k in range(len(w) - 2):
            triples[tuple(w[k : k + 3])].append(k)
        out.append(Passage(item_id, w, dict(triples), frozenset(x for x in p if owners[x] == 1)))
    return out


def covered_share(passage: Passage, words: list[str], settings: Settings) -> float:
    """The share of the passage that stands in ``words`` as one stretch; 0 if the answer check fails."""
    pairs = [(i, j) for j in range(len(words) - 2) for i in passage.triples.get((words[j], words[j + 1], words[j + 2]), ())]
    if len(pairs) < 0.1 * len(passage.words):
        return 0.0
    chain = _chain(pairs)
    cuts = [0, *[k for k in range(1, len(chain)) if max(chain[k][0] - chain[k - 1][0], chain[k][1] - chain[k - 1][1]) > settings.max_drift], len(chain)]
    best = 0.0
    for a, b in zip(cuts, cuts[1:]):
        (i0, j0), (i1, j1) = chain[a], chain[b - 1]
        if (i1 + 3 - i0) < settings.min_share * len(passage.words):
            continue
        own, other = passage.words[i0 : i1 + 3], words[j0 : j1 + 3]
        share = common_subsequence(own, other) / len(passage.words)
        answers = {x for x in zip(own, own[1:]) if x in passage.answers}
        found = answers.intersection(zip(other, other[1:]))
        if share > best and len(found) >= settings.min_answers * len(answers):
            best = share
    return best


@dataclass(frozen=True)
class Space:
    """The held-out set, ready to be searched: passages, terms, projection, windows with their passage, clusters of windows."""

    passages: list[Passage]
    vocabulary: dict[str, int]
    weighted: np.ndarray
    squares: np.ndarray
    inside: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    centres: np.ndarray
    members: list[np.ndarray]
    settings: Settings
    floor: int  # terms of the held-out set that a text with a leak has at least

    def near(self, blocks: np.ndarray) -> set[tuple[int, int]]:
        """(block, passage) with a cosine of ``min_cosine`` or more, among the clusters that a block is near to."""
        found: set[tuple[int, int]] = set()
        probed = blocks @ self.centres.T >= self.settings.min_centre
        for cluster in np.flatnonzero(probed.any(axis=0)):
            rows, own = np.flatnonzero(probed[:, cluster]), self.members[cluster]
            hit = np.nonzero(blocks[rows] @ self.windows[own].T >= self.settings.min_cosine)
            if len(hit[0]):
                found.update(zip(rows[hit[0]].tolist(), self.owner[own[hit[1]]].tolist(), strict=True))
        return found

    def search(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """(item_id, share) of the passages that stand in a text."""
        settings, unknown = self.settings, len(self.vocabulary)
        at = np.fromiter(map(self.vocabulary.get, terms_of(words), repeat(unknown)), dtype=np.int64, count=len(words))
        if (at != unknown).sum() < self.floor:
            return
        starts = np.arange(0, len(at), settings.block)
        own, norms = np.add.reduceat(self.inside[at], starts), np.add.reduceat(self.squares[at], starts)
        ends = np.append(starts[1:], len(at))
        if len(starts) > 1:
            own, norms, starts, ends = own[:-1] + own[1:], norms[:-1] + norms[1:], starts[:-1], ends[1:]
        # a projection is no longer than what it projects: windows below can't reach the cosine
        likely = np.flatnonzero(own >= settings.min_cosine**2 * norms)
        if not len(likely):
            return
        near: dict[int, list[int]] = defaultdict(list)
        for a in range(0, len(likely), 512):
            part = likely[a : a + 512]
            blocks = np.array([self.weighted[at[starts[k] : ends[k]]].sum(axis=0) for k in part]) / np.sqrt(norms[part, None])
            for row, k in self.near(blocks):
                near[k].append(int(part[row]))
        for k, found in near.items():
            passage = self.passages[k]
            reach = len(passage.words) + settings.max_drift
            found = sorted(set(found))
            best, first = 0.0, found[0]
            for this, following in zip(found, [*found[1:], None]):
                if following is None or (following - this) * settings.block > reach:
                    region = words[max(0, first * settings.block - reach) : (this + 2) * settings.block + reach]
                    best = max(best, covered_share(passage, region, settings))
                    first = following
            if best >= settings.min_share:
                yield passage.item_id, best


def leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, share): the held-out passages that stand in a document and how much of them."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, share double"
    items = items.where("passage is not null").select("item_id", "passage")
    held = items.toPandas()  # the held-out set: a stated query set
    passages = _prepared(held)
    vocabulary = {t: k for k, t in enumerate(sorted({t for p in held["passage"] for t in terms_of(words_of(p))}))}
    if not passages:
        return spark.createDataFrame([], schema)
    df, n_docs = _document_frequencies(docs.where("text is not null"), vocabulary)
    idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32) + 0.1
    strange = float(np.log(1 + n_docs)) * 0.5 + 0.1  # weight of a term that no passage has
    basis = _latent_space(items, vocabulary, idf, settings)
    owner, rows = [], []
    for k, p in enumerate(passages):
        z = _window_rows(p.words, vocabulary, idf, settings, settings.block // 2) @ basis
        owner += [k] * len(z)
        rows.append(z)
    windows = np.concatenate(rows)
    windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
    owner = np.array(owner)
    centres, members = _clusters(windows, settings.seed)
    space = Space(
        passages, vocabulary, np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), dtype=np.float32)]), np.append(idf**2, np.float32(strange**2)),
        np.append(idf**2, np.float32(0)), windows, owner, centres, members, settings,
        min(settings.block // 2, max(1, int(settings.min_share * min(len(p.words) for p in passages)))),
    )
    shared = spark.sparkContext.broadcast(space)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, i, s) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, s in shared.value.search(words_of(t))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"]).astype({"doc_id": "Int64", "item_id": "Int64", "share": float})

    found = docs.where("text is not null").select("doc_id", "text").mapInPandas(scan, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
