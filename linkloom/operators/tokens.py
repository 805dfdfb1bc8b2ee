"""Tokens, sentences, n-grams and context windows.

Tokens are runs of letters, marks and digits or single other characters, with code-point offsets; white
space carries the offsets but makes no token. A sentence ends behind an end mark or a line break. Null or
empty texts have no tokens.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import text as X
from linkloom.session import cut_lineage

END_MARKS = (".", "!", "?", "。", "！", "？", "।")
BIN = 256
# Stop words of all languages together that are sent to every task at most.
MAX_STOPS = 100_000
# Logarithm of the most bits that known surfaces are told by.
MOST_BITS = 28
_BASE, _FULL = 0x2545F4914F6CDD1D, (1 << 64) - 1


_BLANK = " \t\n\x0b\f\r"  # white space of the JVM's patterns
_IS_BLANK, _CLOSES = 1, 2
_TOKEN = "struct<tok_id:int,token:string,start:long,end:long>"


@lru_cache(maxsize=1)
def _piece() -> re.Pattern:
    """White space, a run of letters, marks and digits, or another single character; classes as ranges, which match fastest."""
    inside = [unicodedata.category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(1, len(inside)) if inside[c] != inside[c - 1]]  # no letter is the first character
    ranges = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2] + [len(inside)] * (len(edges) % 2), strict=True))
    return re.compile(rf"[{_BLANK}]+|[{ranges}]+|[^{_BLANK}{ranges}]")


class _Flags(dict):
    """Piece -> whether it is white space and whether it ends a sentence; emptied when it grows large."""

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        blank = piece[0] in _BLANK
        self[piece] = flags = _IS_BLANK * blank + _CLOSES * (piece in END_MARKS or (blank and "\n" in piece))
        return flags


_FLAGS = _Flags()


def _pieces(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, their end offsets, their sentences)."""
    found = _piece().findall(text)
    flags = np.fromiter(map(_FLAGS.__getitem__, found), dtype=np.int8, count=len(found))
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
    closes = flags >= _CLOSES
    kept = flags & _IS_BLANK == 0
    return list(compress(found, kept.tolist())), ends[kept], (np.cumsum(closes) - closes)[kept]


def _folded(text: str) -> str:
    """Lower case in which a text is made of its parts: both small sigmas are one."""
    return text.lower().replace("ς", "σ")


def _mixed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in a table of 2 to the ``bits`` bits."""
    return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _hash(text: str) -> tuple[int, int]:
    """A text's hash and the factor by which it moves the hash of what stands before it, so that hashes of n-grams come from those of tokens."""
    h, factor = 0, 1
    for c in text:
        h, factor = (h * _BASE + ord(c) + 1) & _FULL, (factor * _BASE) & _FULL
    return h, factor


class _Parts(dict):
    """Token -> its place among the hashes, factors and capitals of the distinct tokens; emptied when it grows large."""

    def __init__(self) -> None:
        super().__init__()
        self.size, self.hashes, self.factors, self.capitals = 0, np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def __missing__(self, token: str) -> int:
        if self.size == len(self.hashes):
            self.hashes, self.factors, self.capitals = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hashes, self.factors, self.capitals))
        cut, at = token.split("'", 1)[0], self.size
        self.hashes[at], self.factors[at] = _hash(_folded(cut))
        self.capitals[at] = unicodedata.category(cut[0]) == "Lu" if cut else False
        self[token] = at
        self.size += 1
        return at


_PARTS = _Parts()


class KnownGrams:
    """Tells of n-grams whether their lower-case form may be among known surfaces; with ``singles`` capitalised tokens may also be among those.

    Surfaces are bits in tables of bounded size. A surface that is known is never missed; others may pass by chance, so that
    what passes still has to be looked up.
    """

    def __init__(self, surfaces: DataFrame, singles: DataFrame | None = None, longest: int = 4) -> None:
        self.longest = longest
        self.every = self._bits(surfaces)
        self.single = self._bits(singles) if singles is not None else None

    @staticmethod
    def _bits(surfaces: DataFrame) -> tuple[np.ndarray, int]:
        """(table of bits, logarithm of its size) of the first column."""
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.array([_hash(_folded(x))[0] for x in batch.column(0).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_mixed(found, MOST_BITS)).astype(np.int64))], names=["place"])

        name = surfaces.columns[0]
        places = surfaces.where(F.col(name).isNotNull()).select(name).mapInArrow(hashed, "place long").distinct().toArrow().column("place").to_numpy()
        # the first bits of a place are its place in a smaller table
        bits = min(MOST_BITS, max(16, int(len(places) * 64).bit_length()))
        table = np.zeros((1 << bits) // 8, np.uint8)
        places = places >> (MOST_BITS - bits)
        np.bitwise_or.at(table, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        return table, bits

    @staticmethod
    def _holds(known: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
        table, bits = known
        places = _mixed(hashes, MOST_BITS) >> np.uint64(MOST_BITS - bits)
        return (table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def hits(self, words: list[str], ends: np.ndarray, chinese: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, first tokens of the n-grams that may be known) for n from 1 on; ``ends`` are the places behind each token's sentence."""
        if len(_PARTS) > 500_000:
            _PARTS.clear()
            _PARTS.size = 0
        at = np.fromiter(map(_PARTS.__getitem__, words), dtype=np.int64, count=len(words))
        hashes, factors = _PARTS.hashes[at], _PARTS.factors[at]
        hits = self._holds(self.every, hashes)
        if self.single is not None:
            capitals = np.flatnonzero(_PARTS.capitals[at] & ~hits)
            hits[capitals] = self._holds(self.single, hashes[capitals])
        gram, first = hashes, np.arange(len(words))
        for n in range(1, self.longest + 1):
            if n > 1:
                fits = first + n <= ends[first]
                gram, first = gram[fits], first[fits]
                last = first + n - 1
                gram = np.where(chinese[first], gram, gram * np.uint64(_BASE) + np.uint64(ord(" ") + 1)) * factors[last] + hashes[last]
                hits = self._holds(self.every, gram)
            yield n, first[hits]

    def covered(self, words: list[str], ends: np.ndarray, chinese: np.ndarray) -> np.ndarray:
        """Which of the tokens lie in an n-gram that may be known."""
        edges = np.zeros(len(words) + 1, np.int64)
        for n, begin in self.hits(words, ends, chinese):
            edges[begin] += 1
            edges[begin + n] -= 1
        return np.cumsum(edges[:-1]) > 0

    def runs(self, words: list[str], sizes: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens kept, places in these where a run begins, each token's list) of lists of ``sizes`` tokens."""
        of_list = np.repeat(np.arange(len(sizes)), sizes)
        chinese = pc.fill_null(pc.equal(langs, "zh"), False).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(self.covered(words, np.cumsum(sizes)[of_list], chinese[of_list]))
        # a run begins where a token is missing or another list begins
        begins = (np.diff(kept) > 1) | (np.diff(of_list[kept]) > 0)
        return kept, np.concatenate([[0], np.flatnonzero(begins) + 1]), of_list


def token_lists(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", known: KnownGrams | None = None) -> DataFrame:
    """(doc_id, lang, sent_id, toks): the tokens (tok_id, token, start, end) of each sentence; no shuffle.

    Running offsets and numbers are made where the text is cut, so that no token has to be sorted. With ``known`` a sentence
    is cut to the runs of tokens, a row for each, that n-grams which may be known cover; others have neither types nor a type to take.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.struct([("tok_id", pa.int32()), ("token", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            of, sent, sizes, words, ids, ends = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                found, end, sentence = _pieces(text)
                if found:
                    number, count = np.unique(sentence, return_counts=True)
                    of.append(np.full(len(number), row))
                    sent.append(number)
                    sizes.append(count)
                    words += found
                    ids.append(np.arange(len(found), dtype=np.int32))
                    ends.append(end)
            if not of:
                continue
            end = np.concatenate(ends)
            start = end - np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            number, row, sentence, size = (np.concatenate(x) for x in (ids, of, sent, sizes))
            if known is not None:
                kept, first, of_list = known.runs(words, size, batch.column("lang").take(pa.array(row)))
                if not len(kept):
                    continue
                words, number, start, end = [words[i] for i in kept.tolist()], number[kept], start[kept], end[kept]
                size = np.diff(np.concatenate([first, [len(kept)]]))
                row, sentence = row[of_list[kept[first]]], sentence[of_list[kept[first]]]
            parts = pa.StructArray.from_arrays([pa.array(number), pa.array(words, pa.string()), pa.array(start), pa.array(end)], fields=list(fields))
            bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("lang").take(rows), pa.array(sentence), pa.ListArray.from_arrays(pa.array(bounds), parts)],
                names=["doc_id", "lang", "sent_id", "toks"],
            )

    narrow = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(cut, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, sent_id long, toks array<{_TOKEN}>")


def cut_to_known(lists: DataFrame, known: KnownGrams) -> DataFrame:
    """Rows of ``token_lists`` cut to the runs of tokens that n-grams which may be known cover, a row for each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("toks")
            flat, sizes = toks.flatten(), pc.fill_null(toks.value_lengths(), 0).to_numpy(zero_copy_only=False)
            kept, first, of_list = known.runs(flat.field("token").to_pylist(), sizes, batch.column("lang"))
            if len(kept):
                rows = pa.array(of_list[kept[first]])
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(kept)]]).astype(np.int32)), flat.take(pa.array(kept)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "lang", "sent_id")), made], names=["doc_id", "lang", "sent_id", "toks"])

    narrow = lists.select("doc_id", "lang", "sent_id", "toks")
    return narrow.mapInArrow(cut, narrow.schema)


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, tok_id, token, start, end, sent_id); tok_id and sent_id count from 0."""
    return exploded(token_lists(docs, doc_id, text, lang))


def exploded(lists: DataFrame) -> DataFrame:
    """Rows of ``token_lists`` as rows of ``tokens``."""
    each = lists.select("doc_id", "lang", "sent_id", F.explode("toks").alias("t"))
    return each.select("doc_id", "lang", "t.tok_id", "t.token", "t.start", "t.end", "sent_id")


def listed(toks: DataFrame) -> DataFrame:
    """Rows of ``tokens`` as rows of ``token_lists``; lists stay as they are."""
    if "toks" in toks.columns:
        return toks
    each = F.array_sort(F.collect_list(F.struct(F.col("tok_id").cast("int").alias("tok_id"), "token", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    return toks.groupBy("doc_id", "lang", "sent_id").agg(each.alias("toks"))


def _with_own_stops(lists: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Lists with ``_stops``: those of their own words that are stop words, found by a join on language and word."""
    keyed = cut_lineage(lists.withColumn("_k", F.monotonically_increasing_id()))
    words = keyed.select("_k", "lang", F.explode(F.array_distinct(F.transform("toks", lambda t: F.lower(X.cut_apostrophe(t["token"]))))).alias("word"))
    own = words.join(stop_words.select("lang", "word").distinct(), ["lang", "word"], "left_semi").groupBy("_k").agg(F.collect_set("word").alias("_stops"))
    return keyed.join(own, "_k", "left").drop("_k")


def ngrams_upto(toks: DataFrame, longest: int, stop_words: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, sent_id, tok_id, n, surface, start, end, is_stop) of 1 to ``longest`` tokens in one sentence.

    ``toks`` are rows of ``token_lists`` (cut without a shuffle) or of ``tokens``. Tokens are cut at the
    apostrophe; an n-gram of stop words only is flagged.
    """
    lists = listed(toks)
    cut = F.transform("toks", lambda t: X.cut_apostrophe(t["token"]))
    if stop_words is None:
        marked = lists.withColumn("_stops", F.array().cast("array<string>"))
    else:
        stops = cut_lineage(stop_words.where("lang is not null and word is not null").groupBy("lang").agg(F.collect_set("word").alias("_stops")))
        n_words = stops.agg(F.coalesce(F.sum(F.size("_stops")), F.lit(0)).alias("n")).first()["n"]
        # a checked, small list goes to the sentences; with a larger one the few keys would gather all sentences, so words are joined
        marked = lists.join(F.broadcast(stops), "lang", "left") if n_words <= MAX_STOPS else _with_own_stops(lists, stop_words)
        marked = marked.withColumn("_stops", F.coalesce("_stops", F.array().cast("array<string>")))
    marked = marked.select("doc_id", "lang", "sent_id", "toks", cut.alias("_cut"), "_stops")
    marked = marked.withColumn("_stop", F.transform("_cut", lambda c: F.array_contains("_stops", F.lower(c))))
    at = marked.select("doc_id", "lang", "sent_id", "toks", "_cut", "_stop", F.explode(F.sequence(F.lit(0), F.size("toks") - 1)).alias("_i"))

    # single look-ups instead of functions over slices, which the JVM doesn't compile
    ahead = lambda c, k: F.get(c, F.col("_i") + k)
    blank = F.when(F.col("lang") == "zh", F.lit("")).otherwise(F.lit(" "))
    surface, stop, grams = ahead("_cut", 0), ahead("_stop", 0), []
    for n in range(1, longest + 1):
        if n > 1:
            surface, stop = F.concat(surface, F.coalesce(blank, F.lit(" ")), ahead("_cut", n - 1)), stop & ahead("_stop", n - 1)
        gram = F.struct(F.lit(n).alias("n"), ahead("toks", n - 1)["end"].alias("end"), surface.alias("surface"), stop.alias("is_stop"))
        grams.append(F.when(F.col("_i") + n <= F.size("toks"), gram))
    fits = F.array(*grams)
    first = F.get("toks", F.col("_i"))
    each = at.select("doc_id", "lang", "sent_id", first["tok_id"].alias("tok_id"), first["start"].alias("start"), F.explode(fits).alias("g"))
    return each.where("g is not null").select("doc_id", "lang", "sent_id", "tok_id", "g.n", "g.surface", "start", "g.end", "g.is_stop")


def ngrams(toks: DataFrame, n: int, stop_words: DataFrame | None = None) -> DataFrame:
    """The n-grams of exactly n tokens."""
    return ngrams_upto(toks, n, stop_words).where(F.col("n") == n)


def stop_words(docs: DataFrame, punctuation: Sequence[str] = (), k: int = 50) -> DataFrame:
    """(lang, word): the k most frequent words of each language, with the punctuation list of all."""
    words = top_words(docs, k).select("lang", "word")
    if not punctuation:
        return words
    marks = words.select("lang").distinct().select("lang", F.explode(F.array(*[F.lower(F.trim(F.lit(p))) for p in punctuation])).alias("word"))
    return words.unionByName(marks).distinct()


def top_words(docs: DataFrame, k: int = 50) -> DataFrame:
    """(lang, word, cnt, rank): the k most frequent white-space words of each language without title tokens."""
    words = docs.where("text is not null and lang is not null").select("lang", F.explode(X.tokens_of(F.lower("text"))).alias("word"))
    counted = words.where(~F.col("word").startswith("title_")).groupBy("lang", "word").agg(F.count("*").alias("cnt"))
    order = Window.partitionBy("lang").orderBy(F.desc("cnt"), "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_frequency(docs: DataFrame) -> DataFrame:
    """(lang, word, df): in how many lines each lower-case word stands."""
    lines = docs.where("text is not null and lang is not null").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select("lang", F.explode(F.array_distinct(X.tokens_of(F.lower("line")))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("df"))


def token_spans(spans: DataFrame, toks: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, doc_id, first_tok, last_tok): the tokens that overlap each character span.

    Both sides are cut into bins of ``BIN`` characters, so that the join has equal keys and a long
    document isn't compared with itself.
    """
    bins = lambda a, b: F.explode(F.sequence((a / BIN).cast("long"), ((b - 1) / BIN).cast("long")))
    wanted = spans.where("start is not null and end is not null and start >= 0 and end > start").select(key, "doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    left = wanted.withColumn("bin", bins(F.col("s"), F.col("e")))
    right = toks.select("doc_id", "tok_id", "start", "end").withColumn("bin", bins(F.col("start"), F.col("end")))
    hits = left.join(right, ["doc_id", "bin"]).where("start < e and s < end")
    return hits.groupBy(key, "doc_id").agg(F.min("tok_id").alias("first_tok"), F.max("tok_id").alias("last_tok"))


def context_words(spans: DataFrame, toks: DataFrame, half_window: int, key: str = "mention_id") -> DataFrame:
    """(key, doc_id, lang, word): the tokens within ``half_window`` of a span, without its own."""
    at = token_spans(spans, toks, key)
    places = at.select(
        key, "doc_id", F.explode(F.concat(
            F.sequence(F.col("first_tok") - half_window, F.col("first_tok") - 1),
            F.sequence(F.col("last_tok") + 1, F.col("last_tok") + half_window),
        )).alias("tok_id"),
    )
    return places.join(toks.select("doc_id", "tok_id", "lang", F.lower("token").alias("word")), ["doc_id", "tok_id"]).select(key, "doc_id", "lang", "word")


def text_contexts(spans: DataFrame, docs: DataFrame, half_window: int, key: str = "mention_id", block: int = 1000) -> DataFrame:
    """``context_words`` straight from texts (doc_id, lang, text): (key, doc_id, lang, word).

    A document's spans travel to its text in blocks of about ``block``, where each takes its slice of the tokens; neither
    tokens nor places are shuffled.
    """
    wanted = spans.where("start is not null and end is not null and start >= 0 and end > start").select(F.col(key).alias("k"), "doc_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    sizes = wanted.groupBy("doc_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    parted = wanted.join(sizes, "doc_id").withColumn("_b", F.pmod(F.xxhash64("k"), F.col("_n")))
    lists = parted.groupBy("doc_id", "_b").agg(F.collect_list(F.struct("k", "s", "e")).alias("spans"))
    joined = docs.where("text is not null").select("doc_id", "lang", "text").join(lists, "doc_id").select("doc_id", "lang", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cells = batch.column("spans"), batch.column("spans").flatten()
            keys, starts, ends = (cells.field(i) for i in range(3))
            starts, ends = starts.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows, picked, words, bounds, at = [], [], [], [0], 0
            for row, (text, n) in enumerate(zip(batch.column("text").to_pylist(), counts.tolist(), strict=True)):
                found, token_ends, _ = _pieces(text)
                token_starts = token_ends - np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                first = np.searchsorted(token_ends, starts[at : at + n], side="right")
                last = np.searchsorted(token_starts, ends[at : at + n], side="left") - 1
                for i in np.flatnonzero(first <= last).tolist():
                    a, b = int(first[i]), int(last[i]) + 1
                    words += found[max(0, a - half_window) : a]
                    words += found[b : b + half_window]
                    bounds.append(len(words))
                    rows.append(row)
                    picked.append(at + i)
                at += n
            rows = pa.array(rows, pa.int64())
            words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words, pa.string()))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(picked, pa.int64())), batch.column("doc_id").take(rows), batch.column("lang").take(rows), words], names=["k", "doc_id", "lang", "words"])

    kinds = dict(joined.dtypes)
    made = joined.mapInArrow(cut, f"k {dict(wanted.dtypes)['k']}, doc_id {kinds['doc_id']}, lang {kinds['lang']}, words array<string>")
    return made.select(F.col("k").alias(key), "doc_id", "lang", F.explode("words").alias("word")).withColumn("word", F.lower("word"))


def context_tfidf(context: DataFrame, df: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, word, tf, idf, weight): tf is the share in the context, idf the log of the context's summed df over the word's df; 0 without df."""
    counted = context.groupBy(key, "lang", "word").agg(F.count("*").alias("cnt"))
    known = counted.join(df, ["lang", "word"], "left")
    own = Window.partitionBy(key)
    scored = known.select(
        key,
        "lang",
        "word",
        (F.col("cnt") / F.sum("cnt").over(own)).alias("tf"),
        F.coalesce(F.ln(F.sum("df").over(own) / F.col("df")), F.lit(0.0)).alias("idf"),
    )
    return scored.withColumn("weight", F.col("tf") * F.col("idf"))


def substituted_text(docs: DataFrame, spans: DataFrame, min_chars: int = 6) -> DataFrame:
    """(doc_id, sent_id, text): sentences with linked spans replaced by ``TITLE_<title>``; short sentences are dropped.

    ``spans`` has (doc_id, start, end, title); of overlapping spans the first counts.
    """
    toks = tokens(docs)
    keyed = spans.select(F.monotonically_increasing_id().alias("_k"), "doc_id", "start", "end", "title")
    at = token_spans(keyed, toks, "_k").join(keyed.select("_k", "title"), "_k")
    covered = at.select("doc_id", "title", "first_tok", F.explode(F.sequence("first_tok", "last_tok")).alias("tok_id"))
    first = covered.groupBy("doc_id", "tok_id").agg(F.min(F.struct("first_tok", "title")).alias("c"))
    marked = toks.join(first, ["doc_id", "tok_id"], "left").where("c is null or c.first_tok = tok_id")
    word = F.when(F.col("c").isNull(), F.col("token")).otherwise(F.concat(F.lit("TITLE_"), F.col("c.title")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tok_id", word.alias("w")))), lambda e: e["w"])
    return marked.groupBy("doc_id", "sent_id").agg(F.array_join(ordered, " ").alias("text")).where(F.length("text") >= min_chars)
