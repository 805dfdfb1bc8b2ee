"""The ranker's base features of candidates, and ranking with them.

A candidate has the two probabilities, the cosines of its English and its foreign title's vector with the
mean of the other mentions of the document and with each of them (greatest and least), and with the
TF-IDF-weighted contexts of three sizes; ``rank_documents`` adds the cosines with the titles chosen
before. Title vectors have the key ``title_<title>``. A missing vector gives 0, and so does a mean or a
context of nothing. For English documents the foreign features are 0 and left out of ``features_of``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import vectors as V
from linkloom.operators import ranking, tokens
from linkloom.operators.lookup import Lookup
from linkloom.session import cut_lineage

SEQUENTIAL = ("PRETITLE_COS", "PRETITLE_COS_L", "PRE_MINMAX_MAX", "PRE_MINMAX_MIN", "PRE_MINMAX_L_MAX", "PRE_MINMAX_L_MIN")
_SURFACE = re.compile(r"[ \t\n\x0b\f\r]+|·")


def aliased(vectors: DataFrame) -> DataFrame:
    """Vectors with a copy of each for the languages that use another one's (English, of Spanish)."""
    own = vectors.where(~F.col("lang").isin(*ranking.VECTOR_LANGUAGE))
    out = own
    for lang, source in ranking.VECTOR_LANGUAGE.items():
        out = out.unionByName(own.where(F.col("lang") == source).withColumn("lang", F.lit(lang)))
    return out


def title_vectors(candidates: DataFrame, mapping: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, cand_lang, title, en_vec, l_vec): vectors of a candidate's English title and of its title in a foreign language.

    The foreign language is the candidate's, or for an English candidate the document's.
    """
    keys = candidates.select("lang", "cand_lang", "title").distinct()
    to_english = mapping.select(F.col("lang").alias("cand_lang"), "title", F.col("en_title").alias("_en"))
    from_english = mapping.groupBy("lang", F.col("en_title").alias("title")).agg(F.min("title").alias("_foreign"))
    named = keys.join(to_english, ["cand_lang", "title"], "left").join(from_english, ["lang", "title"], "left")
    english = F.when(F.col("cand_lang") == "en", F.col("title")).otherwise(F.col("_en"))
    foreign = F.when(F.col("cand_lang") != "en", F.col("title")).when(F.col("lang") != "en", F.col("_foreign"))
    foreign_lang = F.when(F.col("cand_lang") != "en", F.col("cand_lang")).otherwise(F.col("lang"))
    named = named.select("lang", "cand_lang", "title", F.concat(F.lit("title_"), english).alias("_ek"), F.concat(F.lit("title_"), foreign).alias("_fk"), foreign_lang.alias("_fl"))
    known = vectors.where("key like 'title\\\\_%'")
    en = known.where("lang = 'en'").select(F.col("key").alias("_ek"), F.col("vec").alias("en_vec"))
    other = known.where("lang != 'en'").select(F.col("lang").alias("_fl"), F.col("key").alias("_fk"), F.col("vec").alias("l_vec"))
    return named.join(en, "_ek", "left").join(other, ["_fl", "_fk"], "left").select("lang", "cand_lang", "title", "en_vec", "l_vec")


def other_means(vectors: DataFrame) -> DataFrame:
    """(doc_id, mention_id, other): for each row (doc_id, mention_id, mean) the mean of the other mentions' vectors of its document; none for a single one."""
    total = ranking.mean_vector(vectors.select("doc_id", F.col("mean").alias("vec")), ["doc_id"])
    sizes = vectors.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = vectors.join(total.withColumnRenamed("mean", "all"), "doc_id").join(sizes, "doc_id").where("n > 1")
    rest = F.zip_with("all", "mean", lambda t, x: (t * F.col("n") - x) / (F.col("n") - 1))
    return joined.select("doc_id", "mention_id", rest.alias("other"))


def extreme_cosines_to_others(wanted: DataFrame, others: DataFrame, block: int = 256) -> DataFrame:
    """(mention_id, title, cand_lang, NE_MINMAX_*): greatest and least cosine of a title's vectors with the vectors of the other mentions of its document.

    ``wanted`` has (doc_id, mention_id, title, cand_lang, en_vec, l_vec), ``others`` (doc_id, mention_id, mean). Both are cut
    into blocks by hash, so that a task multiplies two matrices of bounded size, however many mentions a document has.
    """
    names = ("NE_MINMAX_MAX", "NE_MINMAX_MIN", "NE_MINMAX_L_MAX", "NE_MINMAX_L_MIN")

    def parts(rows: DataFrame, name: str, *by: str) -> DataFrame:
        sizes = rows.groupBy("doc_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
        return rows.join(sizes, "doc_id").withColumn(name, F.pmod(F.xxhash64(*by), F.col("_n"))).drop("_n")

    left = parts(wanted, "_a", "mention_id", "title", "cand_lang").groupBy("doc_id", "_a").agg(F.collect_list(F.struct("mention_id", "title", "cand_lang", "en_vec", "l_vec")).alias("own"))
    right = parts(others, "_b", "mention_id").groupBy("doc_id", "_b").agg(F.collect_list(F.struct("mention_id", "mean")).alias("other"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, other in zip(batch["own"], batch["other"], strict=True):
                out = {c: [r[c] for r in own] for c in ("mention_id", "title", "cand_lang")}
                ids, o_ids = np.array(out["mention_id"]), np.array([r["mention_id"] for r in other])
                b = _unit(np.array([r["mean"] for r in other], dtype=float))
                same = ids[:, None] == o_ids[None, :]
                for vec, (most, least) in (("en_vec", names[:2]), ("l_vec", names[2:])):
                    has = np.array([r[vec] is not None for r in own])
                    a = _unit(np.array([r[vec] if r[vec] is not None else np.zeros(b.shape[1]) for r in own], dtype=float))
                    cos, skip = a @ b.T, same | ~has[:, None]
                    high, low = np.where(skip, -np.inf, cos).max(axis=1), np.where(skip, np.inf, cos).min(axis=1)
                    none = skip.all(axis=1)
                    out[most], out[least] = (pd.Series(np.where(none, np.nan, x)) for x in (high, low))
                yield pd.DataFrame(out)

    kinds = dict(wanted.dtypes)
    schema = f"mention_id {kinds['mention_id']}, title string, cand_lang string, " + ", ".join(f"{n} double" for n in names)
    found = left.join(right, "doc_id").select("own", "other").mapInPandas(multiply, schema)
    clean = found.select("mention_id", "title", "cand_lang", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    best = [(F.max(n) if n.endswith("MAX") else F.min(n)).alias(n) for n in names]
    return clean.groupBy("mention_id", "title", "cand_lang").agg(*best)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def static_features(
    mentions: DataFrame, candidates: DataFrame, docs: DataFrame, df: DataFrame, mapping: DataFrame, vectors: DataFrame, stop_words: DataFrame | None = None, ner_mode: bool = False
) -> DataFrame:
    """Candidates of mentions with the base features that don't depend on earlier choices, and their vectors.

    ``mentions`` has (mention_id, doc_id, lang, start, end, surface), ``candidates`` (mention_id, rank, title, cand_lang,
    p_title_given_surface, p_surface_given_title), ``docs`` the texts (doc_id, lang, text), ``df`` document frequencies.
    In tagging (``ner_mode``) the features of other entities are left out.
    """
    m = mentions.select("mention_id", "doc_id", "lang", "start", "end", "surface")
    rows = candidates.select(
        "mention_id", "rank", "title", "cand_lang", F.col("p_title_given_surface").alias("TITLEPROB"), F.col("p_surface_given_title").alias("SURFACEPROB")
    ).join(m.select("mention_id", "doc_id", "lang", "start"), "mention_id")
    known = title_vectors(rows, mapping, vectors)
    rows = cut_lineage(rows.join(known, ["lang", "cand_lang", "title"], "left"))

    def cosines(rows: DataFrame, side: DataFrame, vec: str, name: str) -> DataFrame:
        joined = rows.join(side, "mention_id", "left")
        return joined.withColumns({name: V.cosine(F.col("en_vec"), F.col(vec)), f"{name}_L": V.cosine(F.col("l_vec"), F.col(vec))}).drop(vec)

    if not ner_mode:
        own = cut_lineage(ranking.mention_vectors(m.where("surface is not null"), vectors).join(m.select("mention_id", "doc_id"), "mention_id"))
        extremes = extreme_cosines_to_others(rows.select("doc_id", "mention_id", "title", "cand_lang", "en_vec", "l_vec"), own)
        rows = cosines(rows, other_means(own).select("mention_id", "other"), "other", "NE_TITLE_COS").join(extremes, ["mention_id", "title", "cand_lang"], "left")
        rows = rows.fillna(0.0, [c for c in rows.columns if c.startswith("NE_MINMAX")])
    for name, half in ranking.HALF_WINDOWS.items():
        context = tokens.text_contexts(m.select("mention_id", "doc_id", "start", "end"), docs, half)
        weighted = tokens.context_tfidf(context, df)
        means = ranking.mean_vector(ranking.word_vectors(weighted, vectors, stop_words), ["mention_id"], "weight")
        rows = cosines(rows, means.withColumnRenamed("mean", "_context"), "_context", name)
    return rows


def rank_with_features(rows: DataFrame, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """(doc_id, mention_id, title, score, confidence): ``static_features`` ranked document by document with a linear model.

    ``names`` are the base features of the model in order, sequential ones included; ``weights`` are theirs, then those of
    their products; features beyond the weights count nothing.
    """
    static = [n for n in names if n not in SEQUENTIAL]
    order = [*static, *[n for n in SEQUENTIAL if n in names]]
    made = F.array(*[F.col(n) for n in static]).alias("features")
    return ranking.rank_sequentially(
        rows.select("doc_id", "mention_id", "start", "rank", "title", made, V.doubles(F.col("en_vec")).alias("vec"), V.doubles(F.col("l_vec")).alias("l_vec")),
        [n for n in SEQUENTIAL if n in names],
        ranking.weight_matrix(names, order, weights),
    )


def rank_texts(mentions: DataFrame, candidates: DataFrame, docs: DataFrame, df: DataFrame, mapping: DataFrame, vectors: DataFrame, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Mentions with ``wiki_title``, ``cand_lang`` and ``confidence``: what ``static_features`` and ``rank_with_features`` choose, in one walk over the documents.

    ``mentions`` has (mention_id, doc_id, lang, mention_type, start, end, surface, key), ``candidates`` those of the distinct
    (lang, surface), the surface being a mention's key. Texts, spans and numbers of vectors travel to the document, the
    vectors themselves are looked up there: a row carries none. Mentions without candidate keep nulls.
    """
    known = Lookup(vectors, df, aliased)
    found = candidates.select("lang", F.col("surface").alias("key"), "cand_lang", "title", "rank", F.col("p_title_given_surface").alias("tp"), F.col("p_surface_given_title").alias("sp"))
    found = found.join(title_vectors(found, mapping, known.numbered), ["lang", "cand_lang", "title"], "left")
    lists = found.groupBy("lang", "key").agg(F.collect_list(F.struct("rank", "title", "cand_lang", F.col("tp").cast("double").alias("tp"), F.col("sp").cast("double").alias("sp"), "en_vec", "l_vec")).alias("cands"))
    own = ("mention_id", "lang", "mention_type", "start", "end", "surface")
    spans = mentions.where("mention_id is not null and doc_id is not null").join(cut_lineage(lists), ["lang", "key"], "left").select("doc_id", F.struct(*own, "cands").alias("m"))
    # a document's texts are cut where they meet its mentions
    spans = spans.groupBy("doc_id").agg(F.collect_list("m").alias("mentions"))
    texts = docs.where("text is not null").groupBy("doc_id").agg(F.collect_list(F.struct("lang", "text")).alias("texts"))
    joined = spans.join(texts, "doc_id", "left").select("doc_id", "mentions", "texts")
    static = [n for n in names if n not in SEQUENTIAL]
    sequential = [n for n in SEQUENTIAL if n in names]
    ranker = TextRanker(known, static, sequential, ranking.weight_matrix(names, [*static, *sequential], weights))
    kinds = dict(mentions.dtypes)
    schema = f"doc_id {kinds['doc_id']}, " + ", ".join(f"{c} {kinds[c]}" for c in own) + ", wiki_title string, cand_lang string, confidence double"
    return joined.mapInArrow(ranker, schema)


class TextRanker:
    """Ranks the mentions of whole documents (doc_id, mentions, texts) with ``static`` and ``sequential`` features and the model ``w``."""

    #: Documents are taken together up to so many mentions; contexts are made for so many at a time.
    MENTIONS, CONTEXTS = 20_000, 4096

    def __init__(self, known: Lookup, static: Sequence[str], sequential: Sequence[str], w: np.ndarray) -> None:
        self.known, self.static, self.sequential, self.w = known, list(static), list(sequential), w

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(batch.column("mentions").value_lengths().to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + self.MENTIONS, side="right")))
                yield self.ranked(batch.slice(begin, end - begin))
                begin = end

    def ranked(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("mentions")
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        m = pa.Table.from_struct_array(lists.flatten()).append_column("_doc", pa.array(doc)).combine_chunks()
        # walked in order: by start, a missing one first, then by id
        order = pc.sort_indices(m, sort_keys=[("_doc", "ascending"), ("start", "ascending"), ("mention_id", "ascending")], null_placement="at_start")
        m = m.take(order).combine_chunks()
        doc = m.column("_doc").to_numpy()
        cands = m.column("cands").combine_chunks()
        sizes = pc.fill_null(cands.value_lengths(), 0).to_numpy(zero_copy_only=False)
        c = pa.Table.from_struct_array(cands.flatten())
        of = np.repeat(np.arange(len(doc)), sizes)
        en, foreign = (self.known.place_of_ids(pc.fill_null(c.column(x), 0).to_numpy(), c.column(x).is_valid().to_numpy()) for x in ("en_vec", "l_vec"))
        unit, unit_l = self.known.units(en), self.known.units(foreign)
        made = {"TITLEPROB": c.column("tp").to_numpy(), "SURFACEPROB": c.column("sp").to_numpy()}
        made |= self._others(m, doc, of, en, foreign, unit, unit_l)
        made |= self._contexts(m, doc, batch.column("texts"), of, unit, unit_l)
        static = np.column_stack([np.zeros((len(of), 0)), *[made[n] for n in self.static]])
        best, share = self._walk(doc, of, sizes, static, c.column("rank").to_numpy(), c.column("title"), en, unit, unit_l)
        chosen = c.take(pa.array(best, pa.int64(), mask=best < 0))
        own = [m.column(x).combine_chunks() for x in ("mention_id", "lang", "mention_type", "start", "end", "surface")]
        columns = [batch.column("doc_id").take(pa.array(doc)), *own, chosen.column("title").combine_chunks(), chosen.column("cand_lang").combine_chunks(), pa.array(share, pa.float64(), mask=best < 0)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mention_id", "lang", "mention_type", "start", "end", "surface", "wiki_title", "cand_lang", "confidence"])

    def _others(self, m: pa.Table, doc: np.ndarray, of: np.ndarray, en: np.ndarray, foreign: np.ndarray, unit: np.ndarray, unit_l: np.ndarray) -> dict[str, np.ndarray]:
        """Cosines with the other mentions of the document: with their mean, the greatest and the least."""
        n_cands, dim = unit.shape
        out = {n: np.zeros(n_cands) for n in ("NE_TITLE_COS", "NE_TITLE_COS_L", "NE_MINMAX_MAX", "NE_MINMAX_MIN", "NE_MINMAX_L_MAX", "NE_MINMAX_L_MIN")}
        words, at, vector_of = [], [], self.known.vector_of_words()
        for i, (lang, surface) in enumerate(zip(m.column("lang").to_pylist(), m.column("surface").to_pylist(), strict=True)):
            if lang is not None and surface is not None:
                found = self.known.place_of_words(lang, [w for w in _SURFACE.split(surface.lower()) if w])
                words.append(found)
                at.append(np.full(len(found), i))
        if not words:
            return out
        words, at = np.concatenate(words), np.concatenate(at)
        places = np.where(words >= 0, vector_of[words], 0)
        words, at = places[places > 0], at[places > 0]
        if not len(at):
            return out
        mean = np.zeros((len(doc), dim))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        owner = at[first]
        mean[owner] = np.add.reduceat(self.known.rows(words), first, axis=0) / np.diff(np.append(first, len(at)))[:, None]
        has = np.zeros(len(doc), bool)
        has[owner] = True
        begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sums, number = np.add.reduceat(mean, begins, axis=0)[doc], np.add.reduceat(has.astype(int), begins)[doc]
        other = _unit(np.where((has & (number > 1))[:, None], sums - mean, 0))
        out["NE_TITLE_COS"], out["NE_TITLE_COS_L"] = (np.einsum("ij,ij->i", u, other[of]) for u in (unit, unit_l))
        mean = _unit(mean)
        ends, cuts = np.append(begins[1:], len(doc)), np.searchsorted(of, np.append(begins, len(doc)))
        for k, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            there = np.flatnonzero(has[a:b])
            if cuts[k] == cuts[k + 1] or not len(there):
                continue
            vec = mean[a + there].T
            column = np.full(b - a, -1)
            column[there] = np.arange(len(there))
            step = max(1, 4_000_000 // len(there))  # a long document is multiplied in blocks
            for lo in range(int(cuts[k]), int(cuts[k + 1]), step):
                part = slice(lo, min(lo + step, int(cuts[k + 1])))
                own = column[of[part] - a]
                rows = np.flatnonzero(own >= 0)
                none = (own >= 0) & (len(there) == 1)
                for side, u, name in ((en, unit, "NE_MINMAX"), (foreign, unit_l, "NE_MINMAX_L")):
                    cos, skip = u[part] @ vec, none | (side[part] == 0)
                    cos[rows, own[rows]] = -np.inf
                    out[f"{name}_MAX"][part] = np.where(skip, 0.0, cos.max(axis=1))
                    cos[rows, own[rows]] = np.inf
                    out[f"{name}_MIN"][part] = np.where(skip, 0.0, cos.min(axis=1))
        return out

    def _contexts(self, m: pa.Table, doc: np.ndarray, texts: pa.Array, of: np.ndarray, unit: np.ndarray, unit_l: np.ndarray) -> dict[str, np.ndarray]:
        """Cosines with the TF-IDF-weighted means of the words around a mention, for each size of the context."""
        out = {f"{n}{x}": np.zeros(len(of)) for n in ranking.HALF_WINDOWS for x in ("", "_L")}
        valid = pc.fill_null(pc.and_(pc.greater_equal(m.column("start"), 0), pc.greater(m.column("end"), m.column("start"))), False).to_numpy()
        start, end = (pc.fill_null(m.column(x), 0).to_numpy() for x in ("start", "end"))
        words, spans, at = [], [], 0
        # a mention without candidate needs no context
        wanted = np.flatnonzero(valid & (np.bincount(of, minlength=len(doc)) > 0))
        edges = np.searchsorted(doc[wanted], np.arange(len(texts) + 1))
        for row, found in enumerate(texts.to_pylist()):
            mine = wanted[edges[row] : edges[row + 1]]
            for text in found or () if len(mine) else ():
                pieces, token_ends, _ = tokens._pieces(text["text"])
                token_starts = token_ends - np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
                first = np.searchsorted(token_ends, start[mine], side="right")
                last = np.searchsorted(token_starts, end[mine], side="left") - 1
                hit = first <= last
                words.append(self.known.place_of_words(text["lang"], pieces))
                spans.append(np.column_stack([mine, at + first, at + last, np.full(len(mine), at), np.full(len(mine), at + len(pieces))])[hit])
                at += len(pieces)
        if not at or not sum(map(len, spans)):
            return out
        words, spans = np.concatenate(words), np.concatenate(spans)
        # the texts of a document under one id make one context
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        lo = 0
        while lo < len(spans):
            hi = int(np.searchsorted(spans[:, 0], spans[min(lo + self.CONTEXTS, len(spans)) - 1, 0], side="right"))
            self._context_cosines(spans[lo:hi], words, of, unit, unit_l, out)
            lo = hi
        return out

    def _context_cosines(self, spans: np.ndarray, words: np.ndarray, of: np.ndarray, unit: np.ndarray, unit_l: np.ndarray, out: dict[str, np.ndarray]) -> None:
        df, vector_of = self.known.df(), self.known.vector_of_words()
        base, n = spans[0, 0], int(spans[-1, 0] - spans[0, 0]) + 1
        row = spans[:, 0] - base
        part = slice(*np.searchsorted(of, [base, base + n]).tolist())
        of_row = of[part] - base
        for name, half in ranking.HALF_WINDOWS.items():
            step = np.arange(half)
            left, right = spans[:, 1:2] - 1 - step, spans[:, 2:3] + 1 + step
            inside = np.concatenate([left >= spans[:, 3:4], right < spans[:, 4:5]], axis=1)
            owner = np.repeat(row, inside.sum(axis=1))
            around = words[np.concatenate([left, right], axis=1)[inside]]
            total = np.bincount(owner, minlength=n)
            seen = around >= 0
            keys, cnt = np.unique(owner[seen] * len(df) + around[seen], return_counts=True)
            owner, word = np.divmod(keys, len(df))
            own_df = df[word]
            counted = ~np.isnan(own_df)
            owner, word, own_df, cnt = owner[counted], word[counted], own_df[counted], cnt[counted]
            sums = np.bincount(owner, weights=own_df, minlength=n)
            weight = cnt / total[owner] * np.log(sums[owner] / own_df)
            place = vector_of[word]
            used = (place > 0) & (weight > 0)
            owner, weight, place = owner[used], weight[used], place[used]
            if not len(owner):
                continue
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            mean = np.zeros((n, unit.shape[1]))
            mean[owner[first]] = np.add.reduceat(self.known.rows(place) * weight[:, None], first, axis=0)
            mean = _unit(mean)[of_row]
            out[name][part], out[f"{name}_L"][part] = (np.einsum("ij,ij->i", u[part], mean) for u in (unit, unit_l))

    def _walk(self, doc: np.ndarray, of: np.ndarray, sizes: np.ndarray, static: np.ndarray, ranks: np.ndarray, titles: pa.ChunkedArray, en: np.ndarray, unit: np.ndarray, unit_l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best candidate of each mention or -1, its confidence); the documents go side by side, one mention of each at a step."""
        best, share = np.full(len(doc), -1), np.zeros(len(doc))
        asked = np.flatnonzero(sizes > 0)
        if not len(asked):
            return best, share
        begin = np.concatenate([[0], np.cumsum(sizes)])
        docs, first, count = np.unique(doc[asked], return_index=True, return_counts=True)
        number = np.searchsorted(docs, doc[of])  # each candidate's document
        last = begin[asked[first + count - 1] + 1]  # the place behind a document's candidates
        long = np.argsort(-count, kind="stable")
        # titles are told by number; a title chosen twice changes neither the greatest nor the least
        title = number * (len(of) + 1) + titles.combine_chunks().dictionary_encode().indices.to_numpy()
        title = np.unique(title, return_inverse=True)[1]
        seen = np.zeros(int(title.max()) + 1, bool)
        total, chosen = np.zeros((len(docs), unit.shape[1])), np.zeros(len(docs), np.int64)
        extremes = {n: np.full(len(of), -np.inf if n.endswith("MAX") else np.inf) for n in self.sequential if not n.startswith("PRETITLE")}
        for step in range(int(count.max())):
            active = long[: np.searchsorted(-count[long], -step, side="left")]
            who = asked[first[active] + step]
            size = sizes[who]
            offset = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(begin[who] - offset, size)
            mine = np.repeat(np.arange(len(active)), size)
            ready = chosen[active[mine]] > 0
            columns = []
            for name in self.sequential:
                u = unit_l if "_L" in name else unit
                if name.startswith("PRETITLE"):
                    columns.append(np.where(ready, np.einsum("ij,ij->i", u[at], _unit(total[active])[mine]), 0.0))
                else:
                    columns.append(np.where(ready & (u[at] != 0).any(axis=1), extremes[name][at], 0.0))
            x = np.column_stack([static[at], *columns, np.ones(len(at))])
            score = ((x @ self.w) * x).sum(axis=1)
            order = np.lexsort((ranks[at], -score, mine))
            top = order[offset]
            best[who] = picked = at[top]
            follows = order[np.minimum(offset + 1, len(order) - 1)]
            share[who] = np.where(size > 1, 1.0 / (1.0 + np.exp(np.minimum(700.0, score[follows] - score[top]))), 1.0)
            has = en[picked] > 0
            active, picked = active[has], picked[has]
            total[active] += self.known.rows(en[picked])
            chosen[active] += 1
            new = ~seen[title[picked]]
            seen[title[picked]] = True
            active, picked = active[new], picked[new]
            if len(active) and extremes:
                # all candidates of a document that come later
                length = last[active] - picked
                later = np.arange(int(length.sum())) + np.repeat(picked - (np.cumsum(length) - length), length)
                vec = unit[np.repeat(picked, length)]
                for side, u in (("", unit), ("_L", unit_l)):
                    wanted = [n for n in extremes if ("_L" in n) == bool(side)]
                    cos = np.einsum("ij,ij->i", u[later], vec) if wanted else None
                    for n in wanted:
                        extremes[n][later] = (np.maximum if n.endswith("MAX") else np.minimum)(extremes[n][later], cos)
        return best, share
