"""Type features of n-grams and a tagger that learns from them.

N-grams are linked from the longest to the shortest; shorter ones inside a linked n-gram take its type
features and aren't linked themselves. Only n-grams that occur as surfaces in the index are linked, so
the cascade works on the few n-grams that hit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import text as X
from linkloom.functions import vectors as V
from linkloom.operators import candidates, kb
from linkloom.operators.intervals import bio_decode, propagate_types
from linkloom.operators.lookup import SurfaceTypes
from linkloom.operators.numbering import bounded_sample
from linkloom.operators.tokens import MAX_STOPS, KnownGrams, cut_to_known, listed, ngrams_upto, token_lists
from linkloom.session import cut_lineage

MAIN_TYPES = ("location", "person", "organization")
# Coarse types of the knowledge base that the features speak of in other words.
TYPE_TOKENS = {"people": "person"}
_NUMBER = re.compile(X._NUMBER)
LABEL_OF = {"person": "PER", "organization": "ORG", "location": "LOC"}


def type_features(coarse: Column, prefix: str, only: tuple[str, ...] | None = None) -> Column:
    """``<prefix>FBTYPETOKEN-<type>`` for each coarse type."""
    kept = F.filter(coarse, lambda t: t.isin(*only)) if only else coarse
    return F.transform(F.coalesce(kept, F.array().cast("array<string>")), lambda t: F.concat(F.lit(f"{prefix}FBTYPETOKEN-"), t))


def neighbour_features(mentions: DataFrame, coarse: DataFrame, use_next: bool = False, order: tuple[str, ...] = ("start", "mention_id")) -> DataFrame:
    """(mention_id, features): types of the mention, of the one before and, if asked, of the one behind.

    A stop n-gram has the feature ISSTOPWORD only; a neighbour that is one gives nothing.
    """
    typed = mentions.join(coarse, "mid", "left")
    w = Window.partitionBy("doc_id").orderBy(*order)
    usable = F.when(~F.col("is_stop"), F.col("coarse"))
    before = type_features(F.lag(usable).over(w), "BEFORE", MAIN_TYPES)
    after = type_features(F.lead(usable).over(w), "AFTER", MAIN_TYPES) if use_next else F.array().cast("array<string>")
    own = F.concat(type_features(F.col("coarse"), "TOP"), before, after)
    features = F.when(F.col("is_stop"), F.array(F.lit("ISSTOPWORD"))).when(X.is_nil(F.col("mid")), F.array().cast("array<string>")).otherwise(own)
    return typed.select("mention_id", "doc_id", F.array_sort(F.array_distinct(features)).alias("features"))


def category_features(rows: DataFrame, categories: DataFrame, stop_words: DataFrame, prefix: str = "TOPWIKICATTOKEN-") -> DataFrame:
    """(mention_id, features): words of a title's categories without stop words."""
    words = categories.select("title", F.explode(X.tokens_of(F.lower("category"))).alias("word")).distinct()
    kept = words.join(stop_words.select("word").distinct(), "word", "left_anti")
    hits = rows.select("mention_id", "title").join(kept, "title")
    return hits.groupBy("mention_id").agg(F.array_sort(F.collect_set(F.concat(F.lit(prefix), "word"))).alias("features"))


def gram_types(grams: DataFrame, statistics: DataFrame, words: DataFrame, titles: DataFrame, mapping: DataFrame, types: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(lang, surface, n, capitalised, coarse): the types of what the n-grams (lang, surface, n, capitalised) are linked to.

    Candidates come by the rule for n-grams; with ``weights`` (of the candidate's score and its place from the end) they are
    ranked by the linear model, else they stay in order. The first one with a mid gives the types.
    """
    key = ["lang", "surface", "n", "capitalised"]
    # the stages of candidates read the n-grams and the index again and again, so they are written once
    found = candidates.ngram_candidates(cut_lineage(grams), statistics, words)
    if weights is not None:
        scored = found.withColumn("_s", V.linear_score([F.col("score"), 1 / F.col("rank")], weights))
        found = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_s"), "rank"))).drop("_s")
    found = cut_lineage(found)
    by_title = kb.mid_chain(found.withColumn("own_lang", F.col("lang")).withColumn("lang", F.col("cand_lang")), titles, mapping)
    linked = kb.first_mid(by_title.withColumn("lang", F.col("own_lang")), key).where(~X.is_nil(F.col("mid")))
    named = F.array_distinct(F.transform("coarse", lambda t: _renamed(t)))
    return linked.join(kb.coarse_types(types), "mid").select(*key, named.alias("coarse"))


def _renamed(kind: Column) -> Column:
    for own, other in TYPE_TOKENS.items():
        kind = F.when(kind == own, F.lit(other)).otherwise(kind)
    return kind


def known_grams(statistics: DataFrame, words: DataFrame, longest: int = 4) -> KnownGrams:
    """Tells the n-grams that the index may have candidates for."""
    return KnownGrams(statistics.select("surface").distinct(), words.select("word").distinct(), longest)


def known_lists(docs: DataFrame, statistics: DataFrame, words: DataFrame, longest: int = 4, known: KnownGrams | None = None) -> DataFrame:
    """Token lists of texts, cut to the n-grams that the index may have candidates for: surfaces, and of capitalised tokens words."""
    return cut_lineage(token_lists(docs, known=known or known_grams(statistics, words, longest)))


def typed_lists(toks: DataFrame, surface_types: DataFrame, longest: int = 4) -> DataFrame:
    """Token lists cut to the n-grams that may have types; the cascade finds in them what it finds in whole lists."""
    return cut_lineage(cut_to_known(listed(toks), KnownGrams(surface_types.select("surface").distinct(), longest=longest)))


def surface_forms(toks: DataFrame, longest: int = 4, stop_words: DataFrame | None = None, known: KnownGrams | None = None) -> DataFrame:
    """(lang, surface, n, capitalised): the distinct n-grams of texts that are asked for candidates, in lower case; numbers and stop n-grams aren't.

    With ``known`` only those that may be known are made.
    """
    stops = _few_stops(stop_words) if known is not None else None
    if stops is not None:
        return listed(toks).select("lang", "toks").mapInArrow(GramForms(known, stops), "lang string, surface string, n int, capitalised boolean").distinct()
    grams = ngrams_upto(toks, longest, stop_words)
    kept = grams.where(~X.is_number(F.col("surface")) & ~F.col("is_stop") & F.col("lang").isNotNull())
    return kept.select("lang", F.lower("surface").alias("surface"), "n", X.is_capitalised(F.col("surface")).alias("capitalised")).distinct()


def _few_stops(stop_words: DataFrame | None) -> dict[str, frozenset[str]] | None:
    """Stop words of each language if they are few enough to be sent to every task."""
    if stop_words is None:
        return {}
    rows = stop_words.where("lang is not null and word is not null").select("lang", "word").distinct().limit(MAX_STOPS + 1).collect()
    found: dict[str, set[str]] = {}
    for r in rows:
        found.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in found.items()} if len(rows) <= MAX_STOPS else None


class _Grams:
    """The n-grams of a batch of token lists."""

    def __init__(self, batch: pa.RecordBatch, stops: dict[str, frozenset[str]]) -> None:
        toks = batch.column("toks")
        self.flat, sizes = toks.flatten(), pc.fill_null(toks.value_lengths(), 0).to_numpy(zero_copy_only=False)
        self.words = self.flat.field("token").to_pylist()
        self.cut = [w.split("'", 1)[0] for w in self.words]
        self.langs = batch.column("lang").to_pylist()
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.ends = np.cumsum(sizes)[self.of]
        self.chinese = np.array([x == "zh" for x in self.langs], dtype=bool)[self.of]
        self.stops = [stops.get(x, frozenset()) for x in self.langs]

    def surfaces(self, first: np.ndarray, n: int) -> tuple[np.ndarray, list[str], list[str]]:
        """(first tokens, languages, surfaces) of the n-grams from ``first`` on that are neither numbers nor stop n-grams."""
        kept, langs, out, cut = [], [], [], self.cut
        for i, row in zip(first.tolist(), self.of[first].tolist(), strict=True):
            part, lang, stops = cut[i : i + n], self.langs[row], self.stops[row]
            surface = ("" if lang == "zh" else " ").join(part)
            if (stops and all(w.lower() in stops for w in part)) or _NUMBER.match(surface.strip(" ")):
                continue
            kept.append(i)
            langs.append(lang)
            out.append(surface)
        return np.array(kept, dtype=np.int64), langs, out

    def keys(self, first: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[str, str, int, bool]]]:
        """(first tokens, (lang, lower-case surface, n, capitalised)) of the n-grams that are asked for."""
        kept, langs, surfaces = self.surfaces(first, n)
        return kept, [(lang, s.lower(), n, s[:1] != "" and unicodedata.category(s[0]) == "Lu") for lang, s in zip(langs, surfaces, strict=True)]


class GramForms:
    """Token lists (lang, toks) to the distinct n-grams of a batch that may be known."""

    def __init__(self, known: KnownGrams, stops: dict[str, frozenset[str]]) -> None:
        self.known, self.stops = known, stops

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, seen = _Grams(batch, self.stops), set()
            for n, first in self.known.hits(grams.words, grams.ends, grams.chinese):
                seen.update(grams.keys(first, n)[1])
            rows = [r for r in seen if r[0] is not None]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "surface", "n", "capitalised"])


class Cascade:
    """Token lists (doc_id, lang, toks) to the rows of ``wikify_ngrams``: an n-gram lies in two of the next length, so each list goes by itself."""

    def __init__(self, known: KnownGrams, stops: dict[str, frozenset[str]], types: SurfaceTypes) -> None:
        self.known, self.stops, self.types = known, stops, types
        names = [[f"TOPFBTYPETOKEN-{t}" for t in x] for x in types.lists]
        # of own types which kinds are handed on, as bits
        self.bits = np.array([sum(1 << k for k, kind in enumerate(MAIN_TYPES) if any(f"TOPFBTYPETOKEN-{kind}" in f for f in x)) for x in names] + [0], np.uint8)
        self.typed = np.array([len(x) > 0 for x in names] + [False])
        # 64 lists of features that are taken, then the own ones
        taken = [[p + f"TOPFBTYPETOKEN-{kind}" for p, high in (("B-", 0), ("I-", 3)) for k, kind in enumerate(MAIN_TYPES) if b >> (k + high) & 1] for b in range(64)]
        self.features = [sorted(x) for x in [*taken, *names]]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.array(self.features, pa.list_(pa.string()))
        for batch in batches:
            grams = _Grams(batch, self.stops)
            hits, rows = dict(self.known.hits(grams.words, grams.ends, grams.chinese)), []
            outer = np.zeros(len(grams.words), np.uint8)
            # n-grams without document meet no other
            lone = pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)[grams.of]
            for n in range(self.known.longest, 0, -1):
                # the longer n-gram that begins here and the one that begins a token before
                bits = outer | np.append(np.uint8(0), outer[:-1]) << np.uint8(3)
                bits[lone] = 0
                first = np.flatnonzero(bits)
                first = grams.surfaces(first, n)[0] if len(first) else first
                outer = np.zeros(len(grams.words), np.uint8)
                outer[first] = bits[first] & 7 | bits[first] >> 3
                rows.append((first, n, bits[first].astype(np.int64)))
                own = np.setdiff1d(hits[n], first, assume_unique=True)
                own, keys = grams.keys(own, n)
                if len(own):
                    of_lang = np.array([k[0] is not None for k in keys])
                    number = self.types.numbers([k if k[0] is not None else ("", *k[1:]) for k in keys])
                    found = self.typed[number] & of_lang
                    own, number = own[found], number[found]
                    outer[own] = self.bits[number]
                    rows.append((own, n, number + 64))
            at = np.concatenate([r[0] for r in rows])
            if not len(at):
                continue
            size = np.concatenate([np.full(len(r[0]), r[1], np.int32) for r in rows])
            starts, ends = grams.flat.field("start"), grams.flat.field("end")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(grams.of[at])), starts.take(pa.array(at)), ends.take(pa.array(at + size - 1)), pa.array(size),
                    pool.take(pa.array(np.concatenate([r[2] for r in rows]))),
                ],
                names=["doc_id", "start", "end", "n", "features"],
            )


def _overlapping(lists: DataFrame) -> DataFrame:
    """(doc_id): documents with token lists that overlap, as those of two texts under one id do."""
    ends = lists.where("doc_id is not null and size(toks) > 0").select("doc_id", F.col("toks")[0]["start"].alias("s"), F.element_at("toks", -1)["end"].alias("e"))
    before = F.lag("e").over(Window.partitionBy("doc_id").orderBy("s", "e"))
    return ends.withColumn("_e", before).where("s < _e").select("doc_id").distinct()


def wikify_ngrams(toks: DataFrame, surface_types: DataFrame, stop_words: DataFrame | None = None, longest: int = 4) -> DataFrame:
    """(doc_id, start, end, n, features): the n-gram cascade from ``longest`` to 1.

    ``surface_types`` has (lang, surface, coarse), the types of the title that a surface is linked to; as made by
    ``gram_types`` it also tells them by n and capitalisation. The cascade goes through each token list by itself; only
    documents whose lists overlap are joined with themselves.
    """
    lists, stops = listed(toks), _few_stops(stop_words)
    types = SurfaceTypes(surface_types) if stops is not None else None
    if types is None or not types.distinct:
        return _joined_cascade(toks, surface_types, stop_words, longest)
    walk = Cascade(KnownGrams(surface_types.select("surface").distinct(), longest=longest), stops, types)
    schema = f"doc_id {dict(lists.dtypes)['doc_id']}, start long, end long, n int, features array<string>"
    repeated = cut_lineage(_overlapping(lists))
    n = repeated.count()
    single = lists
    if n:
        repeated = F.broadcast(repeated) if n <= MAX_STOPS else repeated
        single = lists.join(repeated, "doc_id", "left_anti")
    found = single.select("doc_id", "lang", "toks").mapInArrow(walk, schema)
    return found.unionByName(_joined_cascade(lists.join(repeated, "doc_id", "left_semi"), surface_types, stop_words, longest)) if n else found


def _joined_cascade(toks: DataFrame, surface_types: DataFrame, stop_words: DataFrame | None, longest: int) -> DataFrame:
    """``wikify_ngrams`` by joins: n-grams of one document meet, whatever list they are from."""
    grams = ngrams_upto(toks, longest, stop_words)
    grams = grams.where(~X.is_number(F.col("surface")) & ~F.col("is_stop")).withColumn("_low", F.lower("surface"))
    linked = surface_types.withColumnRenamed("surface", "_low")
    if "capitalised" in linked.columns:
        joined = grams.withColumn("capitalised", X.is_capitalised(F.col("surface"))).join(linked, ["lang", "_low", "n", "capitalised"], "left")
    else:
        joined = grams.join(linked.select("lang", "_low", "coarse"), ["lang", "_low"], "left")
    # all stages read the n-grams, so they are written once; a stage is written before the next one reads it
    every = cut_lineage(joined.select("doc_id", "start", "end", "n", type_features(F.col("coarse"), "TOP").alias("own")))
    outer, out = None, None
    for n in range(longest, 0, -1):
        hits = every.where(F.col("n") == n)
        own = hits.where("size(own) > 0").select("doc_id", "start", "end", F.array_sort("own").alias("features"))
        if outer is not None:
            taken = propagate_types(hits, outer).groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set("feature")).alias("features"))
            taken = cut_lineage(taken)
            own = taken.unionByName(own.join(taken, ["doc_id", "start", "end"], "left_anti"))
        outer = cut_lineage(own.select("doc_id", "start", "end", F.lit(n).alias("n"), "features"))
        out = outer if out is None else out.unionByName(outer)
    return out


def phrase_hits(toks: DataFrame, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """(doc_id, start, end, n, class): n-grams of a text that stand in a phrase list (lang, phrase, class)."""
    known = phrases.select("lang", F.lower(F.trim("phrase")).alias("_p"), "class").distinct()
    grams = ngrams_upto(toks, longest).withColumn("_p", F.lower("surface"))
    return grams.join(known, ["lang", "_p"]).select("doc_id", "start", "end", "n", "class")


def longest_phrases(phrases: DataFrame) -> dict[str, int]:
    """How many tokens the phrases of each language have at most; in Chinese, without blanks, as many as characters."""
    text = F.trim("phrase")
    n = F.when(F.col("lang") == "zh", F.length(text)).otherwise(F.size(F.split(text, " ")))
    rows = phrases.where("lang is not null and phrase is not null").groupBy("lang").agg(F.max(n).alias("n")).orderBy("lang").collect()
    return {r["lang"]: max(r["n"], 1) for r in rows}


def merged_features(a: Column, b: Column) -> Column:
    """Two feature maps as one; where both have a name, the second's value stands."""
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def majority_tag(features: Column) -> Column:
    """The label of the first main type among a token's features, else O: a tagger without a model."""
    label = F.lit("O")
    for kind in reversed(MAIN_TYPES):
        label = F.when(F.exists(features, lambda f: f.endswith(f"TYPETOKEN-{kind}")), F.lit(LABEL_OF[kind])).otherwise(label)
    return label


def token_features(toks: DataFrame) -> DataFrame:
    """Rows with ``features``: form of the token and its neighbours in the sentence."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{N}", "0")
    short = F.regexp_replace(shape, r"(.)\1+", "$1")
    tag = lambda name, c: F.concat(F.lit(name + "="), F.coalesce(c, F.lit("^")))
    low = F.lower("token")
    return toks.withColumn(
        "features",
        F.array(
            tag("w", low), tag("w-1", F.lag(low).over(w)), tag("w+1", F.lead(low).over(w)), tag("s", short), tag("s-1", F.lag(short).over(w)),
            tag("s+1", F.lead(short).over(w)), tag("p3", F.substring(low, 1, 3)), tag("x3", F.expr("right(lower(token), 3)")),
        ),
    )


def previous_label_features(labelled: DataFrame) -> DataFrame:
    """Tokens with ``label`` and the feature ``prev-<label>`` of the token before in the sentence, and its type without B- and I-; none at a sentence's begin."""
    before = F.lag("label").over(Window.partitionBy("doc_id", "sent_id").orderBy("tok_id"))
    kind = F.regexp_replace(before, r"^[BI]-", "")
    made = F.array_distinct(F.array(F.concat(F.lit("prev-"), before), F.concat(F.lit("prev-"), kind)))
    return labelled.withColumn("features", F.when(before.isNull(), F.array().cast("array<string>")).otherwise(made))


def train_tagger(labelled: DataFrame, n_features: int = 1 << 16, max_rows: int = 500_000):
    """A pipeline (hashing, logistic regression) from tokens with ``features`` and ``label``; at most ``max_rows`` rows, chosen by hash."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer

    kinds = labelled.select(F.regexp_replace("label", r"^[BI]-", "").alias("kind"), "features", "doc_id", "tok_id")
    sample = bounded_sample(kinds, ["doc_id", "tok_id"], max_rows)
    index = StringIndexer(inputCol="kind", outputCol="kind_id", handleInvalid="keep").fit(sample)
    stages = [
        index,
        HashingTF(inputCol="features", outputCol="x", numFeatures=n_features, binary=True),
        LogisticRegression(featuresCol="x", labelCol="kind_id", predictionCol="found_id", maxIter=30, regParam=1e-4),
        IndexToString(inputCol="found_id", outputCol="found", labels=[*index.labels, "O"]),
    ]
    return Pipeline(stages=stages).fit(sample)


def tagged(model, toks: DataFrame) -> DataFrame:
    """Tokens with ``features`` and the ``label`` that a tagger of ``train_tagger`` finds; runs of one type begin with B-."""
    found = model.transform(toks.withColumn("kind", F.lit("O")))
    before = F.lag("found").over(Window.partitionBy("doc_id", "sent_id").orderBy("tok_id"))
    label = F.when(F.col("found") == "O", F.lit("O")).otherwise(F.concat(F.when(before == F.col("found"), F.lit("I-")).otherwise(F.lit("B-")), "found"))
    return found.withColumn("label", label).select(*toks.columns, *(() if "label" in toks.columns else ("label",)))


def tagger_scores(model, labelled: DataFrame) -> DataFrame:
    """(mention_type, n_gold, n_found, n_right, precision, recall, f1): spans found in labelled tokens against those labelled; ``all`` sums up."""
    keys = ["doc_id", "start", "end", "mention_type"]
    gold = bio_decode(labelled).select(*keys).distinct().withColumn("gold", F.lit(1))
    found = bio_decode(tagged(model, labelled.drop("label"))).select(*keys).distinct().withColumn("found", F.lit(1))
    both = gold.join(found, keys, "full").select("mention_type", F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("found", F.lit(0)).alias("found"))
    each = both.unionByName(both.withColumn("mention_type", F.lit("all"))).groupBy("mention_type").agg(
        F.sum("gold").alias("n_gold"), F.sum("found").alias("n_found"), F.sum(F.col("gold") * F.col("found")).alias("n_right")
    )
    p, r = F.try_divide("n_right", "n_found"), F.try_divide("n_right", "n_gold")
    share = {"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}
    return each.withColumns(share)


def copy_features(tokens_a: DataFrame, tokens_b: DataFrame) -> DataFrame:
    """Features of one tokenisation copied to another by position; documents with another number of tokens raise an error."""
    a, b = (t.groupBy("doc_id").agg(F.count("*").alias(n)) for t, n in ((tokens_a, "n_a"), (tokens_b, "n_b")))
    differing = a.join(b, "doc_id", "full").where("not n_a <=> n_b").select("doc_id", F.lit(True).alias("bad"))
    joined = tokens_a.join(tokens_b.select("doc_id", "tok_id", F.col("features").alias("copied")), ["doc_id", "tok_id"], "left")
    message = F.concat(F.lit("token counts differ in document "), F.col("doc_id").cast("string"))
    checked = joined.join(differing, "doc_id", "left")
    return checked.withColumn("copied", F.when(F.col("bad"), F.raise_error(message).cast("array<string>")).otherwise(F.col("copied"))).drop("bad")
