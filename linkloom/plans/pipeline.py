"""The linker end to end, as a composition of operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from linkloom.config import Config
from linkloom.functions import text as X
from linkloom.operators import anchors, candidates, coref, features, intervals, kb, ner, ranking, titles, tokens
from linkloom.operators.numbering import numbered
from linkloom.session import cut_lineage
from linkloom.sources import documents, sinks

FEATURES = ("TITLEPROB", "SURFACEPROB")
# A small default model: the two probabilities and their product.
WEIGHTS = (0.7, 0.2, 0.1)


@dataclass(frozen=True)
class Index:
    """What the linker looks things up in; plain tables, so that it can be written and read as such."""

    statistics: DataFrame
    title_map: DataFrame
    redirects: DataFrame
    kb_titles: DataFrame
    kb_types: DataFrame
    words: DataFrame | None = None

    def save(self, path: str) -> None:
        """Write every table below ``path``; a table that exists is an error."""
        for name, rows in vars(self).items():
            if rows is not None:
                sinks.write_index(rows, f"{path}/{name}")
                rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/{name}.schema")

    @staticmethod
    def load(spark: SparkSession, path: str, langs: tuple[str, ...] | None = None) -> Index:
        """The index that ``save`` wrote; with ``langs`` only their partitions (and English) of the tables that tell a language are read."""
        schema = lambda name: StructType.fromJson(json.loads(spark.read.text(f"{path}/{name}.schema").first()["value"]))
        read = {f.name: spark.read.schema(schema(f.name)).parquet(f"{path}/{f.name}") for f in fields(Index)}
        if langs is not None:
            read = {name: rows.where(F.col("lang").isin("en", *langs)) if "lang" in rows.columns else rows for name, rows in read.items()}
        return Index(**read)


def build_index(linked: DataFrame, kb_titles: DataFrame, kb_types: DataFrame, wiki_pages: DataFrame, wiki_redirects: DataFrame) -> Index:
    """The index from linked mentions, the page dump and the knowledge base."""
    # the linker reads the statistics again and again
    linked = cut_lineage(anchors.mention_anchors(linked))
    return Index(
        cut_lineage(anchors.surface_title_statistics(linked)),
        titles.title_map(kb_titles),
        cut_lineage(titles.redirect_targets(wiki_pages, wiki_redirects)),
        kb_titles,
        kb_types,
        cut_lineage(anchors.word_title_statistics(linked)),
    )


def annotate(mentions: DataFrame, index: Index, target_kb: str = "freebase", weights: tuple[float, ...] = WEIGHTS, config: Config | None = None, search: DataFrame | None = None) -> DataFrame:
    """(mention_id, doc_id, surface, wiki_title, en_title, mid, confidence, cluster_id) of mentions.

    Candidates of a surface come from its language, else from its words, else from English. ``target_kb`` ("freebase" or
    "enwiki"; the ``config``'s, if there is one) names the identifier that clusters go by; another value is an error. With
    ``config.use_search`` mentions without title take the first hit of ``search``, a table of cached answers (lang, query, titles).
    """
    target_kb = config.target_kb if config else target_kb
    if target_kb not in ("freebase", "enwiki"):
        raise ValueError(f"unknown target_kb {target_kb!r}")
    surface, end = X.clean_surface(F.col("surface"), F.col("end"))
    cleaned = mentions.select("mention_id", "doc_id", "lang", "mention_type", "start", end.alias("end"), surface.alias("surface"))
    keyed = cleaned.withColumn("key", X.normal_surface(F.col("surface")))
    found = surface_candidates(keyed.select("lang", F.col("key").alias("surface")).where("lang is not null and surface is not null"), index)
    # each stage that several later ones read is written once
    found = cut_lineage(candidates.apply_overrides(candidates.drop_unwanted(found))).withColumns({"TITLEPROB": F.col("p_title_given_surface"), "SURFACEPROB": F.col("p_surface_given_title")})
    # surfaces are scored once; mentions take the result
    scored = ranking.score_candidates(found, FEATURES, weights)
    best = ranking.best_candidate(scored, ["lang", "surface"]).withColumnRenamed("title", "wiki_title")
    by_title = found.select("lang", "surface", "cand_lang", F.col("title").alias("wiki_title")).distinct().join(best, ["lang", "surface", "wiki_title"])
    by_title = by_title.groupBy("lang", "surface", "wiki_title", "confidence").agg(F.min_by("cand_lang", F.struct(F.col("cand_lang") != F.col("lang"), "cand_lang")).alias("cand_lang"))
    linked = cut_lineage(keyed.join(by_title.withColumnRenamed("surface", "key"), ["lang", "key"], "left"))
    if config and config.use_search and search is not None:
        linked = documents.search_fallback(linked, search).withColumn("cand_lang", F.coalesce("cand_lang", "lang"))
    return _finish(linked.withColumn("wiki_title", F.when(~X.is_nil(F.col("wiki_title")), F.col("wiki_title"))), index, target_kb)


def surface_candidates(surfaces: DataFrame, index: Index) -> DataFrame:
    """Candidates of surfaces: the own language's, where it has none those of the words, then the English ones; ``cand_lang`` tells."""
    wanted = cut_lineage(surfaces.select("lang", "surface").distinct())
    cols = ("lang", "surface", "title", "p_title_given_surface", "p_surface_given_title", "rank", "cand_lang")
    every = candidates.with_english_fallback(wanted, index.statistics)
    own = cut_lineage(every.select(*cols))
    if index.words is None:
        return own
    direct = own.where("cand_lang = lang").select("lang", "surface").distinct()
    none = wanted.join(direct, ["lang", "surface"], "left_anti")
    by_words = candidates.by_word(none, index.words).groupBy("lang", "surface", "title").agg(F.max("p_title_given_word").alias("p_title_given_surface"))
    order = Window.partitionBy("lang", "surface").orderBy(F.desc("p_title_given_surface"), "title")
    by_words = by_words.select("*", F.lit(0.0).alias("p_surface_given_title"), F.row_number().over(order).alias("rank"), F.col("lang").alias("cand_lang")).select(*cols)
    by_words = cut_lineage(by_words)
    return own.join(by_words.select("lang", "surface").distinct(), ["lang", "surface"], "left_anti").unionByName(by_words)


def _with_titles(linked: DataFrame, index: Index) -> DataFrame:
    """Redirects, English titles and mids of mentions with ``wiki_title`` in ``cand_lang``."""
    pairs = linked.where("wiki_title is not null").select(F.coalesce("cand_lang", "lang").alias("lang"), F.col("wiki_title").alias("title")).distinct()
    resolved = titles.resolve_redirects(pairs, index.redirects)
    english = cut_lineage(titles.translate(resolved.withColumnsRenamed({"title": "asked", "resolved": "title"}), index.title_map))
    with_mid = kb.mid_chain(english, index.kb_titles, index.title_map)
    known = with_mid.select(F.col("lang").alias("cand_lang"), F.col("asked").alias("wiki_title"), F.col("title").alias("_title"), "en_title", "mid")
    joined = linked.withColumn("cand_lang", F.coalesce("cand_lang", "lang")).join(known, ["cand_lang", "wiki_title"], "left")
    joined = joined.withColumn("wiki_title", F.coalesce("_title", "wiki_title")).drop("_title", "cand_lang")
    joined = joined.withColumns({c: X.or_nil(F.col(c)) for c in ("wiki_title", "en_title", "mid")})
    return joined.select("mention_id", "doc_id", "mention_type", "start", "surface", "wiki_title", "en_title", "mid", "confidence")


def _finish(linked: DataFrame, index: Index, target_kb: str) -> DataFrame:
    """Redirects, English titles, mids, containment and clusters of mentions with ``wiki_title`` in ``cand_lang``."""
    joined = cut_lineage(_with_titles(linked, index))
    del linked  # what was written before can leave the disk
    contained = cut_lineage(coref.person_containment(joined))
    del joined
    target = "mid" if target_kb == "freebase" else "en_title"
    clustered = coref.cluster_surfaces(contained.withColumn("mid", F.col(target)), ["doc_id"]).select("mention_id", "cluster_id")
    return contained.join(clustered, "mention_id", "left").select("mention_id", "doc_id", "surface", "wiki_title", "en_title", "mid", "confidence", "cluster_id")


def annotate_ranked(mentions: DataFrame, docs: DataFrame, index: Index, vectors: DataFrame, names: tuple[str, ...], weights: tuple[float, ...], config: Config | None = None) -> DataFrame:
    """``annotate`` with the document-by-document ranker: all base features, context, other mentions and earlier choices included."""
    keyed = mentions.where("mention_id is not null and doc_id is not null").select("mention_id", "doc_id", "lang", "mention_type", "start", "end", "surface")
    keyed = keyed.withColumn("key", X.normal_surface(F.col("surface")))
    found = surface_candidates(keyed.select("lang", F.col("key").alias("surface")).where("lang is not null and surface is not null"), index)
    found = cut_lineage(candidates.apply_overrides(candidates.drop_unwanted(found)))
    linked = features.rank_texts(keyed, found, docs, tokens.document_frequency(docs), index.title_map, vectors, names, weights)
    del keyed, found
    return _finish(cut_lineage(linked), index, config.target_kb if config else "freebase")


def annotate_text(docs: DataFrame, index: Index, config: Config | None = None, stop_words: DataFrame | None = None, search: DataFrame | None = None) -> DataFrame:
    """Texts (doc_id, lang, text) to linked mentions: (mention_id, doc_id, lang, start, end, surface, mention_type, wiki_title, en_title, mid, confidence, cluster_id)."""
    spans = cut_lineage(text_mentions(docs, index, config, stop_words))
    linked = annotate(spans, index, config=config, search=search)
    return spans.select("mention_id", "lang", "start", "end", "mention_type").join(linked, "mention_id")


def text_mentions(docs: DataFrame, index: Index, config: Config | None = None, stop_words: DataFrame | None = None) -> DataFrame:
    """(mention_id, doc_id, lang, start, end, surface, mention_type): n-grams linked from long to short, labelled by their types, decoded to spans.

    With ``config.rank_in_tagging`` the candidates of an n-gram are ranked by the small model, else they stay in order.
    """
    known = ner.known_grams(index.statistics, index.words)
    lists = ner.known_lists(docs, index.statistics, index.words, known=known)
    weights = (1.0, 0.0) if config and config.rank_in_tagging else None
    types = ner.gram_types(ner.surface_forms(lists, 4, stop_words, known), index.statistics, index.words, index.kb_titles, index.title_map, index.kb_types, weights)
    spans = tag_mentions(lists, cut_lineage(types), stop_words)
    texts = docs.where("text is not null").select("doc_id", "lang", "text")
    surface = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rows = spans.join(texts, "doc_id").select("doc_id", "lang", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), surface.alias("surface"), "mention_type")
    return numbered(rows, ["doc_id", "start", "end"], "mention_id").withColumn("mention_id", F.col("mention_id").cast("long"))


def tag_mentions(toks: DataFrame, surface_types: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_id, start, end, mention_type): n-grams linked, labelled by their types and decoded to spans."""
    # tokens outside of all typed n-grams get no label, so that the runs of labels are the same without them
    lists = ner.typed_lists(toks, surface_types)
    toks = tokens.exploded(lists)
    found = ner.wikify_ngrams(lists, surface_types, stop_words)
    spans = found.withColumn("mention_type", ner.majority_tag(F.col("features"))).where("mention_type != 'O'")
    keyed = spans.select(F.xxhash64("doc_id", "start", "end").alias("mention_id"), "doc_id", "start", "end", "mention_type")
    kept = intervals.resolve_nested(keyed).select("mention_id")
    return intervals.bio_decode(intervals.bio_encode(toks, keyed.join(kept, "mention_id")))
