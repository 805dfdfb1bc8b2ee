"""Candidate titles for surfaces: look-up, top-k, fallbacks, filters and the top-candidate linker.

Candidates are made for distinct surfaces and joined to mentions last. Top-k is ``row_number() <= k``,
which Spark limits on both sides of the shuffle. Ties are broken by title, then word. Null surfaces have
no candidates; a mention without candidates gets the title ``NIL``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import text as X
from linkloom.session import cut_lineage

TOP_K, WORD_TOP_K = 10, 6
# How many titles and surfaces a task counts shared grams of at a time.
BLOCK_TITLES, PART_SURFACES = 50_000, 5_000
# Parts of titles that aren't wanted, by language.
UNWANTED = {
    "en": r"_language|_people|_cuisine|_dollar|_studies|_americans|disambiguation\)",
    "es": r"^idioma_|^pueblo_|\(desambiguación\)$",
}
# Surfaces with a single permitted title.
ONLY_TITLE = (
    ("en", "washington", "washington,_d.c."),
    ("en", "new york", "new_york_city"),
    ("en", "european", "europe"),
    ("en", "german", "germany"),
    ("es", "washington", "washington_d._c."),
    ("zh", "台湾", "中华民国"),
    ("zh", "中国", "中国"),
    ("zh", "共产党", "中国共产党"),
)


def top_k(rows: DataFrame, keys: list[str], score: str, k: int, *ties: str) -> DataFrame:
    """The k best rows of each key with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_surface(surfaces: DataFrame, statistics: DataFrame, k: int = TOP_K) -> DataFrame:
    """(lang, surface, rank, title, ...): the likeliest titles of each distinct (lang, surface)."""
    wanted = surfaces.select("lang", "surface").distinct()
    return top_k(wanted.join(statistics, ["lang", "surface"]), ["lang", "surface"], "p_title_given_surface", k, "title")


def by_word(surfaces: DataFrame, words: DataFrame, k: int = WORD_TOP_K) -> DataFrame:
    """Candidates by the surface's words: each word has an equal share of the k places; then the k likeliest."""
    tokens = surfaces.select("lang", "surface").distinct().withColumn("tokens", X.tokens_of(F.col("surface"))).where("size(tokens) > 0")
    each = tokens.select("lang", "surface", F.expr(f"{k} div size(tokens)").alias("share"), F.explode(F.array_distinct("tokens")).alias("word"))
    # the k best titles of a word serve all its surfaces
    best = top_k(words, ["lang", "word"], "p_title_given_word", k, "title").withColumnRenamed("rank", "word_rank")
    hits = each.join(best, ["lang", "word"]).where("word_rank <= share")
    return top_k(hits, ["lang", "surface"], "p_title_given_word", k, "title", "word").select("lang", "surface", "word", "title", "p_title_given_word", "rank")


def character_grams(text: str, size: int) -> set[str]:
    """The distinct character grams of a text; a text shorter than a gram is its own gram."""
    return {text[i : i + size] for i in range(len(text) - size + 1)} if len(text) >= size else {text}


def _grams_of_block(size: int, k: int):
    """The k best titles of a block for each surface of a part, by shared grams, then title."""

    def best(surfaces: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list, list] = ([], [], [], [])
        titles = titles.sort_values("title")
        names, n = titles["title"].tolist(), len(titles)
        postings: dict[str, list[int]] = {}
        for i, text in enumerate(titles["text"]):
            for g in character_grams(text, size):
                postings.setdefault(g, []).append(i)
        index = {g: np.array(p, dtype=np.int64) for g, p in postings.items()}
        for lang, surface in zip(surfaces["lang"], surfaces["surface"], strict=True):
            hits = [index[g] for g in character_grams(surface, size) if g in index]
            if not hits:
                continue
            shared = np.bincount(np.concatenate(hits), minlength=n)
            found = np.flatnonzero(shared)
            # titles are in order, so that of equal counts the smaller place is the better
            order = shared[found] * n + (n - 1 - found)
            for j in found if len(found) <= k else found[np.argpartition(-order, k)[:k]]:
                for column, x in zip(out, (lang, surface, names[j], int(shared[j])), strict=True):
                    column.append(x)
        return pd.DataFrame(dict(zip(("lang", "surface", "title", "shared"), out, strict=True)))

    return best


def by_character_grams(surfaces: DataFrame, statistics: DataFrame, size: int = 4, k: int = TOP_K) -> DataFrame:
    """(lang, surface, title, shared, rank): titles by the number of character grams that their typed form shares with a surface.

    Grams are distinct in a text; a text shorter than a gram is its own gram. All grams of a surface count.
    Each part of the surfaces meets each block of the titles, where shared grams are counted in an inverted
    index; only a block's k best titles of a surface leave it, not the pairs, which common grams multiply.
    """
    titles = statistics.select("lang", "title").distinct().withColumn("text", X.title_as_surface(F.col("title")))
    titles = cut_lineage(titles.where("lang is not null and text is not null"))
    wanted = cut_lineage(surfaces.select("lang", "surface").distinct().where("lang is not null and surface != ''"))
    parts = lambda rows, n, name: rows.groupBy("lang").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    cells = F.broadcast(parts(titles, BLOCK_TITLES, "n_blocks").join(parts(wanted, PART_SURFACES, "n_parts"), "lang"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = wanted.join(cells, "lang").select("lang", "surface", one("surface", "n_parts").alias("part"), every("n_blocks").alias("block"))
    right = titles.join(cells, "lang").select("lang", "title", "text", one("title", "n_blocks").alias("block"), every("n_parts").alias("part"))
    # a cell costs Python time, not bytes: keep the session's number of tasks instead of merging them by size
    tasks, keys = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["lang", "block", "part"]
    grouped = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
    best = grouped.applyInPandas(_grams_of_block(size, k), "lang string, surface string, title string, shared int")
    return top_k(best, ["lang", "surface"], "shared", k, "title")


def with_english_fallback(surfaces: DataFrame, statistics: DataFrame, k: int = TOP_K) -> DataFrame:
    """Own-language candidates; surfaces of other languages without any get the English ones. ``cand_lang`` tells."""
    wanted = surfaces.select("lang", "surface").distinct()
    own = by_surface(wanted, statistics, k).withColumn("cand_lang", F.col("lang"))
    none = wanted.where("lang != 'en'").join(own.select("lang", "surface").distinct(), ["lang", "surface"], "left_anti")
    english = statistics.where("lang = 'en'").drop("lang")
    fallback = top_k(none.join(english, "surface"), ["lang", "surface"], "p_title_given_surface", k, "title")
    return own.unionByName(fallback.withColumn("cand_lang", F.lit("en")))


def ngram_candidates(ngrams: DataFrame, statistics: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates of n-grams (lang, surface, n, capitalised): own index, own words, English index, English words; the first that has any.

    Words serve capitalised single tokens only, and the English index serves single tokens only if capitalised.
    """
    grams = ngrams.select("lang", "surface", "n", "capitalised").distinct()
    single = grams.where("n = 1 and capitalised")
    foreign = grams.where("lang != 'en' and (n > 1 or capitalised)")
    as_english = lambda g: g.select(F.lit("en").alias("lang"), "surface").distinct()
    cols = ("lang", "surface", "n", "capitalised", "cand_lang", "title", "score", "rank", "priority")

    def stage(g: DataFrame, found: DataFrame, score: str, priority: int, english: bool) -> DataFrame:
        found = found.select("lang", "surface", "title", F.col(score).alias("score"), "rank")
        found = found.drop("lang") if english else found
        joined = g.join(found, ["surface"] if english else ["lang", "surface"])
        cand_lang = F.lit("en") if english else F.col("lang")
        return joined.select("*", cand_lang.alias("cand_lang"), F.lit(priority).alias("priority")).select(*cols)

    foreign_single = foreign.where("n = 1")
    staged = (
        stage(grams, by_surface(grams, statistics), "p_title_given_surface", 1, False)
        .unionByName(stage(single, by_word(single, words), "p_title_given_word", 2, False))
        .unionByName(stage(foreign, by_surface(as_english(foreign), statistics), "p_title_given_surface", 3, True))
        .unionByName(stage(foreign_single, by_word(as_english(foreign_single), words), "p_title_given_word", 4, True))
    )
    first = F.min("priority").over(Window.partitionBy("lang", "surface", "n", "capitalised"))
    return staged.withColumn("first", first).where("priority = first").drop("first")


def drop_unwanted(candidates: DataFrame) -> DataFrame:
    """Language-specific title filters; they come after the top-k and must stay behind it."""
    keep = F.lit(True)
    for lang, pattern in UNWANTED.items():
        keep = keep & ~((F.col("lang") == lang) & F.col("title").rlike(pattern))
    return candidates.where(keep)


def apply_overrides(candidates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Surfaces with a single permitted title keep that one only."""
    spark = candidates.sparkSession
    table = spark.createDataFrame(ONLY_TITLE, "lang string, surface string, only_title string") if overrides is None else overrides
    return candidates.join(table, ["lang", "surface"], "left").where("only_title is null or title = only_title").drop("only_title")


def link_top_candidate(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate's title for each mention, or ``NIL``."""
    top = candidates.where("rank = 1").select("lang", "surface", F.col("title").alias("linked_title"), F.col("p_title_given_surface").alias("score"))
    keyed = mentions.withColumn("_surface", X.normal_surface(F.col("surface")))
    on = (keyed["lang"] == top["lang"]) & (keyed["_surface"] == top["surface"])
    return keyed.join(top, on, "left").select(
        keyed["mention_id"], keyed["doc_id"], keyed["lang"], keyed["surface"], X.or_nil(F.col("linked_title")).alias("linked_title"), "score"
    )
