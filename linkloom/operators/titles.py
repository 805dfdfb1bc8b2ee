"""Titles across languages: maps, redirects and translations.

Where a source repeats a key, the last row by the given order wins and ties are broken by value, so that
results don't depend on the order in which rows arrive. Null keys join nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.operators.numbering import numbered


# The languages of hashtags in their order.
HASHTAG_LANGUAGES = (
    "en", "es", "zh", "ja", "ko", "de", "pt", "nl", "tr", "tl", "yo", "bn", "ta", "sv", "fr", "ru", "it", "pl", "vi", "uk", "ca", "fa",
    "no", "ar", "sh", "fi", "hu", "id", "ro", "cs", "sr", "ms", "eu", "eo", "bg", "da", "kk", "sk", "hy", "he", "lt", "hr", "ce", "sl",
    "et", "gl", "uz", "la", "el", "be", "vo", "hi", "th", "az", "ka", "ur", "mk", "oc", "mg", "cy", "lv", "bs", "tt", "tg", "te",
)


def last_by(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One ``value`` for each key: the one with the greatest ``order``."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct(order, value)).alias("_last")).select(*keys, F.col(f"_last.{value}").alias(value))


def title_map(titles: DataFrame, key: str = "mid") -> DataFrame:
    """(lang, title, en_title): titles of one thing in another language and in English.

    ``titles`` has (key, lang, title); the least title of a key and language stands for it.
    """
    rows = titles.where(f"{key} is not null and lang is not null and title is not null")
    english = rows.where("lang = 'en'").groupBy(key).agg(F.min("title").alias("en_title"))
    foreign = rows.where("lang != 'en'").select(key, "lang", X.normal_title(F.col("title")).alias("title")).distinct()
    return foreign.join(english, key).groupBy("lang", "title").agg(F.min(X.normal_title(F.col("en_title"))).alias("en_title"))


def all_titles_map(titles: DataFrame, source: str = "en", key: str = "mid") -> DataFrame:
    """(src_title, lang, tgt_title): titles of the source language and in every other one."""
    rows = titles.where(f"{key} is not null").select(key, "lang", X.joined_title(F.col("title")).alias("title")).distinct()
    own = rows.where(F.col("lang") == source).select(key, F.col("title").alias("src_title"))
    other = rows.where(F.col("lang") != source).select(key, "lang", F.col("title").alias("tgt_title"))
    return own.join(other, key).groupBy("src_title", "lang").agg(F.min("tgt_title").alias("tgt_title"))


def translate(rows: DataFrame, mapping: DataFrame, column: str = "title") -> DataFrame:
    """``en_title`` of a foreign title; English titles stay, unknown ones give null."""
    known = mapping.select("lang", F.col("title").alias(column), F.col("en_title").alias("_en"))
    joined = rows.join(known, ["lang", column], "left")
    return joined.withColumn("en_title", F.when(F.col("lang") == "en", F.col(column)).otherwise(F.col("_en"))).drop("_en")


def translate_from_english(rows: DataFrame, mapping: DataFrame, lang: str, column: str = "title") -> DataFrame:
    """``foreign_title`` of an English title, null if unknown."""
    back = mapping.where(F.col("lang") == lang).groupBy(F.col("en_title").alias(column)).agg(F.min("title").alias("foreign_title"))
    return rows.join(back, column, "left")


def titles_by_language(mapping: DataFrame) -> DataFrame:
    """(src_title, titles): all translations of a title as a map from language."""
    pairs = F.array_sort(F.collect_list(F.struct("lang", "tgt_title")))
    return mapping.groupBy("src_title").agg(F.map_from_entries(pairs).alias("titles"))


def redirect_targets(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(lang, title, target): the main-namespace titles that redirect, with the target of the latest redirect row."""
    target = last_by(redirects.where("lang is not null"), ["page_id", "lang"], "target_title", "seen_at")
    main = pages.where("ns = 0 and title is not null").select("page_id", "lang", X.normal_title(F.col("title")).alias("title")).distinct()
    joined = main.join(target, ["page_id", "lang"])
    return joined.groupBy("lang", "title").agg(F.min(X.normal_title(F.col("target_title"))).alias("target"))


def resolve_redirects(rows: DataFrame, targets: DataFrame, column: str = "title", resolve: bool = True) -> DataFrame:
    """``resolved``: the redirect target of a title, else the title itself."""
    if not resolve:
        return rows.withColumn("resolved", F.col(column))
    known = targets.select("lang", F.col("title").alias(column), "target")
    return rows.join(known, ["lang", column], "left").withColumn("resolved", F.coalesce("target", column)).drop("target")


def hashtags(mapping: DataFrame) -> DataFrame:
    """(src_title, hashtags): distinct hashtags of a title's translations, in the order of languages; other languages are left out."""
    place = F.array_position(F.array(*[F.lit(g) for g in HASHTAG_LANGUAGES]), F.col("lang"))
    known = mapping.withColumn("place", place).where("place > 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", X.hashtag(F.col("tgt_title")).alias("tag")))), lambda e: e["tag"])
    return known.groupBy("src_title").agg(F.array_distinct(F.filter(ordered, lambda t: t != "")).alias("hashtags"))


def translate_title(queries: DataFrame, mapping: DataFrame, targets: DataFrame, mapped: DataFrame) -> DataFrame:
    """Title translator: query (lang, title) -> English -> all translations as hashtags, with a second try behind a redirect."""
    first = translate(queries, mapping).withColumnRenamed("en_title", "en_1")
    second = translate(
        resolve_redirects(first, targets).select("lang", "title", "en_1", F.col("resolved")).withColumnRenamed("title", "query").withColumnRenamed("resolved", "title"), mapping
    )
    found = second.select("lang", F.col("query").alias("title"), F.coalesce("en_1", "en_title").alias("en_title"))
    tags = hashtags(mapped).withColumnRenamed("src_title", "en_title")
    own = F.when(F.col("en_title").isNotNull(), F.array(X.hashtag(F.col("en_title"))))
    every = F.array_distinct(F.concat(own, F.coalesce("hashtags", F.array().cast("array<string>"))))
    return found.join(tags, "en_title", "left").select("lang", "title", "en_title", every.alias("hashtags"))


def gazetteer(titles: DataFrame, classes: DataFrame, key: str = "mid") -> DataFrame:
    """(lang, class, phrase): foreign titles whose English title, as typed and cut at the parenthesis, is in a class list."""
    phrase = lambda c: X.cut_parenthesis(F.replace(c, F.lit("_"), F.lit(" ")))
    mapping = title_map(titles, key)
    known = classes.select("class", F.lower(F.col("phrase")).alias("_phrase")).distinct()
    hits = mapping.withColumn("_phrase", F.lower(phrase(F.col("en_title")))).join(known, "_phrase")
    return hits.select("lang", "class", X.gazetteer_case(phrase(F.col("title"))).alias("phrase")).distinct()


def shuffled(titles: DataFrame, seed: int = 0) -> DataFrame:
    """(title, place): distinct titles in a random order that depends on the seed only."""
    distinct = titles.where("title is not null").select("title").distinct()
    hashed = distinct.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), "title")))
    return numbered(hashed, ["_h", "title"], "place").select("title", "place")


def titles_of_pages(links: DataFrame) -> DataFrame:
    """(page_id, titles): a page's language links as a map from language; of several the last by ``seq`` counts, without ``seq`` the greatest."""
    order = F.struct("seq", "title") if "seq" in links.columns else F.col("title")
    one = links.groupBy("page_id", "lang").agg(F.max_by("title", order).alias("title"))
    return one.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "title")))).alias("titles"))
