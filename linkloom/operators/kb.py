"""Knowledge-base identifiers and types of titles.

Look-ups are left joins that keep the left rows; null titles and titles that stand for nothing find
nothing. Where the knowledge base repeats a key, the least value stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as X


def title_to_mid(titles: DataFrame) -> DataFrame:
    """(title, lang, mid) with one row for each title and language, both in the knowledge base's form."""
    rows = titles.where("title is not null and lang is not null and mid is not null")
    return rows.groupBy(X.kb_title(F.col("title")).alias("title"), X.kb_language(F.col("lang")).alias("lang")).agg(F.min("mid").alias("mid"))


def mid_chain(rows: DataFrame, titles: DataFrame, mapping: DataFrame, column: str = "title") -> DataFrame:
    """``mid`` of (lang, title): by the own language, then by the same title in English, then by its translation.

    Titles and languages are brought to the knowledge base's form (title case, ``zh-cn``) on both sides. The three tries are exploded to keys with a priority, so that one join serves all of them.
    """
    known = title_to_mid(titles)
    keys = rows.select("lang", column).distinct().where(~X.is_nil(F.col(column)) & (F.trim(column) != ""))
    translated = keys.join(mapping.select("lang", F.col("title").alias(column), "en_title"), ["lang", column], "left")
    tries = translated.select(
        "lang",
        column,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("try"), X.kb_title(F.col(column)).alias("key"), X.kb_language(F.col("lang")).alias("key_lang")),
                F.struct(F.lit(2).alias("try"), X.kb_title(F.col(column)).alias("key"), F.lit("en").alias("key_lang")),
                F.struct(F.lit(3).alias("try"), X.kb_title(F.col("en_title")).alias("key"), F.lit("en").alias("key_lang")),
            )
        ).alias("t"),
    ).select("lang", column, "t.*")
    hits = tries.join(known.select(F.col("title").alias("key"), F.col("lang").alias("key_lang"), "mid"), ["key", "key_lang"])
    first = hits.groupBy("lang", column).agg(F.min_by("mid", "try").alias("mid"), F.min("try").alias("mid_try"))
    return rows.join(first, ["lang", column], "left")


def first_mid(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The mid of the first candidate that has one; ``mids`` has each candidate's mid or ``NIL``, in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", X.or_nil(F.col("mid")).alias("mid"))))
    return candidates.groupBy(*keys).agg(
        X.or_nil(F.min_by("mid", F.when(F.col("mid").isNotNull(), F.col("rank")))).alias("mid"),
        F.transform(ranked, lambda e: e["mid"]).alias("mids"),
    )


def types_of_titles(rows: DataFrame, types: DataFrame) -> DataFrame:
    """``types`` of each row's mid; an empty list if it has none."""
    return rows.join(types.select("mid", "types"), "mid", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def coarse_types(types: DataFrame) -> DataFrame:
    """(mid, coarse): the set of lower-case parts of the types, sorted."""
    parts = F.flatten(F.transform("types", lambda t: F.split(F.lower(t), r"\.")))
    return types.select("mid", F.array_sort(F.array_distinct(parts)).alias("coarse"))


def mid_types(rows: DataFrame) -> DataFrame:
    """(mid, types): distinct types of a mid in first-seen order, from rows (mid, type, seq)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda e: e["type"])
    return rows.where("mid is not null and type is not null").groupBy("mid").agg(F.array_distinct(ordered).alias("types"))


def titles_of_mids(titles: DataFrame) -> DataFrame:
    """(mid, lang, titles): the sorted titles of a mid in a language."""
    return titles.where("mid is not null and title is not null").groupBy("mid", "lang").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def type_contradictions(mentions: DataFrame, types: DataFrame, expected: DataFrame) -> DataFrame:
    """Mentions whose annotated type contradicts the types of their mid; ``expected`` has (mention_type, kb_type)."""
    typed = mentions.join(types.select("mid", "types"), "mid").join(expected, "mention_type")
    return typed.where("not array_contains(types, kb_type)").select("mention_id", "mid", "mention_type", "types")
