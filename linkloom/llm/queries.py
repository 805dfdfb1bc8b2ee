"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import components, confusables, leakage, names, packing, reading, sentences
from linkloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = names.latest_nil_mentions(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "documents"))
    return names.same_entity_pairs(names.link_entities(mentions))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.same_look_pairs(table(spark, sf_dir, "mentions"), ("surface", "gold_wiki_title"), "mention_id", "doc_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.redirect_links(table(spark, sf_dir, "wiki_pages"), table(spark, sf_dir, "wiki_redirects"))
    return components.group_ids(links, "a", "b").select(F.col("vertex").alias("page_id"), "group_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    articles = table(spark, sf_dir, "wiki_docs").select("doc_id", F.col("plain").alias("text"), "lang")
    return sentences.sentences(docs.unionByName(articles))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_packed": p6_packed, "p7_found": p7_found, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            with recursive main as (
                select distinct page_id, lang, lower(replace(title, ' ', '_')) as form from wiki_pages
                where ns = 0 and page_id is not null and lang is not null),
            own as (select distinct page_id, lang from main),
            link as (
                select distinct r.page_id as a, t.page_id as b
                from wiki_redirects r
                join own o on o.page_id = r.page_id and o.lang = r.lang
                join main t on t.lang = r.lang and t.form = lower(replace(r.target_title, ' ', '_'))
                where r.page_id != t.page_id),
            both_ways as (select a, b from link union select b, a from link),
            reach as (select a as page_id, a as other from both_ways
                      union select reach.page_id, both_ways.b from reach join both_ways on reach.other = both_ways.a)
            select page_id, min(other) as group_id from reach group by page_id
        """,
    }
