"""Statistics of hyperlinked text: how likely a surface means a title and the other way round.

Counts are aggregated by pair before any window, so that a surface with a large share of all anchors is
one row for each of its titles. Null surfaces or titles are left out; repeated rows count each time;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import text as X


def mention_anchors(mentions: DataFrame) -> DataFrame:
    """(lang, surface, title) of the mentions linked to a title."""
    return mentions.where("lang is not null and surface is not null and wiki_title is not null and wiki_title != 'NIL'").select(
        "lang", X.normal_surface(F.col("surface")).alias("surface"), X.normal_title(F.col("wiki_title")).alias("title")
    )


def html_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """(surface, title) of ``<a href="/title">surface</a>``."""
    pattern = r'<a href="/([^"]*)">([^<]*)</a>'
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("surface"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("title"),
    )
    found = pages.select(F.explode(pairs).alias("a")).select("a.surface", "a.title")
    return found.select(X.normal_surface(F.col("surface")).alias("surface"), X.normal_title(F.col("title")).alias("title"))


def with_pseudo_counts(anchors: DataFrame) -> DataFrame:
    """Every title adds one anchor with its own name as surface."""
    own = anchors.select("lang", X.title_as_surface(F.col("title")).alias("surface"), "title").distinct()
    return anchors.select("lang", "surface", "title").unionAll(own)


def pair_statistics(anchors: DataFrame, left: str = "surface", right: str = "title") -> DataFrame:
    """(lang, left, right, cnt, p_right_given_left, p_left_given_right)."""
    pairs = anchors.groupBy("lang", left, right).agg(F.count("*").alias("cnt"))
    total = lambda key: F.sum("cnt").over(Window.partitionBy("lang", key))
    return pairs.withColumns(
        {f"p_{right}_given_{left}": F.col("cnt") / total(left), f"p_{left}_given_{right}": F.col("cnt") / total(right)}
    )


def surface_title_statistics(anchors: DataFrame) -> DataFrame:
    """p(title | surface) and p(surface | title), with pseudo-counts, in one table."""
    return pair_statistics(with_pseudo_counts(anchors))


def word_title_statistics(anchors: DataFrame) -> DataFrame:
    """p(title | word) and p(word | title) over the words of surfaces and, once for each title, of titles."""
    words = lambda c: F.filter(F.split(c, r"\s+|·"), lambda t: t != "")
    of_surface = anchors.select("lang", F.explode(words(F.col("surface"))).alias("word"), "title")
    own = anchors.select("lang", "title").distinct()
    of_title = own.select("lang", F.explode(words(X.title_as_surface(F.col("title")))).alias("word"), "title")
    return pair_statistics(of_surface.unionAll(of_title), "word", "title")
