"""Consolidating pairwise matches into groups: connected components by seed-tree pruning.

Each round has two steps. *Selection*: every vertex tells its neighbours (and itself) the minimum of
its neighbourhood. *Pruning*: a vertex that was told several minima links them to the least one;
a vertex that nobody, itself included, chose as minimum drops out and hangs below that least one in
the propagation forest. What is left when no links remain are the seeds, the least vertex of each
group; their identifiers then flow down the forest, level by level. The graph shrinks by the vertices
that drop out, so the number of rounds grows with the logarithm of a group's diameter.

Minima are aggregates with a map-side part, so that a hub with a third of all links is reduced
before the shuffle; joins back to the links are left to the adaptive skew join, which splits a hot
vertex. Each round is cut with a checkpoint in the shared folder; nothing but row counts comes to
the driver.

Defined results: links with a null end and links from a vertex to itself link nothing; repeated links
count once; an empty table gives an empty result; other columns are ignored. A group of n vertices
gives n rows, whatever the number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _least_of_neighbourhood(graph: DataFrame) -> DataFrame:
    return graph.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))


def group_ids(links: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(vertex, group_id): for every linked vertex the least vertex it is linked with, directly or not."""
    graph = cut_lineage(_both_ways(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")))
    forest: list[DataFrame] = []
    stay: list[tuple[DataFrame, DataFrame]] = []
    while not graph.isEmpty():
        if len(stay) == max_rounds:
            raise RuntimeError(f"links remain after {max_rounds} rounds")
        least = _least_of_neighbourhood(graph)
        # two steps read what was told: it is kept until both are through, and would be made again from the graph if lost
        told = graph.join(least, "a").select(F.col("b").alias("v"), "least").unionByName(least.select(F.col("a").alias("v"), "least")).persist()
        chosen = told.groupBy("v").agg(F.min("least").alias("root"), F.max("least").alias("most"), F.max(F.col("least") == F.col("v")).alias("stays"))
        chosen = cut_lineage(chosen)
        forest.append(chosen.where("not stays").select(F.col("root").alias("parent"), F.col("v").alias("child")))
        several = chosen.where("root != most").select("v", "root")
        graph = cut_lineage(_both_ways(told.join(several, "v").where("least != root").select(F.col("least").alias("a"), F.col("root").alias("b"))))
        told.unpersist()
        stay.append((chosen.where("stays").select("v"), graph))
    if not stay:
        return graph.select(F.col("a").alias("vertex"), F.col("b").alias("group_id"))
    found = None
    for (kept, rest), fallen in zip(reversed(stay), reversed(forest), strict=True):
        # what stayed without a link is the seed of its group
        seeds = kept.join(rest.select(F.col("a").alias("v")).distinct(), "v", "left_anti")
        here = seeds.select(F.col("v").alias("vertex"), F.col("v").alias("group_id"))
        found = here if found is None else found.unionByName(here)
        below = fallen.join(found.withColumnRenamed("vertex", "parent"), "parent").select(F.col("child").alias("vertex"), "group_id")
        found = cut_lineage(found.unionByName(below))
    return found


def redirect_links(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(a, b): the page pairs that redirect rows link.

    The page and its target are in namespace 0 and in the language of the redirect row; titles are
    compared in lower case with spaces as underscores. Rows without such pages link nothing.
    """
    form = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    main = pages.where("ns = 0 and page_id is not null and lang is not null").select("page_id", "lang", form("title").alias("form"))
    own = main.select(F.col("page_id").alias("a"), "lang").distinct()
    target = main.where("form is not null").select(F.col("page_id").alias("b"), "lang", "form").distinct()
    rows = redirects.select(F.col("page_id").alias("a"), "lang", form("target_title").alias("form")).where("form is not null").distinct()
    return rows.join(own, ["a", "lang"]).join(target, ["lang", "form"]).where("a != b").select("a", "b").distinct()
