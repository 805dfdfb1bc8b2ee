"""Readers of dumps: SQL dump rows, knowledge-base triples, embedding text.

Explicit schemas throughout. Rows that don't have the expected shape are left out; where the format says
that the last row of a key wins, the order of lines (a column ``seq`` of the input if it has one, else the
order in which Spark reads them) and the place in the line decide.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as X

# A tuple of an INSERT statement: quoted strings may hold anything, backslash escapes included.
_TUPLE = r"""\(((?:'(?:[^'\\]|\\.)*+'|[^'()])*+)\)"""
_FIELD = r"""('(?:[^'\\]|\\.)*+'|[^',]*+)(?:,|$)"""


def _ordered(lines: DataFrame) -> DataFrame:
    return lines if "seq" in lines.columns else lines.withColumn("seq", F.monotonically_increasing_id())


def dump_tuples(lines: DataFrame, line: str = "value") -> DataFrame:
    """(seq, place, fields): each tuple of the INSERT statements, split at commas outside quotes."""
    inserts = _ordered(lines).where(F.col(line).contains("INSERT INTO"))
    values = F.regexp_replace(F.col(line), r"^.*?VALUES\s*", "")
    tuples = inserts.select("seq", F.posexplode(F.regexp_extract_all(values, F.lit(_TUPLE), F.lit(1))).alias("place", "row"))
    return tuples.select("seq", "place", F.regexp_extract_all("row", F.lit(_FIELD), F.lit(1)).alias("fields"))


def _string(k: int) -> Column:
    raw = F.get("fields", F.lit(k))
    return X.unescaped(F.substring(raw, F.lit(2), F.length(raw) - 2))


def _number(k: int, kind: str = "long") -> Column:
    return F.get("fields", F.lit(k)).try_cast(kind)


def dump_pages(lines: DataFrame, redirects: bool | None = False) -> DataFrame:
    """(page_id, title, is_redirect) of the main namespace; ``redirects`` chooses pages, redirects or (None) both."""
    pages = dump_tuples(lines).select(
        _number(0).alias("page_id"), _number(1, "int").alias("ns"), F.lower(_string(2)).alias("title"), _number(5, "int").alias("is_redirect")
    )
    main = pages.where("page_id is not null and ns = 0").drop("ns")
    return main if redirects is None else main.where(F.col("is_redirect") == int(redirects))


def dump_redirects(lines: DataFrame) -> DataFrame:
    """(page_id, target_title)."""
    return dump_tuples(lines).select(_number(0).alias("page_id"), F.lower(_string(2)).alias("target_title")).where("page_id is not null")


def dump_langlinks(lines: DataFrame, target_lang: str | None = None) -> DataFrame:
    """(page_id, lang, title), of one target language if asked; of several titles of a page in a language the last counts."""
    links = dump_tuples(lines).select(
        "seq", "place", _number(0).alias("page_id"), _string(1).alias("lang"), F.replace(F.lower(_string(2)), F.lit(" "), F.lit("_")).alias("title")
    )
    links = links.where("page_id is not null" if target_lang is None else F.col("page_id").isNotNull() & (F.col("lang") == target_lang))
    return links.groupBy("page_id", "lang").agg(F.max_by("title", F.struct("seq", "place")).alias("title"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a dump, gzip or plain."""
    return spark.read.text(path)


def kb_triples(lines: DataFrame, line: str = "value") -> DataFrame:
    """(mid, lang, title) of three-column rows whose second column has no ``_id``; of several rows of a title and language the last counts."""
    parts = _ordered(lines).select("seq", F.split(line, "\t").alias("p")).where("size(p) = 3 and not contains(p[1], '_id')")
    rows = parts.select("seq", F.get("p", F.lit(0)).alias("mid"), F.get("p", F.lit(1)).alias("lang"), F.get("p", F.lit(2)).alias("title"))
    return rows.groupBy("lang", "title").agg(F.max_by("mid", F.struct("seq", "mid")).alias("mid")).select("mid", "lang", "title")


def embedding_text(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, vec) of ``key v1 .. vn`` lines."""
    parts = lines.select(F.split(F.trim(line), r"\s+").alias("p")).where("size(p) > 1")
    return parts.select(F.get("p", F.lit(0)).alias("key"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def word_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """(word): trimmed, lower case, distinct, without empty ones (stop words, gazetteers)."""
    return lines.select(F.lower(F.trim(line)).alias("word")).where("word != ''").distinct()


def brown_clusters(lines: DataFrame, prefixes: tuple[int, ...] = (4, 6, 10, 20), line: str = "value") -> DataFrame:
    """(word, bits, prefixes) of ``bits<tab>word<tab>count`` lines."""
    parts = lines.select(F.split(line, "\t").alias("p")).where("size(p) >= 2")
    bits = F.get("p", F.lit(0))
    return parts.select(F.get("p", F.lit(1)).alias("word"), bits.alias("bits"), F.array(*[F.substring(bits, 1, k) for k in prefixes]).alias("prefixes"))


def article_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, text) of an XML dump (bz2 or plain) without redirects and disambiguation pages."""
    schema = "id long, ns int, title string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    kept = pages.where("ns = 0 and redirect is null and not lower(title) like '%(disambiguation)%'")
    return kept.select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"))


def wiki_anchors(articles: DataFrame) -> DataFrame:
    """(page_id, surface, title) of ``[[title|surface]]`` and ``[[title]]`` links without other namespaces."""
    found = articles.select("page_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("link")).where("not contains(link, ':')")
    parts = F.split("link", r"\|")
    return found.select("page_id", X.normal_surface(F.element_at(parts, -1)).alias("surface"), X.normal_title(F.get(parts, F.lit(0))).alias("title"))


_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")


def plain_articles(articles: DataFrame) -> DataFrame:
    """(page_id, title, plain, anchors): the text without link markup and the links (start, end, title) at its offsets.

    Links of other namespaces (with a colon) leave nothing; an article with ``/`` in its title is left out, and so is one without text.
    """
    anchor = "array<struct<start:int,end:int,title:string>>"

    @F.pandas_udf(f"plain string, anchors {anchor}")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            out, size, anchors, at = [], 0, [], 0
            for m in _LINK.finditer(text):
                out.append(text[at : m.start()])
                size += m.start() - at
                at = m.end()
                shown = m.group(1) if m.group(2) is None else m.group(2)
                if ":" not in m.group(1):
                    anchors.append({"start": size, "end": size + len(shown), "title": m.group(1).replace(" ", "_").lower()})
                    out.append(shown)
                    size += len(shown)
            rows.append(("".join([*out, text[at:]]), anchors))
        return pd.DataFrame(rows, columns=["plain", "anchors"])

    kept = articles.where("text is not null and not contains(title, '/')")
    return kept.select("page_id", "title", cut("text").alias("c")).select("page_id", "title", "c.plain", "c.anchors")
