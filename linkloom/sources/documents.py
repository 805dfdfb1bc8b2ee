"""Readers of document collections and annotations: news XML, quotations, authors, gold tables, ERE, CoNLL.

Offsets count code points and ends are exclusive. Null or empty texts give no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkloom.functions import text as X
from linkloom.operators import rejects, titles

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
# How author names and quotations are marked.
_AUTHORS = {"newswire": re.compile(r"<AUTHOR>(.*?)</AUTHOR>"), "forum": re.compile(r' author="(.*?)"')}
_QUOTE = re.compile(r"<quote.*?/quote>", re.DOTALL)
# Language codes in the names of gold documents.
DOC_LANGUAGE = {"ENG": "en", "SPA": "es", "CMN": "zh"}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, text) of the files of a folder, by name; the name ends at the first dot. An empty file has no row."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return raw.select(F.substring_index("file", ".", 1).alias("doc_name"), "text").orderBy("doc_name")


def plain_text(xml):
    """Column: XML as plain text. Tags become blanks, lines that begin as links go, white space is collapsed."""
    lines = F.split(F.regexp_replace(xml, r"<.*?>", " "), "\n")
    kept = F.filter(lines, lambda x: ~x.startswith("http:") & ~x.startswith("<a href") & ~x.startswith("<AUTHOR") & (x != ""))
    return F.regexp_replace(F.array_join(kept, " "), r"\s+", " ")


def corpus(raw: DataFrame, lang: str) -> DataFrame:
    """(doc_name, xml, text) of a news corpus; Chinese is brought to simplified characters, by the JVM's conversion table."""
    xml = X.converted(F.col("text"), X.script_table(raw.sparkSession)) if lang == "zh" else F.col("text")
    return raw.select("doc_name", xml.alias("xml"), plain_text(xml).alias("text"))


def _authors(kind: str):
    pattern = _AUTHORS[kind]

    @F.pandas_udf(_SPANS)
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            out = []
            for m in pattern.finditer(text or ""):
                name = m.group(1)
                start = m.start(1) + len(name) - len(name.lstrip(" "))
                out.append({"start": start, "end": start + len(name.strip(" ")), "text": name.strip(" ")})
            return out

        return texts.map(one)

    return find


def authors(docs: DataFrame, kind: str = "newswire", xml: str = "xml") -> DataFrame:
    """(doc_name, start, end, surface, mention_type, mid, confidence): author names of a document's markup, blanks trimmed."""
    found = docs.select("doc_name", F.explode(_authors(kind)(xml)).alias("a"))
    return found.select(
        "doc_name", "a.start", "a.end", F.col("a.text").alias("surface"), F.lit("PER").alias("mention_type"), F.lit("NIL").alias("mid"), F.lit(1.0).alias("confidence")
    )


def quoted_intervals(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(doc_name, start, end): from ``<quote`` to just past the next ``/quote>``; an unclosed one is ignored."""

    @F.pandas_udf(_SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "text": None} for m in _QUOTE.finditer(t or "")])

    return docs.select("doc_name", F.explode(find(xml)).alias("q")).select("doc_name", "q.start", "q.end")


def align_offsets(docs: DataFrame, plain: str = "text", xml: str = "xml") -> DataFrame:
    """(doc_name, plain_start, plain_end, xml_start, xml_end) of the plain text's tokens, found forward in the markup."""

    schema = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("plain_start", "plain_end", "xml_start", "xml_end")]))

    @F.pandas_udf(schema)
    def align(plains: pd.Series, xmls: pd.Series) -> pd.Series:
        def one(text, markup):
            out, at = [], 0
            # markup is replaced by as many blanks, so that positions stay
            bare = re.sub(r"<.*?>", lambda m: " " * len(m.group()), (markup or "").replace("\n", " "))
            for m in re.finditer(r"\S+", text or ""):
                k = bare.find(m.group(), at)
                if k >= 0:
                    out.append({"plain_start": m.start(), "plain_end": m.end(), "xml_start": k, "xml_end": k + len(m.group())})
                    at = k + len(m.group())
            return out

        return pd.Series([one(t, x) for t, x in zip(plains, xmls, strict=True)])

    return docs.select("doc_name", F.explode(align(plain, xml)).alias("a")).select("doc_name", "a.*")


def to_xml_offsets(mentions: DataFrame, aligned: DataFrame) -> DataFrame:
    """Mentions whose plain offsets begin and end with tokens, with the offsets in the markup."""
    starts = aligned.select("doc_name", F.col("plain_start").alias("start"), "xml_start")
    ends = aligned.select("doc_name", F.col("plain_end").alias("end"), "xml_end")
    return mentions.join(starts, ["doc_name", "start"]).join(ends, ["doc_name", "end"])


def gold_mentions(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a gold table: col1 id, col2 surface, col3 doc:start-end (inclusive end), col4 mid, col5 type, col6 noun type.

    A document name without a known language raises an error.
    """
    p = lambda k: F.get("p", F.lit(k))
    rows = lines.select(F.split(line, "\t").alias("p")).where("size(p) >= 7")
    doc = F.substring_index(p(3), ":", 1)
    bounds = F.split(F.substring_index(p(3), ":", -1), "-")
    lang = F.raise_error(F.concat(F.lit("unknown language of "), doc)).cast("string")
    for code, name in DOC_LANGUAGE.items():
        lang = F.when(F.contains(doc, F.lit(code)), F.lit(name)).otherwise(lang)
    return rows.select(
        p(1).alias("id"), p(2).alias("surface"), doc.alias("doc_name"), bounds[0].cast("int").alias("start"), (bounds[1].cast("int") + 1).alias("end"),
        p(4).alias("mid"), p(5).alias("mention_type"), p(6).alias("noun_type"), lang.alias("lang"),
    )


def gold_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows as of ``gold_mentions``, rejected lines (line_id, reason)): every line is in one of the two.

    A quoted field may hold tabs and loses its quotes; a line whose quotes don't pair is cut at each tab. Reasons are
    ``columns`` (fewer than seven), ``language`` (none known in the document's name) and ``bounds`` (not two integers).
    """
    plain = F.split(F.regexp_replace(line, r"\r\z", ""), "\t")
    cells = F.when(F.col("well_formed"), F.transform("cells", rejects._unquoted)).otherwise(plain)
    rows = rejects.parse_lines(lines, line_id, line, keep=(line,)).select("line_id", cells.alias("p"))
    p = lambda k: F.get("p", F.lit(k))
    doc = F.substring_index(p(3), ":", 1)
    bounds = F.split(F.substring_index(p(3), ":", -1), "-")
    whole = lambda k: F.when(F.get(bounds, F.lit(k)).rlike(r"\A[0-9]+\z"), F.get(bounds, F.lit(k)).try_cast("long"))
    lang = F.lit(None).cast("string")
    for code, name in DOC_LANGUAGE.items():
        lang = F.when(F.contains(doc, F.lit(code)), F.lit(name)).otherwise(lang)
    start, end = whole(0).try_cast("int"), F.try_add(whole(1), F.lit(1)).try_cast("int")
    read = rows.select(
        "line_id", p(1).alias("id"), p(2).alias("surface"), doc.alias("doc_name"), start.alias("start"), end.alias("end"),
        p(4).alias("mid"), p(5).alias("mention_type"), p(6).alias("noun_type"), lang.alias("lang"),
        F.when(F.size("p") < 7, "columns").when(lang.isNull(), "language").when(start.isNull() | end.isNull(), "bounds").alias("reason"),
    )
    return read.where("reason is null").drop("line_id", "reason"), read.where("reason is not null").select("line_id", "reason")


def gold_slice(gold: DataFrame, lang: str, noun_type: str | None = "NAM") -> DataFrame:
    """Gold mentions of one language and noun type."""
    rows = gold.where(F.col("lang") == lang)
    return rows if noun_type is None else rows.where(F.col("noun_type") == noun_type)


def ere_mentions(entities: DataFrame) -> DataFrame:
    """Mentions of ERE entities (doc_name, entity XML text): specific ones, NAM or NOM; NOM uses the head's span; one for each span.

    ``entities`` has ``doc_name`` and ``entity``, an XML string of one entity element.
    """
    mention = "struct<_id:string,_noun_type:string,_offset:int,_length:int,mention_text:string,nom_head:struct<_VALUE:string,_offset:int,_length:int>>"
    schema = f"_id string, _type string, _specificity string, entity_mention array<{mention}>"
    parsed = entities.select("doc_name", F.from_xml("entity", schema).alias("e")).where("e._specificity = 'specific'")
    each = parsed.select("doc_name", F.col("e._id").alias("entity_id"), F.col("e._type").alias("mention_type"), F.posexplode("e.entity_mention").alias("pos", "m"))
    kept = each.where("m._noun_type in ('NAM', 'NOM')")
    nominal = F.col("m._noun_type") == "NOM"
    start = F.when(nominal, F.col("m.nom_head._offset")).otherwise(F.col("m._offset"))
    size = F.when(nominal, F.col("m.nom_head._length")).otherwise(F.col("m._length"))
    rows = kept.select(
        "doc_name", "entity_id", F.col("m._id").alias("mention_id"), "mention_type", F.col("m._noun_type").alias("noun_type"),
        start.alias("start"), (start + size).alias("end"), F.when(nominal, F.col("m.nom_head._VALUE")).otherwise(F.col("m.mention_text")).alias("surface"), "pos",
    )
    order = Window.partitionBy("doc_name", "start", "end").orderBy("entity_id", "pos")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "pos")


def conll_tokens(lines: DataFrame, line: str = "value", seq: str = "seq") -> DataFrame:
    """(doc_name, sent_id, seq, label, token, start, end): CoNLL columns; a blank line ends a sentence."""
    order = Window.partitionBy("doc_name").orderBy(seq)
    blank = F.trim(line) == ""
    marked = lines.withColumn("sent_id", F.sum(F.when(blank, 1).otherwise(0)).over(order)).where(~blank)
    p = F.split(line, "\t")
    return marked.select(
        "doc_name", "sent_id", seq, F.get(p, F.lit(0)).alias("label"), F.get(p, F.lit(5)).alias("token"), F.get(p, F.lit(1)).try_cast("int").alias("start"), F.get(p, F.lit(2)).try_cast("int").alias("end")
    )


def annotated_article(files: DataFrame, text: str = "text") -> DataFrame:
    """(doc_name, title, start, end) of ``#title<tab>start<tab>end`` lines whose offsets agree with a token line and whose title isn't blank."""
    lines = files.select("doc_name", F.explode(F.split(text, "\n")).alias("line")).select("doc_name", F.split("line", "\t").alias("p")).where("size(p) = 3")
    at = lambda k: F.get("p", F.lit(k)).try_cast("int")
    rows = lines.select("doc_name", F.get("p", F.lit(0)).alias("first"), at(1).alias("start"), at(2).alias("end"))
    toks = rows.where("not startswith(first, '#')")
    anchors = rows.where("startswith(first, '#') and trim(substring(first, 2)) != ''")
    starts = toks.select("doc_name", "start").distinct()
    ends = toks.select("doc_name", "end").distinct()
    valid = anchors.join(starts, ["doc_name", "start"], "left_semi").join(ends, ["doc_name", "end"], "left_semi")
    return valid.select("doc_name", F.expr("substring(first, 2)").alias("title"), "start", "end")


def usable_documents(docs: DataFrame, mentions: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first n documents in stored order that have mentions."""
    return docs.join(mentions.select("doc_name").distinct(), "doc_name", "left_semi").orderBy(seq).limit(n)


def search_titles(queries: DataFrame, cache: DataFrame, mode: str = "prefix") -> DataFrame:
    """``titles`` of a cached search (lang, mode, query, payload as JSON): the second element of the payload, blanks as underscores."""
    parsed = cache.where(F.col("mode") == mode).select("lang", "query", F.from_json(F.get_json_object("payload", "$[1]"), "array<string>").alias("t"))
    last = parsed.groupBy("lang", "query").agg(F.max("t").alias("t"))
    found = queries.join(last, ["lang", "query"], "left")
    return found.withColumn("titles", F.transform(F.coalesce("t", F.array().cast("array<string>")), lambda x: F.replace(x, F.lit(" "), F.lit("_")))).drop("t")


def search_categories(cache: DataFrame) -> DataFrame:
    """(title, category) of cached category answers (title, payload): ``query.pages.*.categories[].title``."""
    pages = F.from_json("payload", "query struct<pages: map<string, struct<categories: array<struct<title: string>>>>>")
    each = cache.select("title", F.explode(F.map_values(pages["query"]["pages"])).alias("page"))
    return each.select("title", F.explode("page.categories.title").alias("category"))


def search_fallback(mentions: DataFrame, cache: DataFrame) -> DataFrame:
    """Mentions without candidates take the first search result in their language, else in English, with confidence 0.8."""
    first = cache.where("size(titles) > 0").groupBy("lang", "query").agg(F.min(F.get("titles", F.lit(0))).alias("found"))
    own = mentions.withColumn("query", F.lower("surface")).join(first, ["lang", "query"], "left")
    english = first.where("lang = 'en'").select("query", F.col("found").alias("found_en"))
    both = own.join(english, "query", "left")
    use = F.col("wiki_title").isNull() | F.col("wiki_title").startswith("NIL")
    title = F.coalesce("found", "found_en")
    return both.withColumns(
        {
            "wiki_title": F.when(use, F.coalesce(title, F.lit("NIL"))).otherwise(F.col("wiki_title")),
            "confidence": F.when(use & title.isNotNull(), F.lit(0.8)).otherwise(F.col("confidence")),
        }
    ).drop("query", "found", "found_en")


def language_link_dict(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(lang, title, en_title) from pages (page_id, lang, title) and language links (page_id, lang, title[, seq]), joined by page and language.

    Of a title's several links the last by ``seq`` counts, of equals (or without ``seq``) the greatest.
    """
    order = F.col("seq") if "seq" in links.columns else F.lit(0)
    targets = links.select("page_id", "lang", X.normal_title(F.col("title")).alias("en_title"), order.alias("_o"))
    own = pages.where("title is not null").select("page_id", "lang", X.normal_title(F.col("title")).alias("title")).distinct()
    return titles.last_by(own.join(targets, ["page_id", "lang"]), ["lang", "title"], "en_title", "_o")


def all_languages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(title, lang, tgt_title): pages (page_id, title) with their links (page_id, lang, title[, seq]) in every language; the last of a language counts."""
    order = F.col("seq") if "seq" in links.columns else F.lit(0)
    targets = links.select("page_id", "lang", X.joined_title(F.col("title")).alias("tgt_title"), order.alias("_o"))
    own = pages.where("title is not null").select("page_id", X.joined_title(F.col("title")).alias("title")).distinct()
    return titles.last_by(own.join(targets, "page_id"), ["title", "lang"], "tgt_title", "_o")
