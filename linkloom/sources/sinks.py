"""Writers: line formats as columns (so that they can be checked and written by ``write.text``) and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.operators.intervals import drop_overlapping
from linkloom.operators.numbering import numbered
from linkloom.operators.tokens import token_lists


def submission_lines(mentions: DataFrame, run_id: str = "RUN") -> DataFrame:
    """(line): run, counter, surface, doc:start-(end - 1), mid, type, NAM, confidence, English title; counted from 0 in document order."""
    rows = numbered(mentions, ["doc_id", "start", "mention_id"], "_n")
    span = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), (F.col("end") - 1).cast("string"))
    fields = [F.lit(run_id), (F.col("_n") - 1).cast("string"), F.col("surface"), span, X.or_nil(F.col("mid")), F.col("mention_type"), F.lit("NAM"), F.format_string("%.4f", "confidence"), X.or_nil(F.col("en_title"))]
    return rows.select("mention_id", F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields]).alias("line"))


def evaluation_lines(mentions: DataFrame) -> DataFrame:
    """(line): doc, start, end - 1, mid, 0, type."""
    return mentions.select(
        F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("start").cast("string"), (F.col("end") - 1).cast("string"), X.or_nil(F.col("mid")), F.lit("0"), F.coalesce("mention_type", F.lit(""))).alias("line")
    )


def _escaped(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def ere_documents(mentions: DataFrame, legacy_length: bool = True) -> DataFrame:
    """(doc_id, xml): one rich-ERE file a document; entities by mid, mentions longest first, the first gives the type.

    ``legacy_length`` counts a mention's length as end - start + 1.
    """
    size = F.col("end") - F.col("start") + (1 if legacy_length else 0)
    one = F.concat(
        F.lit('<entity_mention id="m-'), F.col("mention_id").cast("string"), F.lit('" noun_type="'), F.col("noun_type"), F.lit('" source="'), F.col("doc_id").cast("string"),
        F.lit('" offset="'), F.col("start").cast("string"), F.lit('" length="'), size.cast("string"), F.lit('"><mention_text>'), _escaped(F.col("surface")), F.lit("</mention_text></entity_mention>"),
    )
    rows = mentions.where("mid is not null and start is not null and end is not null and surface is not null and noun_type is not null")
    listed = F.array_sort(F.collect_list(F.struct((-F.length("surface")).alias("by"), "start", "mention_id", F.coalesce("mention_type", F.lit("")).alias("type"), one.alias("xml"))))
    entities = rows.groupBy("doc_id", "mid").agg(listed.alias("ms"))
    entity = F.concat(
        F.lit('<entity id="ent-'), F.col("mid"), F.lit('" type="'), F.col("ms")[0]["type"], F.lit('" specificity="specific" kb_id="'), F.col("mid"), F.lit('">'),
        F.array_join(F.transform("ms", lambda m: m["xml"]), ""), F.lit("</entity>"),
    )
    docs = entities.select("doc_id", "mid", entity.alias("xml")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mid", "xml"))).alias("es"))
    head = F.concat(F.lit('<deft_ere kit_id="kit_id" doc_id="'), F.col("doc_id").cast("string"), F.lit('" source_type="multi_post"><entities>'))
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform("es", lambda e: e["xml"]), ""), F.lit("</entities></deft_ere>")).alias("xml"))


def conll_lines(labelled: DataFrame, features: str | None = None, quoted: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_id, tok_id, line): label, start, end, x, x, token and four x, then features.

    Link tokens, blanks and tokens in ``quoted`` intervals (doc_id, start, end) are dropped.
    """
    x = F.lit("x")
    rows = labelled.where(~F.col("token").rlike(r"^\s*$") & ~F.col("token").startswith("http:"))
    if quoted is not None:
        keyed = rows.withColumn("_k", F.concat_ws("|", "doc_id", "tok_id"))
        rows = drop_overlapping(keyed, quoted, "_k").drop("_k")
    fields = [F.col("label"), F.col("start").cast("string"), F.col("end").cast("string"), x, x, F.col("token"), x, x, x, x]
    if features:
        fields.append(F.array_join(features, "\t"))
    return rows.select("doc_id", "sent_id", "tok_id", F.concat_ws("\t", *fields).alias("line"))


def annotation_texts(articles: DataFrame) -> DataFrame:
    """(page_id, title, text): an article's tokens as ``token start end`` lines, then its links as ``#title start end`` lines.

    ``articles`` has (page_id, title, plain, anchors); an article without tokens has its links only.
    """
    lists = token_lists(articles, "page_id", "plain", "title").select(F.col("doc_id").alias("page_id"), "sent_id", "toks")
    cells = lambda first, r: F.concat_ws("\t", first, r["start"].cast("string"), r["end"].cast("string"))
    lines = lists.select("page_id", "sent_id", F.transform("toks", lambda t: cells(t["token"], t)).alias("lines"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "lines"))), lambda e: e["lines"])
    tokens_of = lines.groupBy("page_id").agg(F.flatten(ordered).alias("tokens"))
    links = F.transform("anchors", lambda a: cells(F.concat(F.lit("#"), a["title"]), a))
    joined = articles.join(tokens_of, "page_id", "left")
    return joined.select("page_id", "title", F.array_join(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), links), "\n").alias("text"))


def anchor_lines(anchors: DataFrame) -> DataFrame:
    """(line): surface, title."""
    return anchors.select(F.concat_ws("\t", "surface", "title").alias("line"))


def alignment_lines(mapping: DataFrame) -> DataFrame:
    """(line): ``title_<en> ||| title_<foreign>``."""
    return mapping.select(F.concat_ws(" ||| ", F.concat(F.lit("title_"), "en_title"), F.concat(F.lit("title_"), "title")).alias("line"))


def linked_html(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, html): a document's text with its mentions as links to their titles; of overlapping mentions the first counts."""
    rows = mentions.where("start is not null and end is not null and end > start").select("doc_id", F.struct("start", "end", X.or_nil(F.col("wiki_title")).alias("title")).alias("m"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    joined = docs.join(listed, "doc_id", "left").where("text is not null")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col("text")

    def step(acc: Column, m: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        link = F.concat(F.lit('<a href="#'), m["title"], F.lit('">'), F.substring(text, m["start"] + 1, m["end"] - m["start"]), F.lit("</a>"))
        return F.when(m["start"] >= acc["at"], F.struct(F.concat(acc["out"], before, link).alias("out"), m["end"].alias("at"))).otherwise(acc)

    empty = F.array().cast("array<struct<start:int,end:int,title:string>>")
    folded = F.aggregate(F.coalesce("ms", empty), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select("doc_id", folded.alias("html"))


def write_index(table: DataFrame, path: str, partition: str = "lang") -> None:
    """An index as a table partitioned by language, if it tells one; an existing one is never overwritten."""
    writer = table.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition in table.columns else writer).parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files."""
    lines.select("line").write.mode("errorifexists").text(path)
