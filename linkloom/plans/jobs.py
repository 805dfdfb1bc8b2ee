"""Jobs for ``spark-submit``: build and save an index, annotate texts with a saved one.

    spark-submit linkloom/plans/jobs.py index TABLES INDEX
    spark-submit linkloom/plans/jobs.py annotate DOCUMENTS INDEX OUT [CONFIG]

TABLES is a folder with the tables mentions, kb_titles, kb_types, wiki_pages and wiki_redirects, DOCUMENTS a
Parquet table (doc_id, lang, text). Nothing that exists is overwritten.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from linkloom.config import Config, parse_config
from linkloom.operators import tokens
from linkloom.plans import pipeline
from linkloom.session import table


def build_index(spark: SparkSession, tables: str, path: str) -> None:
    """Statistics, title map, redirects and knowledge base from a folder of tables, saved below ``path``."""
    parts = {name: table(spark, tables, name) for name in ("kb_titles", "kb_types", "wiki_pages", "wiki_redirects")}
    pipeline.build_index(table(spark, tables, "mentions"), **parts).save(path)


def annotate_documents(spark: SparkSession, documents: str, index: str, out: str, config: Config | None = None, n_stops: int = 50) -> None:
    """Linked mentions of texts as a table; the stop words are the ``n_stops`` most frequent ones of each language."""
    docs = spark.read.parquet(documents).select("doc_id", "lang", "text")
    stops = tokens.top_words(docs, n_stops).select("lang", "word")
    linked = pipeline.annotate_text(docs, pipeline.Index.load(spark, index), config or Config(), stops)
    linked.write.mode("errorifexists").parquet(out)


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    job, *rest = arguments
    if job == "index" and len(rest) == 2:
        build_index(spark, *rest)
    elif job == "annotate" and len(rest) in (3, 4):
        annotate_documents(spark, *rest[:3], parse_config(Path(rest[3]).read_text()) if len(rest) == 4 else None)
    else:
        raise SystemExit(__doc__)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
