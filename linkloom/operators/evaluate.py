"""Precision, recall and F1 of predicted mentions against gold ones.

A prediction meets the first gold mention (by id) with the same span in a document whose name begins with
the gold one's. Null offsets match nothing but count as predictions or golds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as X


def match_gold(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions (id, doc, start, end, type, mid, cand_mids) with the flags span_ok, type_ok, link_ok, in_candidates, nil_gold."""
    g = gold.select(F.col("id").alias("g_id"), F.col("doc").alias("g_doc"), "start", "end", F.col("type").alias("g_type"), F.col("mid").alias("g_mid"))
    # document names are few: a name meets the gold names that are its beginnings, then mentions meet inside such a pair
    names = pred.where("doc is not null").select("doc").distinct()
    beginnings = names.select("doc", F.explode(F.transform(F.sequence(F.lit(0), F.length("doc")), lambda k: F.substring("doc", F.lit(1), k))).alias("g_doc"))
    documents = beginnings.join(gold.select(F.col("doc").alias("g_doc")).distinct(), "g_doc")
    hits = pred.select("id", "doc", "start", "end").join(documents, "doc").join(g, ["g_doc", "start", "end"])
    first = hits.groupBy("id").agg(F.min(F.struct("g_id", "g_type", "g_mid")).alias("g"))
    joined = pred.join(first, "id", "left")
    span = F.col("g").isNotNull()
    kind = span & F.coalesce(F.col("type") == F.col("g.g_type"), F.lit(False))
    own_nil, gold_nil = X.is_nil(F.col("mid")), X.is_nil(F.col("g.g_mid"))
    link = kind & ((own_nil & gold_nil) | F.coalesce(F.col("mid") == F.col("g.g_mid"), F.lit(False)))
    in_cands = kind & ~gold_nil & ~link & F.coalesce(F.array_contains("cand_mids", F.col("g.g_mid")), F.lit(False))
    return joined.select("id", "doc", span.alias("span_ok"), kind.alias("type_ok"), link.alias("link_ok"), in_cands.alias("in_candidates"), (kind & gold_nil).alias("nil_gold"))


def attach_authors(mentions: DataFrame, authors: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions and, behind them, the authors (doc_name, ...) of the same documents, by equal names; columns that authors lack are null."""
    own = authors.join(docs.select("doc_name").distinct(), "doc_name", "left_semi")
    return mentions.unionByName(own, allowMissingColumns=True)


def _scores(level: str, hit: Column, n_pred: Column, n_gold: Column) -> Column:
    p, r = F.coalesce(F.try_divide(hit, n_pred), F.lit(0.0)), F.coalesce(F.try_divide(hit, n_gold), F.lit(0.0))
    return F.struct(F.lit(level).alias("level"), hit.alias("correct"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def precision_recall(matched: DataFrame, n_gold: DataFrame) -> DataFrame:
    """(level, correct, precision, recall, f1) for spans, typed spans and linked spans; ``n_gold`` is one row."""
    flags = ("span_ok", "type_ok", "link_ok")
    counts = matched.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in flags], F.lit(0).cast("long").alias("n_gold"))
    golds = n_gold.select(*[F.lit(0).cast("long").alias(c) for c in ("n", *flags)], F.col("n_gold").cast("long").alias("n_gold"))
    totals = counts.unionByName(golds).agg(*[F.sum(c).alias(c) for c in ("n", *flags, "n_gold")])
    levels = [("span", "span_ok"), ("type", "type_ok"), ("link", "link_ok")]
    rows = F.array(*[_scores(name, F.col(c), F.col("n"), F.col("n_gold")) for name, c in levels])
    return totals.select(F.explode(rows).alias("s")).select("s.*")
