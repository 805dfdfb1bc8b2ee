"""Interval operators over character spans: overlap, containment, BIO labels, nesting.

Spans are half-open. Overlap joins have the document and a bin of characters as equal keys. Rows with null
offsets overlap nothing: they are kept by anti-joins and dropped elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators.tokens import BIN, token_spans


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def _bins(start: Column, end: Column) -> Column:
    return F.sequence((start / BIN).cast("long"), ((F.greatest(end, start + 1) - 1) / BIN).cast("long"))


def drop_overlapping(spans: DataFrame, bad: DataFrame, key: str = "mention_id") -> DataFrame:
    """Spans that overlap no bad interval (doc_id, start, end)."""
    right = bad.where("start is not null and end is not null").select("doc_id", F.col("start").alias("bs"), F.col("end").alias("be"))
    right = right.withColumn("bin", F.explode(_bins(F.col("bs"), F.col("be"))))
    left = spans.where("start is not null and end is not null").select(key, "doc_id", "start", "end").withColumn("bin", F.explode(_bins(F.col("start"), F.col("end"))))
    hit = left.join(right, ["doc_id", "bin"]).where(overlaps(F.col("start"), F.col("end"), F.col("bs"), F.col("be"))).select(key).distinct()
    return spans.join(hit, key, "left_anti")


def first_of_span(spans: DataFrame, order: str = "mention_id") -> DataFrame:
    """One row for each (doc_id, start, end): the first by ``order``."""
    w = Window.partitionBy("doc_id", "start", "end").orderBy(order)
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quotation_spans(toks: DataFrame, opening: str = "“", closing: str = "”") -> DataFrame:
    """(doc_id, start, end): from each opening mark behind the next closing mark; an unclosed one is ignored."""
    ahead = Window.partitionBy("doc_id").orderBy("tok_id").rowsBetween(1, Window.unboundedFollowing)
    marks = toks.where(F.col("token").isin(opening, closing))
    closed = marks.withColumn("close", F.min(F.when(F.col("token") == closing, F.col("end"))).over(ahead))
    return closed.where((F.col("token") == opening) & F.col("close").isNotNull()).select("doc_id", "start", F.col("close").alias("end"))


def propagate_types(inner: DataFrame, outer: DataFrame, keep: tuple[str, ...] = ("person", "location", "organization")) -> DataFrame:
    """(doc_id, start, end, feature): type features that an n-gram takes from the longer n-grams around it.

    ``outer`` has ``features`` (array); a name that contains ``TOPFBTYPETOKEN-<type>`` is handed on, with
    ``B-`` if both begin at one place and ``I-`` else.
    """
    right = outer.select("doc_id", F.col("start").alias("os"), F.col("end").alias("oe"), F.explode("features").alias("name"))
    kinds = right.select("*", F.explode(F.array(*[F.lit(k) for k in keep])).alias("kind")).where("contains(name, concat('TOPFBTYPETOKEN-', kind))")
    kinds = kinds.withColumn("bin", F.explode(_bins(F.col("os"), F.col("oe"))))
    left = inner.select("doc_id", "start", "end").withColumn("bin", (F.col("start") / BIN).cast("long"))
    hits = left.join(kinds, ["doc_id", "bin"]).where("start >= os and end <= oe")
    prefix = F.when(F.col("start") > F.col("os"), F.lit("I-")).otherwise(F.lit("B-"))
    return hits.select("doc_id", "start", "end", F.concat(prefix, F.lit("TOPFBTYPETOKEN-"), "kind").alias("feature")).distinct()


def bio_encode(toks: DataFrame, spans: DataFrame, key: str = "mention_id") -> DataFrame:
    """Tokens with a ``label``: B-/I- and the type of the first span (by start, then key) over it, else O."""
    at = token_spans(spans, toks, key).join(spans.select(key, "start", F.col("mention_type").alias("type")), key)
    covered = at.where("type is not null").select("doc_id", F.struct("start", key, "type").alias("m"), F.explode(F.sequence("first_tok", "last_tok")).alias("tok_id"))
    first = covered.groupBy("doc_id", "tok_id").agg(F.min("m").alias("m"))
    before = Window.partitionBy("doc_id").orderBy("tok_id")
    joined = toks.join(first, ["doc_id", "tok_id"], "left")
    same = F.lag(f"m.{key}").over(before) == F.col(f"m.{key}")
    label = F.when(F.col("m").isNull(), F.lit("O")).otherwise(F.concat(F.when(same, F.lit("I-")).otherwise(F.lit("B-")), F.col("m.type")))
    return joined.withColumn("label", label).drop("m")


def bio_decode(labelled: DataFrame, emit_trailing: bool = True) -> DataFrame:
    """(doc_id, sent_id, start, end, mention_type): runs of one type inside a sentence; O, a B- and another type close a run.

    Without ``emit_trailing`` a run that reaches the end of its sentence is lost.
    """
    order = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")
    kind = F.when(F.col("label") != "O", F.substring_index("label", "-", -1))
    typed = labelled.withColumn("kind", kind)
    begins = F.col("label").startswith("B-") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    runs = typed.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(order)).withColumn("last", F.max("tok_id").over(Window.partitionBy("doc_id", "sent_id")))
    spans = runs.where("kind is not null").groupBy("doc_id", "sent_id", "run", "last").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("mention_type"), F.max("tok_id").alias("last_tok")
    )
    if not emit_trailing:
        spans = spans.where("last_tok < last")
    return spans.select("doc_id", "sent_id", "start", "end", "mention_type")


def kept_spans(spans: list[tuple[int, int, int]]) -> list[int]:
    """Positions kept by the greedy pass over (start, end, length): of two that overlap the shorter goes, of equals the later."""
    gone: set[int] = set()
    for i, (start, end, size) in enumerate(spans):
        for j in range(i + 1, len(spans)):
            if i in gone:
                break
            if j not in gone and overlaps(start, end, spans[j][0], spans[j][1]):
                gone.add(j if size >= spans[j][2] else i)
    return [i for i in range(len(spans)) if i not in gone]


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pass over rows that come chain by chain, in order; a chain may go on in the next batch."""

    def kept(spans: list[tuple]) -> list[tuple]:
        return [spans[i] for i in kept_spans([(r[2], r[3], r[3] - r[2]) for r in spans])]

    columns = ["mention_id", "doc_id", "start", "end"]
    chain: list[tuple] = []
    last = None
    for batch in batches:
        out: list[tuple] = []
        for row in batch[[*columns, "chain"]].itertuples(index=False, name=None):
            if (row[1], row[4]) != last:
                out += kept(chain)
                chain, last = [], (row[1], row[4])
            chain.append(row[:4])
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(kept(chain), columns=columns)


def resolve_nested(spans: DataFrame) -> DataFrame:
    """Greedy pass over a document's spans by start: of two that overlap the shorter one goes, of equals the later.

    ``spans`` has (mention_id, doc_id, start, end). Documents are cut where no span reaches across, so that
    a task gets one chain of overlapping spans, not a whole document.
    """
    valid = spans.where("start is not null and end is not null and end > start").select("mention_id", "doc_id", "start", "end")
    order = Window.partitionBy("doc_id").orderBy("start", "end", "mention_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = valid.withColumn("chain", F.when(reach > F.col("start"), 0).otherwise(1)).withColumn("chain", F.sum("chain").over(order))
    size = F.count("*").over(Window.partitionBy("doc_id", "chain"))
    sized = chained.withColumn("n", size)
    alone = sized.where("n = 1").select("mention_id", "doc_id", "start", "end")
    # chains are many and short: they are walked in order instead of making a group of each
    several = (
        sized.where("n > 1")
        .repartition("doc_id", "chain")
        .sortWithinPartitions("doc_id", "chain", "start", "end", "mention_id")
        .select("mention_id", "doc_id", "start", "end", "chain")
        .mapInPandas(_resolve, alone.schema)
    )
    return alone.unionByName(several)
