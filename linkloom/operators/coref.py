"""Coreference: containment, greedy surface clustering, identifiers of unknown entities, star edges.

``cluster_surfaces`` gives the result of the ordered greedy pass (clusters by size, longest surface, id;
each takes in the later clusters that have a surface with a token overlap of more than a half with one
of its own) without a pass: a cluster leads once all earlier neighbours are taken in, and is taken in
once an earlier neighbour leads. Each round decides all clusters that can be decided. Pairs are found by
the rarest half of a surface's tokens, as surfaces that overlap by more than a half share one of them;
mentions of the same tokens meet as one.

Null surfaces, types or offsets never match; repeated rows count once where they have the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import text as X
from linkloom.operators.numbering import numbered
from linkloom.session import cut_lineage


def person_containment(mentions: DataFrame) -> DataFrame:
    """Mentions with ``mid``, ``wiki_title`` and ``confidence`` of the longest PER mention of their document that contains them.

    Surfaces are distinct per document before they meet; a container without mid keeps the own values.
    """
    people = mentions.where("mention_type = 'PER' and surface is not null").withColumn("low", F.lower("surface"))
    stands = Window.partitionBy("doc_id", "low").orderBy("start", "mention_id")
    forms = people.withColumn("_n", F.row_number().over(stands)).where("_n = 1 and low != ''").select("doc_id", "low", "start", "mid", "wiki_title", "confidence")
    # a container holds every piece of what it contains, so each form asks for its rarest piece only
    pieces = forms.select("doc_id", "low", "start", F.explode(_pieces(F.col("low"), (1, 2, 3))).alias("piece"))
    frequency = pieces.groupBy("doc_id", "piece").agg(F.count("*").alias("df"))
    own = forms.select("doc_id", "low", F.explode(_pieces(F.col("low"), (3,))).alias("piece")).join(frequency, ["doc_id", "piece"])
    asked = own.groupBy("doc_id", "low").agg(F.min(F.struct("df", "piece")).alias("r")).select("doc_id", "low", F.col("r.piece").alias("piece"))
    outer = pieces.select("doc_id", "piece", F.col("low").alias("o_low"), "start")
    pairs = asked.join(outer, ["doc_id", "piece"]).where("length(o_low) > length(low) and contains(o_low, low)")
    # pieces don't carry what a container gives; the form that is chosen is looked up
    best = pairs.groupBy("doc_id", "low").agg(F.min_by("o_low", F.struct(-F.length("o_low"), "start")).alias("o_low"))
    given = forms.select("doc_id", F.col("low").alias("o_low"), F.struct("mid", "wiki_title", "confidence").alias("o"))
    best = best.join(given, ["doc_id", "o_low"]).select("doc_id", "low", "o")
    joined = mentions.withColumn("low", F.when(F.col("mention_type") == "PER", F.lower("surface"))).join(best, ["doc_id", "low"], "left")
    take = F.col("o").isNotNull() & ~X.is_nil(F.col("o.mid"))
    out = {c: F.when(take, F.col(f"o.{c}")).otherwise(F.col(c)) for c in ("mid", "wiki_title", "confidence")}
    return joined.withColumns(out).drop("low", "o")


def _pieces(c: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of the given lengths; a shorter text is its own piece."""
    def cut(n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda k: F.substring(c, k, F.lit(n)))
        return F.when(F.length(c) >= n, pieces).otherwise(F.array(c))

    each = [cut(n) for n in sizes]
    return F.array_distinct(F.concat(*each))


def jaccard_pairs(forms: DataFrame, scope: list[str], threshold: float = 0.5) -> DataFrame:
    """(scope, key_a, key_b, score): forms (scope, key, tokens) of one scope whose token overlap is above the threshold; key_a < key_b.

    ``forms`` should be distinct token sets. Only the rarest ceil(size / 2) tokens of each are compared, which
    loses nothing for thresholds from one half.
    """
    if threshold < 0.5:
        raise ValueError("the prefix that is compared is lossless for thresholds from 0.5 on")
    each = forms.select(*scope, "key", "tokens", F.explode("tokens").alias("token"))
    frequency = each.groupBy(*scope, "token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy(*scope, "key").orderBy("df", "token"))
    prefix = each.join(frequency, [*scope, "token"]).withColumn("r", rank).where("r <= ceil(size(tokens) / 2)").select(*scope, "token", "key", "tokens")
    left = prefix.select(*scope, "token", F.col("key").alias("key_a"), F.col("tokens").alias("tokens_a"))
    right = prefix.select(*scope, "token", F.col("key").alias("key_b"), F.col("tokens").alias("tokens_b"))
    near = left.join(right, [*scope, "token"]).where(
        "key_a < key_b and size(tokens_a) < 2 * size(tokens_b) and size(tokens_b) < 2 * size(tokens_a)"
    )
    scored = near.withColumn("score", X.jaccard(F.col("tokens_a"), F.col("tokens_b"))).where(F.col("score") > threshold)
    return scored.select(*scope, "key_a", "key_b", "score").distinct()


def lead_and_follow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, leader): the greedy assignment; ``edges`` (a, b) with a < b says that a would take b in.

    Equals the sequential pass over the nodes in ascending order. Each round decides the least undecided node of every
    group at least, so the rounds end; their number is that of the longest chain of decisions.
    """
    open_edges = cut_lineage(edges.select("a", "b").where("a < b").distinct())
    touched = cut_lineage(open_edges.select(F.col("a").alias("node")).union(open_edges.select("b")).distinct())
    undecided, leaders = touched, None
    while not undecided.isEmpty():
        # a node that no open edge leads to is a leader; what it takes in is decided too
        new = cut_lineage(undecided.join(open_edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        taken = open_edges.join(new.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        leaders = new if leaders is None else leaders.unionByName(new)
        undecided = cut_lineage(undecided.join(new.unionByName(taken), "node", "left_anti"))
        alive = undecided.withColumnRenamed("node", "a")
        open_edges = cut_lineage(open_edges.join(alive, "a", "left_semi").join(alive.withColumnRenamed("a", "b"), "b", "left_semi"))
    if leaders is None:
        return nodes.select("node", F.col("node").alias("leader"))
    by_leader = edges.join(leaders.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    own = leaders.withColumn("own", F.lit(True))
    joined = nodes.select("node").join(own, "node", "left").join(by_leader, "node", "left")
    return joined.select("node", F.when(F.col("own"), F.col("node")).otherwise(F.coalesce("leader", "node")).alias("leader"))


def cluster_surfaces(mentions: DataFrame, scope: list[str], mention_threshold: int = 1) -> DataFrame:
    """(mention_id, cluster_id): greedy surface clusters inside each scope and type.

    ``mentions`` has mention_id, mention_type, surface, mid and the scope columns. Mentions of one mid are a
    cluster from the start; mentions without mid are grouped by their tokens, as they would take each other in.
    """
    inside = [*scope, "type"]
    keyed = mentions.where("surface is not null and mention_type is not null").select(
        "mention_id", *scope, "surface", X.surface_tokens(F.col("surface")).alias("tokens"), "mention_type",
        F.when(X.is_nil(F.col("mid")), F.lit(None)).otherwise(F.col("mid")).alias("target"),
    )
    # without mid, one cluster for each token set and type; with mid, one for each mid, of its longest mention's type
    with_mid = keyed.where("target is not null")
    kind = with_mid.groupBy(*scope, "target").agg(F.min_by("mention_type", F.struct(-F.length("surface"), "mention_id")).alias("type"))
    known = with_mid.join(kind, [*scope, "target"]).withColumn("unit", F.concat(F.lit("m|"), "target"))
    unknown = keyed.where("target is null").withColumn("type", F.col("mention_type")).withColumn("unit", F.concat(F.lit("t|"), F.array_join(F.array_sort("tokens"), "|")))
    cols = ["mention_id", *inside, "unit", "surface", "tokens"]
    members = cut_lineage(known.select(*cols).unionByName(unknown.select(*cols)))
    single = F.col("unit").startswith("t|")
    units = members.groupBy(*inside, "unit").agg(
        F.max(F.when(single, F.lit(1)).otherwise(F.lit(None))).alias("single"), F.count("*").alias("n"), F.max(F.length("surface")).alias("longest"), F.min("mention_id").alias("first")
    )
    # a cluster without mid has one mention when the pass begins
    units = units.select(*inside, "unit", "first", F.when(F.col("single") == 1, -1).otherwise(-F.col("n")).alias("by_size"), (-F.col("longest")).alias("by_length"))
    ordered = cut_lineage(numbered(units, ["by_size", "by_length", "first", "unit"], "node").select(*inside, "unit", "node", "first"))
    surfaces = members.select(*inside, "unit", "tokens").withColumn("tokens", F.array_sort("tokens")).where("size(tokens) > 0").distinct()
    sets = cut_lineage(surfaces.join(ordered, [*inside, "unit"]).select(*inside, "node", "tokens"))
    forms = sets.select(*inside, F.array_join("tokens", "|").alias("key"), "tokens").distinct()
    near = jaccard_pairs(forms, inside)
    both = near.select(*inside, "key_a", "key_b").unionByName(near.select(*inside, F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    both = both.unionByName(forms.select(*inside, F.col("key").alias("key_a"), F.col("key").alias("key_b")))
    of = sets.select(*inside, "node", F.array_join("tokens", "|").alias("key"))
    hits = (
        both.join(of.withColumnsRenamed({"key": "key_a", "node": "a"}), [*inside, "key_a"])
        .join(of.withColumnsRenamed({"key": "key_b", "node": "b"}), [*inside, "key_b"])
        .where("a < b")
    )
    edges = hits.groupBy("a", "b").agg(F.count_distinct("key_b").alias("n")).where(F.col("n") >= mention_threshold).select("a", "b")
    led = lead_and_follow(ordered, cut_lineage(edges))
    named = led.join(ordered.select(F.col("node").alias("leader"), F.col("unit").alias("lead_unit"), F.col("first").alias("lead_first")), "leader")
    cluster = F.when(F.col("lead_unit").startswith("m|"), F.substring(F.col("lead_unit"), F.lit(3), F.length("lead_unit"))).otherwise(
        F.concat(F.lit("NIL"), F.format_string("%05d", "lead_first"))
    )
    ids = ordered.join(named.select("node", cluster.alias("cluster_id")), "node").select(*inside, "unit", "cluster_id")
    return members.join(ids, [*inside, "unit"]).select("mention_id", *scope, "cluster_id")


def nil_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """``nil_id``: NIL and a running number of at least five digits."""
    return numbered(rows, order, "_number").withColumn("nil_id", F.format_string("NIL%05d", "_number")).drop("_number")


def coreference_view(mentions: DataFrame, target: str = "mid") -> DataFrame:
    """Star edges (doc_id, target, mention_id, canonical_id): the longest mention of a target is canonical, of equals the first."""
    stars = mentions.where(F.col(target).isNotNull() & F.col("surface").isNotNull())
    canonical = stars.groupBy("doc_id", target).agg(F.min_by("mention_id", F.struct(-F.length("surface"), "start", "mention_id")).alias("canonical_id"))
    return stars.join(canonical, ["doc_id", target]).select("doc_id", F.col(target).alias("target"), "mention_id", "canonical_id")


def candidate_maps(candidates: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, scores): candidate titles with scores as a map; of repeated titles the last by rank counts."""
    last = candidates.groupBy(key, "title").agg(F.max_by("score", "rank").alias("score"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "score")))).alias("scores"))
