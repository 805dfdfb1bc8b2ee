"""Filling containers of fixed capacity with documents measured in tokens.

The plan is made on the histogram of sizes, which has at most ``capacity`` entries whatever the number
of documents: sizes above a third of the capacity pair greedily, the largest with the largest that
still fits, at most two to a container; smaller sizes, in descending order, go where the remaining gap
is the tightest. Many containers of equal contents are planned as one group with a count. Documents
are numbered within their size without gathering a size in one task (numbers within salted parts plus
the parts' offsets), and a document's number tells its container.

A text above the capacity is cut into full containers and a remainder, which is packed like any other
item; nothing else is split.

Defined results: a null, empty or blank text with no tokens needs no container and has no row; a null
capacity is ignored, a capacity below one raises ``ValueError``; rows repeated as a whole are packed
each for itself; ties are broken by number, so that results are the same for the same rows in each
run; empty tables give an empty result; other columns are ignored; texts are measured whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.session import cut_lineage

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Items that one task numbers within their size.
PART_ROWS = 200_000


def count_tokens(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, doc_id: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) in tokens of a public byte-pair vocabulary file; map-side only.

    The file is read where the driver runs and sent to the executors; ``pattern`` is the expression that cuts a text into
    words before (by default that of the package the file is from).
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    context = docs.sparkSession.sparkContext
    name = Path(tokenizer).name
    if name not in {Path(f).name for f in context.listFiles}:
        context.addFile(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": pd.Series(sizes, dtype="int64")})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "doc_id long, n_tokens long")


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (size, first, last, container, per_container) and the number of containers.

    The items numbered ``first`` to ``last`` - 1 of a size go, ``per_container`` at a time, into
    consecutive containers from ``container`` on.
    """
    if capacity < 1:
        raise ValueError("a capacity of at least one token is needed")
    intervals: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    gaps: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    n_containers = 0

    def put(size: int, count: int, container: int, each: int = 1) -> None:
        first = used.get(size, 0)
        used[size] = first + count
        intervals.append((size, first, first + count, container, each))

    def leave(gap: int, container: int, count: int) -> None:
        if gap:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((container, count))

    third = capacity // 3
    left = {s: n for s, n in histogram.items() if third < s <= capacity and n}
    sizes = sorted(left)
    while sizes:
        size = sizes[-1]
        k = bisect_left(sizes, capacity - size + 1) - 1
        if k >= 0 and sizes[k] == size and left[size] == 1:
            k -= 1  # the last item of a size has the next smaller size as mate
        if k < 0:
            n = left.pop(size)
            sizes.remove(size)
            put(size, n, n_containers)
            leave(capacity - size, n_containers, n)
            n_containers += n
            continue
        mate = sizes[k]
        n = left[size] // 2 if mate == size else min(left[size], left[mate])
        if mate == size:
            put(size, 2 * n, n_containers, 2)
        else:
            put(size, n, n_containers)
            put(mate, n, n_containers)
        leave(capacity - size - mate, n_containers, n)
        n_containers += n
        for s in (size, mate):
            left[s] -= n
        for s in {size, mate}:
            if not left[s]:
                sizes.remove(s)

    for size in sorted((s for s in histogram if 0 < s <= third), reverse=True):
        n = histogram[size]
        while n:
            k = bisect_left(gaps, size)
            if k == len(gaps):
                each = capacity // size
                full = max(1, n // each)
                leave(capacity, n_containers, full)
                n_containers += full
                continue
            gap = gaps[k]
            container, count = groups[gap].pop()
            each = min(gap // size, n)
            taken = min(count, n // each)
            put(size, each * taken, container, each)
            n -= each * taken
            if count > taken:
                groups[gap].append((container + taken, count - taken))
            if not groups[gap]:
                del groups[gap]
                gaps.remove(gap)
            leave(gap - each * size, container, taken)
    return intervals, n_containers


def _numbered(items: DataFrame, most: int) -> DataFrame:
    """``number`` of each item among those of its size, without one task for a size; ``most`` is the greatest number of one size."""
    part = F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(1 + most // PART_ROWS)).alias("part")
    parted = items.select("*", part)
    counts = parted.groupBy("size", "part").count()
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "piece", "copy")) - 1
    return parted.withColumn("within", within).join(offsets, ["size", "part"]).withColumn("number", F.col("within") + F.col("offset"))


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, token_start, token_end, container): where each document, or piece of one, goes.

    ``sizes`` has ``doc_id`` and ``n_tokens``.
    """
    spark = sizes.sparkSession
    if capacity < 1:
        raise ValueError("a capacity of at least one token is needed")
    counted = sizes.where("n_tokens > 0").groupBy("doc_id", "n_tokens").count()
    each = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    cap = F.lit(capacity).cast("long")
    pieces = each.select(
        "doc_id",
        "copy",
        "n_tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / cap))).alias("piece"),
    ).select(
        "doc_id",
        "copy",
        "piece",
        (F.col("piece") * cap).alias("token_start"),
        F.least(F.col("n_tokens"), (F.col("piece") + 1) * cap).alias("token_end"),
    )
    items = cut_lineage(pieces.withColumn("size", F.col("token_end") - F.col("token_start")))
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most `capacity` rows
    intervals, _ = plan_containers(histogram, capacity)
    plan = spark.createDataFrame(
        pd.DataFrame(np.array(intervals, dtype=np.int64).reshape(-1, 5), columns=["size", "first", "last", "base", "each"]),
        "size long, first long, last long, base long, each long",
    )
    # the plan's size is bounded by the capacity, not by the number of documents
    return (
        _numbered(items, max(histogram.values(), default=0))
        .join(F.broadcast(plan), "size")
        .where("number >= first and number < last")
        .select(
            "doc_id",
            "piece",
            "token_start",
            "token_end",
            (F.col("base") + F.floor((F.col("number") - F.col("first")) / F.col("each"))).alias("container"),
        )
    )


def pack_all(docs: DataFrame, pack_sizes: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``pack`` for every capacity of a table (pack_id, capacity_tokens), with pack_id; tokens are counted once."""
    sizes = cut_lineage(count_tokens(docs, tokenizer))
    chosen = sorted({(r["pack_id"], r["capacity_tokens"]) for r in pack_sizes.where("capacity_tokens is not null").collect()}, key=str)
    out = None
    for pack_id, capacity in chosen:
        packed = pack(sizes, capacity).select(F.lit(pack_id).cast("int").alias("pack_id"), "*")
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        return sizes.sparkSession.createDataFrame([], "pack_id int, doc_id long, piece long, token_start long, token_end long, container long")
    return out
