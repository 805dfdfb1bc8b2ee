"""Online linking: documents' mentions arrive as a stream and are linked batch by batch, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkloom.plans.pipeline import Index, annotate


def link_stream(mentions: DataFrame, index: Index, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start linking a streaming table of mentions; ``write`` gets each linked batch and its number.

    ``index`` should be one that was saved and loaded: every batch reads it, and would make it again otherwise.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(annotate(rows, index), number)

    return mentions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
