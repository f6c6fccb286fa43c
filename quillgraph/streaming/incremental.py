"""Continuous sync: each micro-batch of a stream of documents goes through the batch sync.

An extra over batch runs.  A batch upserts only what it carries; it never tombstones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillgraph.corpus import Corpus
from quillgraph.operators.sync import first_of_each, sync_diff


def stream_documents(stream: DataFrame, corpus: Corpus, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """``stream``: rows of the documents table.  ``after`` gets the touched rows and the batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = first_of_each(batch, "id", "version")
        status = sync_diff(corpus.table("documents"), rows).where("status IN ('created', 'updated', 'resurrected')").select("id")
        touched = corpus.cut(rows.join(status, "id", "left_semi"))
        corpus.upsert("documents", touched, "id")
        if after is not None:
            after(touched, batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
