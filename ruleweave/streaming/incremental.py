"""Closures over streams: each micro-batch of facts adds its consequences, by the same semi-naive rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


class StreamingClosure:
    """Feeds a stream of facts of one predicate into an engine.

    State is the closure: its relations are written tables, extended batch by batch.
    A batch that is delivered again changes nothing, as facts are sets.
    """

    def __init__(self, engine: Engine, pred: str, on_batch: Callable[[Engine, int], None] | None = None) -> None:
        self.engine, self.pred, self.on_batch = engine, pred, on_batch
        self.batches = 0

    def add_batch(self, facts: DataFrame, number: int) -> None:
        self.engine.run()
        # the batch lives in the stream's own session; its rows enter as a plain table
        self.engine.add_facts(self.pred, facts)
        self.batches += 1
        if self.on_batch:
            self.on_batch(self.engine, number)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Start the query on a stream whose first one or two columns are the facts."""
        writer = stream.writeStream.foreachBatch(self.add_batch).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
