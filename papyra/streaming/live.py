"""The filter language on streams: filters and projections are the same expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from papyra.operators.find import match
from papyra.operators.project import project
from papyra.sources.store import Collection


def live_find(stream: DataFrame, query: Mapping | None = None, projection: Mapping | None = None, id_field: str = "_id") -> DataFrame:
    """The matching documents of a streaming DataFrame, projected; no state is kept."""
    return project(match(stream, query), projection, id_field)


def append_to(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Insert every micro-batch of a stream into a collection, each as one version and once only.

    The version keeps the number of the newest batch by the stream's checkpoint folder, so a batch that is
    tried again after a failure is not added a second time.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            collection.insert(batch, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
