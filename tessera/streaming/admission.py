"""Admission of a stream of events to a log store, across workflows and restarts.

Whether an event is accepted depends on its workflow's accepted events and on whether its id was accepted anywhere before,
which in turn depends on that other workflow. No state that is keyed by workflow, or by id first and workflow then, has
both at the time, as an id that a workflow rejects stays free for others. So a micro-batch is judged as an append to the
store: what the log has of the batch's workflows and ids is looked up there, and the version that names the batch's files
says which batch of the stream they are. A batch that is run again after a failure finds itself committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.logstore import LogStore


def admit_stream(events: DataFrame, store: LogStore, name: str, checkpoint: str) -> StreamingQuery:
    """Append the streaming ``events`` (with a ``seq`` that is distinct within a batch) to ``store`` until the source has no
    more now; batches in their order, a batch's events in the order of ``seq``. ``name`` tells streams of one store apart;
    each needs a checkpoint of its own. Each batch's outcomes are kept by the store."""

    def put(batch: DataFrame, n: int) -> None:
        store.append(batch, stream=(name, n))

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
