"""The state of workflows as a table that follows a stream: a snapshot and the changes of each batch."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import OK
from ..operators.projection import workflow_state
from ..sources.logstore import Conflict, Folder, LifecycleStore

STATES = "workflow_id string, material_id string, decision string, status string, opened_at timestamp, closed_at timestamp, lead_time_us long, human_decision string"


@dataclass(frozen=True)
class Feed:
    """A version: the whole snapshot up to a number, the batches of changes after it, all batches so far."""

    number: int = 0
    snapshot: str | None = None
    since: tuple[str, ...] = ()
    batches: tuple[str, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)


class StateTable:
    """``workflow_id`` and its state in the folder ``path``. Each batch adds the states that it changed; after ``compact_every``
    batches snapshot and changes are merged into a new snapshot. Versions are put in place like the log store's, so
    readers see a batch whole or not at all, and a batch of a stream counts once."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 8):
        self.spark, self.path, self.folder, self.every = spark, path.rstrip("/"), Folder(spark, path), compact_every

    def version(self) -> Feed:
        found = [n for n in self.folder.names("_versions") if n.endswith(".json") and not n.startswith(".")]
        if not found:
            return Feed()
        x = json.loads(self.folder.read(f"_versions/{found[-1]}"))
        return Feed(**{**x, "since": tuple(x["since"]), "batches": tuple(x["batches"])})

    def _commit(self, new: Feed) -> None:
        if not self.folder.put_if_absent(f"_versions/{new.number:012d}.json", json.dumps(new.__dict__)):
            raise Conflict(f"version {new.number} of {self.path} exists")

    def _changes(self, names: tuple[str, ...]) -> DataFrame:
        schema = f"{STATES}, place long"
        paths = [f"{self.path}/changes/batch={x}" for x in names]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/changes").parquet(*paths).drop("batch") if paths else self.spark.createDataFrame([], schema)

    def _whole(self, at: Feed) -> DataFrame:
        """The snapshot but for workflows that changed since, and the last of each one's changes."""
        changes = self._changes(at.since)
        last = changes.groupBy("workflow_id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "workflow_id"]), "place").alias("s")).select("workflow_id", "s.*").drop("place")
        if at.snapshot is None:
            return last
        old = self.spark.read.schema(STATES).parquet(f"{self.path}/snapshots/{at.snapshot}")
        return old.join(last.select("workflow_id"), "workflow_id", "left_anti").unionByName(last)

    def snapshot(self) -> DataFrame:
        """The state of every workflow now."""
        return self._whole(self.version())

    def changes(self, after: int = 0) -> DataFrame:
        """The states that batches after the first ``after`` set, with the number of the batch (``place``, from 1)."""
        return self._changes(self.version().batches[after:])

    def apply(self, states: DataFrame, stream: tuple[str, int]) -> None:
        """Put the ``states`` that a stream's batch set (one row a workflow); a batch that was put before is left out. One
        stream at a time."""
        at = self.version()
        if at.streams.get(stream[0], -1) >= stream[1]:
            return
        name = uuid.uuid4().hex
        states.withColumn("place", F.lit(len(at.batches) + 1).cast("long")).write.parquet(f"{self.path}/changes/batch={name}")
        new = replace(at, number=at.number + 1, since=(*at.since, name), batches=(*at.batches, name), streams={**at.streams, stream[0]: stream[1]})
        if len(new.since) >= self.every:
            whole = uuid.uuid4().hex
            self._whole(new).write.parquet(f"{self.path}/snapshots/{whole}")
            new = replace(new, snapshot=whole, since=())
        self._commit(new)


def states_of(store: LifecycleStore, workflows: DataFrame) -> DataFrame:
    """The states of these ``workflow_id`` (distinct) from the buckets of the log that have them."""
    return workflow_state(store.of_workflows(workflows)).select(*[c.split()[0] for c in STATES.split(", ")])


def follow(events: DataFrame, store: LifecycleStore, table: StateTable, name: str, checkpoint: str) -> StreamingQuery:
    """Admit the streaming ``events`` to ``store`` and keep ``table`` up with it, until the source has no more now. The states
    of workflows that a batch changed come from the log itself, so a batch that is run again, be it after either commit,
    puts the same."""

    def put(batch: DataFrame, n: int) -> None:
        told = store.append(batch, stream=(name, n))
        took = batch.select("seq", "workflow_id").join(told.where(F.col("outcome") == OK).select("seq"), "seq").select("workflow_id").distinct()
        table.apply(states_of(store, took), (name, n))

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
