"""The admission fold and the state of workflows over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d


def _accepted_first(events: Column, test) -> Column:
    return F.get(F.filter(events, test), F.lit(0))


def workflow_states(events: DataFrame) -> DataFrame:
    """The state of every workflow that a micro-batch changes, in update mode. Events of one workflow are admitted in the
    order of ``seq`` within a batch, and batches in theirs. Event ids are unique within a workflow here; ids that cross
    workflows need the batch admission.

    The state of a workflow is the list of its events, kept by Spark's streaming aggregation. A workflow accepts its first
    opening and the first conclusion after that which fits it, so two looks through the list in its order are the fold.
    Batches are told apart by Spark's time of the batch, which is in the checkpoint and the same when a batch is run again; a
    clock that is set back between two batches would put them in the wrong order."""
    one = F.struct("arrived", "seq", "kind", "event_id", "material_id", "decision", "human_decision", F.col("event_at").cast("timestamp").alias("event_at"))
    all_ = events.withColumn("arrived", F.current_timestamp()).groupBy("workflow_id").agg(F.collect_list(one).alias("events"))
    all_ = all_.withColumn("events", F.sort_array("events"))
    all_ = all_.withColumn("open", _accepted_first(F.col("events"), lambda e: e["kind"] == "OPENED")).where("open is not null")
    o = {k: F.col(f"open.{k}") for k in ("arrived", "seq", "event_id", "material_id", "decision", "event_at")}

    def fits(e: Column) -> Column:
        later = (e["arrived"] > o["arrived"]) | ((e["arrived"] == o["arrived"]) & (e["seq"] > o["seq"]))
        same = e["material_id"].eqNullSafe(o["material_id"]) & e["decision"].eqNullSafe(o["decision"]) & ~e["event_id"].eqNullSafe(o["event_id"])
        return ~e["kind"].eqNullSafe("OPENED") & later & same & F.coalesce(e["event_at"] >= o["event_at"], F.lit(True))

    all_ = all_.withColumn("end", _accepted_first(F.col("events"), fits)).withColumn("now", F.element_at("events", -1)["arrived"])
    took = sum((F.coalesce(F.col(f"{x}.arrived") == F.col("now"), F.lit(False)).cast("long") for x in ("open", "end")), F.lit(0))
    came = F.size(F.filter("events", lambda e: e["arrived"] == F.col("now"))).cast("long")
    return all_.select(
        "workflow_id", "open.material_id", "open.decision", F.when(F.col("end").isNull(), d.PENDING).otherwise(d.REVIEWED).alias("status"), F.col("open.event_at").alias("opened_at"),
        F.col("end.event_at").alias("closed_at"), F.timestamp_diff("MICROSECOND", F.col("open.event_at"), F.col("end.event_at")).alias("lead_time_us"), F.col("end.human_decision").alias("human_decision"),
        (came - took).alias("n_rejected"),
    )


def run_to_end(events: DataFrame, path: str) -> None:
    """Process what the source holds and stop; each batch's changed states are a part ``batch`` of the table ``path``/states.
    A batch that is run again replaces what it wrote before."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/states/batch={n}")

    query = workflow_states(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
