"""Workflow state from event histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d


def _folded(events: DataFrame) -> DataFrame:
    """One row per workflow from one combinable aggregation."""
    is_open, is_end = F.col("kind") == "OPENED", F.col("kind") == "CONCLUDED"
    what = F.struct("seq", "material_id", "decision", "human_decision", "event_at")
    return events.groupBy("workflow_id").agg(
        F.min_by("kind", "seq").alias("first_kind"),
        F.count_if(is_open).alias("n_opened"),
        F.count_if(is_end).alias("n_concluded"),
        F.count("*").alias("n"),
        F.min(F.when(is_open, what)).alias("open"),
        F.min(F.when(is_end, what)).alias("end"),
    )


def history_violation(events: DataFrame) -> DataFrame:
    """``workflow_id``, ``violation``: the first reason why a history is no workflow, or null."""
    fault = (
        F.when(F.col("n") != F.col("n_opened") + F.col("n_concluded"), "unknown event kind")
        .when(F.col("first_kind") != "OPENED", "first event is not an opening")
        .when(F.col("n_opened") != 1, F.format_string("expected one opening, got %d", "n_opened"))
        .when(F.col("n_concluded") > 1, F.format_string("expected at most one conclusion, got %d", "n_concluded"))
        .when(F.col("end.material_id") != F.col("open.material_id"), "material mismatch")
        .when(F.col("end.decision") != F.col("open.decision"), "recommendation mismatch")
        .when(F.col("end.event_at") < F.col("open.event_at"), "reviewed before opened")
    )
    return _folded(events).select("workflow_id", fault.alias("violation"))


def pending(opened_event: DataFrame) -> DataFrame:
    """Openings as workflows that wait for their review."""
    return workflow_state(opened_event.where("kind = 'OPENED'"))


def conclude(workflows: DataFrame, ends: DataFrame) -> DataFrame:
    """``workflows`` (of ``workflow_state``) joined to at most one review each (``workflow_id, material_id, decision,
    human_decision, event_at``): the concluded state, or a ``violation`` why the review can't conclude it."""
    w, e = workflows.alias("w"), ends.alias("e")
    fault = (
        F.when(F.col("e.workflow_id").isNull(), None)
        .when(F.col("w.status") == d.REVIEWED, "already reviewed")
        .when(F.col("w.material_id") != F.col("e.material_id"), "material mismatch")
        .when(F.col("w.decision") != F.col("e.decision"), "recommendation mismatch")
        .when(F.col("e.event_at") < F.col("w.opened_at"), "reviewed before opened")
    )
    out = w.join(e, F.col("w.workflow_id") == F.col("e.workflow_id"), "left").withColumn("violation", fault)
    ok = F.col("e.workflow_id").isNotNull() & F.col("violation").isNull()
    return out.select(
        "w.workflow_id", "w.material_id", "w.decision", F.when(ok, d.REVIEWED).otherwise(F.col("w.status")).alias("status"), "w.opened_at",
        F.when(ok, F.col("e.event_at")).otherwise(F.col("w.closed_at")).alias("closed_at"),
        F.when(ok, F.timestamp_diff("MICROSECOND", F.col("w.opened_at"), F.col("e.event_at"))).otherwise(F.col("w.lead_time_us")).alias("lead_time_us"),
        F.when(ok, F.col("e.human_decision")).otherwise(F.col("w.human_decision")).alias("human_decision"), "violation",
    )


def workflow_state(log: DataFrame) -> DataFrame:
    """The state of each workflow of an admitted log; times stay in their own type, the lead time is in microseconds."""
    lead = F.timestamp_diff("MICROSECOND", F.col("open.event_at"), F.col("end.event_at"))
    return _folded(log).select(
        "workflow_id",
        F.col("open.material_id").alias("material_id"),
        F.col("open.decision").alias("decision"),
        F.when(F.col("end").isNull(), d.PENDING).otherwise(d.REVIEWED).alias("status"),
        F.col("open.event_at").alias("opened_at"),
        F.col("end.event_at").alias("closed_at"),
        lead.alias("lead_time_us"),
        F.col("end.human_decision").alias("human_decision"),
    )
