"""Admission of events to an append-only log, and queries of it.

Events: ``seq, event_id, workflow_id, kind (OPENED, CONCLUDED), material_id, decision, human_decision, event_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise

OK, DUPLICATE, ALREADY_OPENED, NOT_OPENED = "ok", "dup", "already_opened", "not_opened"
ALREADY_CONCLUDED, MATERIAL, RECOMMENDATION, TEMPORAL = "already_concluded", "material", "recommendation", "temporal"
COLUMNS = ["seq", "event_id", "workflow_id", "kind", "material_id", "decision", "human_decision", "event_at"]


def _independent(events: DataFrame) -> DataFrame:
    """Outcomes where each event id is of one workflow and one kind: minima over a workflow's events tell what is stored
    of it, so events are shuffled once and never folded."""
    of = Window.partitionBy("workflow_id")
    is_open = F.col("kind") == "OPENED"
    all_ = events.withColumn("open", F.min(F.when(is_open, F.struct("seq", "material_id", "decision", "event_at", "event_id"))).over(of))
    fits = (F.col("seq") > F.col("open.seq")) & (F.col("material_id") == F.col("open.material_id")) & (F.col("decision") == F.col("open.decision")) & (F.col("event_at") >= F.col("open.event_at"))
    all_ = all_.withColumn("end", F.min(F.when(~is_open & fits, F.struct("seq", "event_id"))).over(of))
    known = F.least(F.when(F.col("open.event_id") == F.col("event_id"), F.col("open.seq")), F.when(F.col("end.event_id") == F.col("event_id"), F.col("end.seq")))
    outcome = (
        F.when(known < F.col("seq"), DUPLICATE)
        .when((F.col("kind") == "OPENED") & (F.col("open.seq") < F.col("seq")), ALREADY_OPENED)
        .when(F.col("kind") == "OPENED", OK)
        .when(F.col("open").isNull() | (F.col("open.seq") > F.col("seq")), NOT_OPENED)
        .when(F.col("end.seq") < F.col("seq"), ALREADY_CONCLUDED)
        .when(F.col("material_id") != F.col("open.material_id"), MATERIAL)
        .when(F.col("decision") != F.col("open.decision"), RECOMMENDATION)
        .when(F.col("event_at") < F.col("open.event_at"), TEMPORAL)
        .otherwise(OK)
    )
    return all_.select(*events.columns, outcome.alias("outcome"))


def fold(events, opened: dict, concluded: set, ids: dict) -> list[str]:
    """Outcomes of events in their order, one by one; the three collections hold what was accepted so far."""
    out = []
    for event_id, wf, kind, material, decided, at in events:
        open_ = opened.get(wf)
        if kind == "OPENED":
            clash = sorted(x for x in ((ids.get(event_id, (None,))[0], DUPLICATE), (open_[3] if open_ else None, ALREADY_OPENED)) if x[0] is not None)
            said = clash[0][1] if clash else OK
            if clash and len(clash) > 1 and clash[0][0] == clash[1][0]:
                said = DUPLICATE
        elif event_id in ids:
            said = DUPLICATE
        elif open_ is None:
            said = NOT_OPENED
        elif wf in concluded:
            said = ALREADY_CONCLUDED
        elif material != open_[0]:
            said = MATERIAL
        elif decided != open_[1]:
            said = RECOMMENDATION
        elif at < open_[2]:
            said = TEMPORAL
        else:
            said = OK
        if said == OK:
            place = len(ids)
            ids[event_id] = (place,)
            if kind == "OPENED":
                opened[wf] = (material, decided, at, place)
            else:
                concluded.add(wf)
        out.append(said)
    return out


def _fold_groups(events: DataFrame) -> DataFrame:
    """The same for rows with a ``group``, each group folded in the order of ``seq``."""

    def run(pdf):
        pdf = pdf.sort_values("seq")
        pdf["outcome"] = fold(pdf[["event_id", "workflow_id", "kind", "material_id", "decision", "event_at"]].itertuples(index=False, name=None), {}, set(), {})
        return pdf.drop(columns="group")

    fields = [f for f in events.schema.fields if f.name != "group"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", outcome string"
    return events.groupBy("group").applyInPandas(run, schema)


def _groups(events: DataFrame, tangled: DataFrame) -> DataFrame:
    """``workflow_id``, ``group``: workflows that share event ids, directly or through others, by their smallest name."""
    edges = materialise(events.join(tangled, "event_id", "left_semi").select("workflow_id", "event_id").distinct(), "ties")
    now = materialise(edges.select("workflow_id").distinct().withColumn("group", F.col("workflow_id")), "groups", True)
    while True:
        by_id = edges.join(now, "workflow_id").groupBy("event_id").agg(F.min("group").alias("g"))
        near = edges.join(by_id, "event_id").groupBy("workflow_id").agg(F.min("g").alias("g"))
        # A group is a workflow with a group of its own: taking that doubles how far a name goes in a round.
        further = now.select(F.col("workflow_id").alias("g"), "group")
        new = materialise(near.join(further, "g").select("workflow_id", "group"), "groups", True)
        moved = not new.join(now.withColumnRenamed("group", "old"), "workflow_id").where("group < old").isEmpty()
        discard(now)
        now = new
        if not moved:
            discard(edges)
            return now


def admit(events: DataFrame) -> DataFrame:
    """``events`` with the ``outcome`` of appending them in the order of ``seq``: a rejected event is never stored and
    so never stands in a later one's way.

    Where an event id occurs in several workflows or kinds, the workflows that it ties together are folded one event
    at a time; all others need no order but minima. An opening that repeats both an id and a workflow is rejected for
    what was stored first."""
    use = F.when(F.col("workflow_id").isNotNull() & F.col("kind").isNotNull(), F.struct("workflow_id", "kind"))
    tangled = events.groupBy("event_id").agg(F.min(use).alias("a"), F.max(use).alias("b")).where("a <> b").select("event_id")
    if tangled.isEmpty():
        return _independent(events)
    group = _groups(events, tangled)
    free = _independent(events.join(group, "workflow_id", "left_anti"))
    return free.unionByName(_fold_groups(events.join(group, "workflow_id")))


def accepted(events: DataFrame) -> DataFrame:
    return admit(events).where(F.col("outcome") == OK).drop("outcome")


# Queries of an admitted log, of any kind or of openings alone. Lookup values are compared as they are given, never
# stripped; one that is no string is an error.


def _having(log: DataFrame, column: str, value: str) -> DataFrame:
    if not isinstance(value, str):
        raise ValueError(f"{column} must be a string, got {type(value).__name__}")
    return log.where(F.col(column) == value).orderBy("seq")


def by_event(log: DataFrame, event_id: str) -> DataFrame:
    return _having(log, "event_id", event_id).limit(1)


def by_material(log: DataFrame, material_id: str) -> DataFrame:
    return _having(log, "material_id", material_id)


def by_workflow(log: DataFrame, workflow_id: str) -> DataFrame:
    return _having(log, "workflow_id", workflow_id)


def opened_by_event(log: DataFrame, event_id: str) -> DataFrame:
    return by_event(log.where("kind = 'OPENED'"), event_id)


def opened_by_workflow(log: DataFrame, workflow_id: str) -> DataFrame:
    return by_workflow(log.where("kind = 'OPENED'"), workflow_id).limit(1)


def opened_by_material(log: DataFrame, material_id: str) -> DataFrame:
    return by_material(log.where("kind = 'OPENED'"), material_id)


def opened(log: DataFrame) -> DataFrame:
    """All openings in recording order."""
    return listed(log.where("kind = 'OPENED'"))


def listed(log: DataFrame) -> DataFrame:
    """In recording order, which is not the order of event times."""
    return log.orderBy("seq")
