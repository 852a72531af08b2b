"""Measures of recommendations against what specialists decided later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reviews import agrees

SPAN_DAYS = 32


def as_of(assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reviews(material_id, reviewed_at, human_decision)`` each with the last of ``assessments(material_id, assessed_at, decision,
    group)`` of its material at its time or before (``assessed_at``, ``decision``, ``group`` null, if there is none; of the
    same time the greatest decision and group).

    No range join: both kinds of rows go by material and span of SPAN_DAYS days, where a window carries the last
    assessment on; what a span begins with is the last assessment of the spans before, from one row a material and span.
    So a material that very many rows speak of is dealt out by time."""
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (SPAN_DAYS * 86_400_000_000))
    state = lambda at: F.struct(F.col(at).alias("assessed_at"), "decision", "group")
    a = assessments.where("material_id is not null and assessed_at is not null").select("material_id", span("assessed_at").alias("span"), F.col("assessed_at").alias("at"), state("assessed_at").alias("said"))
    nothing = F.lit(None).cast(a.schema["said"].dataType)
    r = reviews.where("material_id is not null and reviewed_at is not null").select("material_id", span("reviewed_at").alias("span"), F.col("reviewed_at").alias("at"), nothing.alias("said"), "human_decision")
    both = a.withColumn("human_decision", F.lit(None).cast("string")).withColumn("review", F.lit(False)).unionByName(r.withColumn("review", F.lit(True)))
    spans = both.groupBy("material_id", "span").agg(F.max("said").alias("last"))
    before = Window.partitionBy("material_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("material_id", "span", F.last("last", True).over(before).alias("carried"))
    in_span = Window.partitionBy("material_id", "span").orderBy("at", "review", "said").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("own", F.last("said", True).over(in_span)).where("review").join(spans, ["material_id", "span"])
    found = F.coalesce("own", "carried")
    return out.select("material_id", F.col("at").alias("reviewed_at"), "human_decision", found["assessed_at"].alias("assessed_at"), found["decision"].alias("decision"), found["group"].alias("group"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def specialist_measures(judged: DataFrame) -> DataFrame:
    """Measures of ``judged(group, decision, human_decision)``, a row a reviewed recommendation, for each group and decision, each
    group, each decision and all (``of`` says which; ``group`` and ``decision`` are null where they are summed over):

    ``reviewed``; ``agreed`` and ``accuracy``, the share that the specialist decided alike; ``to_review`` and ``review_rate``,
    the share that was sent to review; ``false_accepts`` and ``false_accept_rate``, approved ones that the specialist did not
    approve, of the approved; ``false_rejects`` and ``false_reject_rate``, rejected ones that the specialist approved, of the
    rejected. Shares of nothing are 0; without a judged recommendation there is no row."""
    rows = judged.where("decision is not null").withColumns(
        {
            "alike": agrees(F.col("decision"), F.col("human_decision")).cast("long"), "sent": (F.col("decision") == "REVIEW").cast("long"), "yes": (F.col("decision") == "APPROVE").cast("long"), "no": (F.col("decision") == "REJECT").cast("long"),
            "bad_yes": ((F.col("decision") == "APPROVE") & (F.col("human_decision") != "APPROVE")).cast("long"), "bad_no": ((F.col("decision") == "REJECT") & (F.col("human_decision") == "APPROVE")).cast("long"),
        }
    )
    sets = rows.groupingSets([("group", "decision"), ("group",), ("decision",), ()], "group", "decision")
    sums = {"agreed": "alike", "to_review": "sent", "approved": "yes", "rejected": "no", "false_accepts": "bad_yes", "false_rejects": "bad_no"}
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("reviewed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])
    of = F.when(F.col("g") == 0, "group and decision").when(F.col("g") == 1, "group").when(F.col("g") == 2, "decision").otherwise("all")
    return out.select(
        of.alias("of"), "group", "decision", "reviewed", "agreed", _share(F.col("agreed"), F.col("reviewed")).alias("accuracy"), "to_review", _share(F.col("to_review"), F.col("reviewed")).alias("review_rate"),
        "false_accepts", _share(F.col("false_accepts"), F.col("approved")).alias("false_accept_rate"), "false_rejects", _share(F.col("false_rejects"), F.col("rejected")).alias("false_reject_rate"),
    )
