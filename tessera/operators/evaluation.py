"""Assessments against expected labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d


def predicted(issues: Column) -> Column:
    kinds = F.array_distinct(F.transform(issues, lambda x: x["issue_type"]))
    return F.when(F.size(issues) == 0, F.array(F.lit("VALID"))).otherwise(kinds)


def with_outcome(assessments: DataFrame, labels: DataFrame) -> DataFrame:
    """Assessments joined to ``labels(ord, expected_issue)`` one to one, with the predicted labels and what is right. A row
    without its counterpart is an error when the result is computed."""
    both = assessments.join(labels.select(F.col("ord").alias("label_ord"), d.LABEL), F.col("ord") == F.col("label_ord"), "full")
    alone = F.col("ord").isNull() | F.col("label_ord").isNull()
    both = both.where(F.when(alone, F.raise_error(F.lit("assessments and labels are not one to one")).cast("boolean")).otherwise(True)).drop("label_ord")
    out = both.withColumn("predicted", predicted(F.col("issues")))
    hit = F.array_contains("predicted", F.col(d.LABEL))
    return out.withColumns({"hit": hit, "exact": hit & (F.size("predicted") == 1)})


def _ratio(a: str, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))


def report(outcome: DataFrame) -> DataFrame:
    """The evaluation in one row, from one aggregation."""
    wants, says = F.col(d.LABEL) == "POSSIBLE_DUPLICATE", F.array_contains("predicted", F.lit("POSSIBLE_DUPLICATE"))
    sums = outcome.agg(
        F.count("*").alias("total"),
        F.count_if("exact").alias("correct"),
        F.count_if("hit").alias("label_hits"),
        F.count_if(wants & says).alias("duplicate_true_positives"),
        F.count_if(~wants & says).alias("duplicate_false_positives"),
        F.count_if(wants & ~says).alias("duplicate_false_negatives"),
        F.count_if((F.col(d.LABEL) == "VALID") & (F.col("decision") == "REVIEW")).alias("unnecessary_reviews"),
    )
    tp = F.col("duplicate_true_positives")
    return sums.withColumns({
        "exact_match_accuracy": _ratio("correct", F.col("total")),
        "label_hit_rate": _ratio("label_hits", F.col("total")),
        "duplicate_precision": _ratio("duplicate_true_positives", tp + F.col("duplicate_false_positives")),
        "duplicate_recall": _ratio("duplicate_true_positives", tp + F.col("duplicate_false_negatives")),
        "weighted_error_cost": F.col("duplicate_false_negatives") * d.COST_MISSED_DUPLICATE + F.col("unnecessary_reviews") * d.COST_NEEDLESS_REVIEW,
    })


def decision_counts(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("decision").agg(F.count("*").alias("n"))


def errors(outcome: DataFrame) -> DataFrame:
    """``ord``, ``material_id``, ``line`` of the rows that are not exact."""
    said = F.concat(F.lit("['"), F.array_join(F.array_sort("predicted"), "', '"), F.lit("']"))
    line = F.concat("material_id", F.lit(": esperado="), d.LABEL, F.lit(", previsto="), said)
    return outcome.where(~F.col("exact")).select("ord", "material_id", line.alias("line"))
