"""Row rules: each is a Column that holds an issue or null; a row's issues are an array in rule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as d
from ..functions.text import full_description, is_blank, normalize, strip, tokens


def _issue(when: Column, kind: str, field: str, message: Column | str, severity: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    issue = F.struct(F.lit(kind).alias("issue_type"), F.lit(field).alias("field_name"), text.alias("message"), F.lit(severity).alias("severity"))
    return F.when(when, issue)


def _any(words: Column, known: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, known)))


def with_features(materials: DataFrame) -> DataFrame:
    """The normalised texts that rules and duplicates share, each made once a row."""
    plain = {f"{f}_n": normalize(F.col(f)) for f in ("description_short", "unit", "manufacturer", "manufacturer_part_number", "material_group")}
    return materials.withColumns(plain | {"full_n": normalize(full_description(F.col("description_short"), F.col("long_description")))})


def required_issues() -> list[Column]:
    return [_issue(is_blank(F.col(f)), "MISSING_CRITICAL_FIELD", f, d.MESSAGES["required"] + f, "BLOCKING") for f in d.REQUIRED]


def unit_issue() -> Column:
    """An unknown unit, or else a liquid that is counted in pieces."""
    unknown = (F.col("unit_n") != "") & ~F.col("unit_n").isin(*d.UNITS)
    liquid = F.col("unit_n").isin(*d.PIECES) & _any(tokens(F.col("full_n")), d.LIQUIDS)
    return F.coalesce(
        _issue(unknown, "INVALID_UNIT", "unit", F.concat(F.lit(d.MESSAGES["unit"]), "unit"), "BLOCKING"),
        _issue(liquid, "SUSPICIOUS_UNIT", "unit", d.MESSAGES["liquid"], "WARNING"),
    )


def status_issue() -> Column:
    state = F.upper(strip(F.col("status")))
    return _issue((state != "") & ~state.isin(*d.STATUSES), "INVALID_STATUS", "status", F.concat(F.lit(d.MESSAGES["status"]), "status"), "BLOCKING")


def ambiguity_issue() -> Column:
    bare = is_blank(F.col("long_description")) & is_blank(F.col("manufacturer_part_number"))
    return _issue(bare & _any(tokens(F.col("description_short_n")), d.GENERIC), "AMBIGUOUS_DESCRIPTION", "description_short", d.MESSAGES["generic"], "WARNING")


def technical_issue() -> Column:
    """The first family that the description names and whose attribute it lacks."""
    text, words = F.col("full_n"), tokens(F.col("full_n"))
    lacks = {
        "CABO": ~text.rlike(d.VOLTAGE),
        "MOTOR": ~(text.rlike(d.VOLTAGE) & text.rlike(d.FREQUENCY)),
        "FILTRO": is_blank(F.col("manufacturer_part_number")) & ~_any(words, d.FILTER_WORDS),
        "MANOMETRO": ~_any(words, d.GAUGE_WORDS),
    }
    found = [_issue(F.array_contains(words, family) & lack, "MISSING_TECHNICAL_ATTRIBUTE", "long_description", d.MESSAGES["technical"] + d.MISSING[family], "WARNING") for family, lack in lacks.items()]
    return F.coalesce(*found)


def rule_issues() -> Column:
    """All issues of a row with features, in rule order."""
    return F.array_compact(F.array(*required_issues(), unit_issue(), status_issue(), ambiguity_issue(), technical_issue()))


def duplicate_issue() -> Column:
    return _issue(F.lit(True), "POSSIBLE_DUPLICATE", "description_short", d.MESSAGES["duplicate"], "WARNING")
