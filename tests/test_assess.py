import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import domain as d
from tessera.operators import decisions, duplicates, evaluation, rules

FULL = dict(material_id="M1", description_short="VALVULA ESFERA 2 POL", long_description="INOX 300", unit="PC", manufacturer="ACME", manufacturer_part_number="P-1", material_group="VALVES", status="ACTIVE")


def frame(spark, *rows):
    return spark.createDataFrame([(i, *[({**FULL} | r)[f] for f in d.FIELDS]) for i, r in enumerate(rows)], d.MATERIAL)


def assessed(spark, *rows, **how):
    return {r.ord: r for r in decisions.assess(frame(spark, *rows), **how).collect()}


@pytest.mark.parametrize(("change", "kinds", "decided"), [
    ({}, [], "APPROVE"),
    ({"unit": " ", "status": ""}, ["MISSING_CRITICAL_FIELD"] * 2, "REJECT"),
    ({"unit": "CX"}, ["INVALID_UNIT"], "REJECT"),
    ({"unit": "-"}, [], "APPROVE"),
    ({"unit": "m²"}, ["INVALID_UNIT"], "REJECT"),
    ({"long_description": "óleo 68"}, ["SUSPICIOUS_UNIT"], "REVIEW"),
    ({"unit": "L", "long_description": "óleo 68"}, [], "APPROVE"),
    ({"status": " active "}, [], "APPROVE"),
    ({"status": "ATIVO"}, ["INVALID_STATUS"], "REJECT"),
    ({"description_short": "ITEM GERAL", "long_description": "", "manufacturer_part_number": ""}, ["AMBIGUOUS_DESCRIPTION"], "REVIEW"),
    ({"description_short": "ITEM GERAL", "long_description": ""}, [], "APPROVE"),
    ({"description_short": "CABO 3X2"}, ["MISSING_TECHNICAL_ATTRIBUTE"], "REVIEW"),
    ({"description_short": "CABO 750 V"}, [], "APPROVE"),
    ({"description_short": "CABO 750V MOTOR"}, ["MISSING_TECHNICAL_ATTRIBUTE"], "REVIEW"),
    ({"description_short": "MOTOR 220V 60HZ"}, [], "APPROVE"),
    ({"description_short": "FILTRO AR"}, [], "APPROVE"),
    ({"description_short": "FILTRO AR", "manufacturer_part_number": ""}, ["MISSING_TECHNICAL_ATTRIBUTE"], "REVIEW"),
    ({"description_short": "MANOMETRO 10 BAR"}, ["MISSING_TECHNICAL_ATTRIBUTE"], "REVIEW"),
    ({"description_short": "MANÔMETRO CONEXÃO 1/2"}, [], "APPROVE"),
])
def test_rules(spark, change, kinds, decided):
    (row,) = assessed(spark, change).values()
    assert [i.issue_type for i in row.issues] == kinds and row.decision == decided
    assert row.evidence == [i.message for i in row.issues]


def test_messages_and_order(spark):
    (row,) = assessed(spark, {"description_short": "", "unit": "Cx ", "status": "x", "long_description": "CABO"}).values()
    assert [(i.field_name, i.message, i.severity) for i in row.issues] == [
        ("description_short", "Campo obrigatório ausente: description_short", "BLOCKING"), ("unit", "Unidade não reconhecida: Cx ", "BLOCKING"),
        ("status", "Status não reconhecido: x", "BLOCKING"), ("long_description", "Atributo técnico ausente: tensão nominal", "WARNING"),
    ]


def test_confidence_falls_with_issues(spark):
    issues = [F.array(*[rules.duplicate_issue()] * n) if n else F.array().cast("array<struct<issue_type:string,field_name:string,message:string,severity:string>>") for n in range(6)]
    row = spark.range(1).select(*[decisions.confidence(decisions.decision(i), i).alias(f"c{n}") for n, i in enumerate(issues)]).first()
    assert list(row) == pytest.approx([0.95, 0.77, 0.69, 0.61, 0.55, 0.55])


def test_empty_id(spark):
    with pytest.raises(PySparkException, match="material_id"):
        assessed(spark, {"material_id": ""})
    (row,) = assessed(spark, {"material_id": ""}, strict=False).values()
    assert row.violation == d.EMPTY_ID


def test_candidates_keep_order_and_repeated_ids(spark):
    rows = assessed(spark, {"material_id": "B"}, {"material_id": "A"}, {"material_id": "B"}, {"material_id": "C"})
    assert [rows[i].duplicate_candidates for i in range(4)] == [[], ["B"], ["A"], ["B", "A", "B"]]
    assert rows[3].issues[-1].issue_type == "POSSIBLE_DUPLICATE" and rows[0].decision == "APPROVE"


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [
        dict(material_id=f"M{rng.randrange(40)}", description_short=f"{pick('PARAF', 'TUBO', 'VALV')} {pick('10', '20', 'A')} {pick('30', '40', '')} {pick('50', 'ACO')}", long_description=pick("", "AC 10", "X7 8"),
             manufacturer=pick("", "ACME", "acmé"), manufacturer_part_number=pick("", "", "", "p 1", "P-1", "Q"), material_group=pick("", "G", "g"))
        for _ in range(60)
    ]
    own = duplicates.duplicate_features(rules.with_features(frame(spark, *rows)))
    got = [(r.i_ord, r.e_ord) for r in duplicates.duplicate_pairs(own, own).collect()]
    f = sorted(own.collect(), key=lambda r: r.ord)

    def same(i, e):
        if i.material_id == e.material_id:
            return False
        if i.mpn and i.mf and (i.mpn, i.mf) == (e.mpn, e.mf):
            return True
        return i.grp == e.grp and i.cat == e.cat and len(set(i.nums) & set(e.nums)) >= 2 and bool(set(i.words) & set(e.words))

    want = [(i.ord, e.ord) for e, i in itertools.combinations(f, 2) if same(i, e)]
    assert sorted(got) == sorted(want) and want and len(set(got)) == len(got)
    catalogue = duplicates.duplicate_pairs(own.where("ord < 20"), own.where("ord >= 20"), earlier_only=False).count()
    assert catalogue == sum(same(i, e) for i in f[:20] for e in f[20:])


def test_duplicate_join_plans_no_nested_loop(spark):
    own = duplicates.duplicate_features(rules.with_features(frame(spark, {}, {})))
    plan = duplicates.duplicate_pairs(own, own)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_evaluation(spark):
    m = frame(spark, {"material_id": "A"}, {"material_id": "B"}, {"material_id": "C", "manufacturer_part_number": "Z", "description_short": "TUBO", "unit": "CX"}, {"material_id": "D", "manufacturer_part_number": "Y", "description_short": "CABO"})
    labels = spark.createDataFrame([(0, "VALID"), (1, "POSSIBLE_DUPLICATE"), (2, "POSSIBLE_DUPLICATE"), (3, "VALID")], "ord long, expected_issue string")
    outcome = evaluation.with_outcome(decisions.assess(m), labels)
    r = evaluation.report(outcome).first()
    assert (r.total, r.correct, r.label_hits, r.duplicate_true_positives, r.duplicate_false_positives, r.duplicate_false_negatives, r.unnecessary_reviews) == (4, 2, 2, 1, 0, 1, 1)
    assert (r.exact_match_accuracy, r.duplicate_precision, r.duplicate_recall, r.weighted_error_cost) == (0.5, 1.0, 0.5, 6)
    assert [x.line for x in evaluation.errors(outcome).orderBy("ord").collect()] == ["C: esperado=POSSIBLE_DUPLICATE, previsto=['INVALID_UNIT']", "D: esperado=VALID, previsto=['MISSING_TECHNICAL_ATTRIBUTE']"]
    empty = evaluation.report(outcome.limit(0)).first()
    assert (empty.total, empty.exact_match_accuracy, empty.duplicate_recall, empty.weighted_error_cost) == (0, 0.0, 0.0, 0)


def test_recommendation_counts_info_as_reviewable(spark):
    rows = spark.createDataFrame([("a", ["INFO"]), ("b", []), ("c", ["INFO", "BLOCKING", "WARNING"])], "material_id string, s array<string>")
    e = F.transform("s", lambda s: F.struct(F.col("material_id"), F.lit("RULE").alias("source"), F.lit("INVALID_UNIT").alias("issue_type"), F.lit("o").alias("observation"), s.alias("severity")))
    got = {r.material_id: (r.decision, r.rationale) for r in decisions.recommend(rows.withColumn("evidence", e)).collect()}
    assert got["a"] == ("REVIEW", "Recomendação REVIEW: 1 evidência(s) requer(em) análise humana.")
    assert got["b"][0] == "APPROVE" and got["c"] == ("REJECT", "Recomendação REJECT: 1 evidência(s) impeditiva(s) e 2 evidência(s) revisável(is).")
    long = rows.withColumn("severity", F.explode("s"))
    assert {r.material_id: (r.decision, r.rationale) for r in decisions.recommend_long(rows, long).collect()} == got


def test_output_evidence_needs_equal_lengths(spark):
    rows = spark.createDataFrame([("a", ["INVALID_UNIT"], ["x", "y"])], "m string, i array<string>, e array<string>")
    with pytest.raises(PySparkException, match="same length"):
        rows.select(decisions.output_evidence(F.col("m"), F.col("i"), F.col("e"))).collect()


ITEM = {"material_id": "M", "source": "RULE", "issue_type": "INVALID_UNIT", "observation": "o", "severity": "WARNING"}


@pytest.mark.parametrize(("owner", "items", "wanted"), [
    ("M", [], None), ("M", [{}], None), ("", [], d.EMPTY_ID), ("", [{}], d.EMPTY_ID), ("M", [{"material_id": ""}], d.EMPTY_ID), ("M", [{"material_id": "N"}], "evidências de outro material"),
    ("M", [{"source": "x", "observation": ""}], "source inválido"), ("M", [{"issue_type": None, "observation": ""}], "issue_type inválido"), ("M", [{"observation": "", "severity": "x"}], "observation não pode ser vazia"),
    ("M", [{"severity": "x"}, {"source": "x"}], "severity inválida"), ("M", [{"material_id": "N"}, {"severity": None}], "severity inválida"), ("", [{"severity": "x"}], "severity inválida"),
])
def test_items_are_judged_one_by_one_before_their_collection(spark, owner, items, wanted):
    schema = "owner string, evidence array<struct<material_id:string,source:string,issue_type:string,observation:string,severity:string>>"
    row = spark.createDataFrame([(owner, [tuple((ITEM | x).values()) for x in items])], schema)
    assert row.select(decisions.evidence_violation(F.col("owner"), F.col("evidence"))).first()[0] == wanted


@pytest.mark.parametrize(("change", "wanted"), [
    ({}, None), ({"m": "", "d": "x"}, d.EMPTY_ID), ({"d": "x", "r": ""}, "decision inválida"), ({"d": None}, "decision inválida"), ({"r": "", "h": False}, "rationale vazio"), ({"h": False}, "falta a decisão humana"), ({"h": None}, "falta a decisão humana"),
])
def test_recommendation_invariants(spark, change, wanted):
    row = spark.createDataFrame([tuple(({"m": "M", "d": "REVIEW", "r": "r", "h": True} | change).values())], "m string, d string, r string, h boolean")
    assert row.select(decisions.recommendation_violation(*map(F.col, "mdrh"))).first()[0] == wanted


def test_flag_equals_candidates_and_makes_no_pairs(spark):
    rng = random.Random(9)
    pick = lambda *x: rng.choice(x)
    rows = [dict(material_id=f"M{rng.randrange(12)}", description_short=pick("", "TUBO", "10 POL", "POLEGADAS 10 20") + pick("", " 10 20", " 20 30", " 10 30"), manufacturer=pick("", "A"), manufacturer_part_number=pick("", "", "P"), material_group=pick("", "G")) for _ in range(70)]
    m = frame(spark, *rows)
    for existing in (None, frame(spark, *rows[:9])):
        whole, flag = decisions.assess(m, existing), decisions.assess(m, existing, candidates=False)
        assert flag.columns == [c for c in whole.columns if c != "duplicate_candidates"]
        got = {r.ord: r for r in flag.collect()}
        assert got == {r.ord: r for r in whole.drop("duplicate_candidates").collect()} and {r.issues[-1].issue_type == "POSSIBLE_DUPLICATE" if r.issues else False for r in got.values()} == {True, False}
    assert "collect_list" not in decisions.assess(m, candidates=False)._jdf.queryExecution().optimizedPlan().toString()


def test_copies_are_compared_as_one_class(spark):
    """60 copies of each of two texts: 7,140 pairs, four pairs of classes; no join is of a record with a record."""
    own = duplicates.duplicate_features(rules.with_features(frame(spark, *[dict(material_id=f"M{i}", description_short=("TUBO 10 20", "TUBO 10 20 30")[i % 2]) for i in range(120)])))
    assert duplicates._class_pairs(own, own, True, "PL").count() == 4
    assert duplicates.duplicate_pairs(own, own).count() == 120 * 119 // 2
