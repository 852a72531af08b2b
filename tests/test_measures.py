import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import measures

A = "material_id string, assessed_at timestamp, decision string, group string"
R = "material_id string, reviewed_at timestamp, human_decision string"


def test_as_of_equals_a_search(spark):
    """Times over many spans, equal times, a hot material, materials without assessments, nulls."""
    rng = random.Random(2)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.choice([rng.randrange(400), 7, 8]), hours=rng.choice([0, 0, 5]))
    material = lambda: rng.choice(["hot", "hot", "a", "b", "c"])
    assessed = [(material(), day(), rng.choice(["APPROVE", "REVIEW", "REJECT"]), rng.choice("xyz")) for _ in range(120)] + [(None, day(), "APPROVE", "x"), ("a", None, "APPROVE", "x")]
    reviewed = [(rng.choice(["hot", "a", "b", "c", "none"]), day(), rng.choice(["APPROVE", "REJECT"])) for _ in range(200)] + [(None, day(), "APPROVE"), ("a", None, "REJECT")]
    got = measures.as_of(spark.createDataFrame(assessed, A), spark.createDataFrame(reviewed, R)).collect()
    want = []
    for m, at, human in reviewed:
        if m is not None and at is not None:
            before = [(t, d, g) for x, t, d, g in assessed if x == m and t is not None and t <= at]
            want.append((m, at, human, *(max(before) if before else (None, None, None))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_measures(spark):
    rows = [("x", "APPROVE", "APPROVE"), ("x", "APPROVE", "REJECT"), ("x", "REVIEW", "REQUEST_CORRECTION"), ("y", "REJECT", "APPROVE"), ("y", "REJECT", "REJECT"), ("y", "REJECT", "REJECT"), (None, "REVIEW", "APPROVE"), ("y", None, "APPROVE")]
    out = {(r.of, r.group, r.decision): r for r in measures.specialist_measures(spark.createDataFrame(rows, "group string, decision string, human_decision string")).collect()}
    all_ = out["all", None, None]
    assert (all_.reviewed, all_.agreed, all_.to_review, all_.false_accepts, all_.false_rejects) == (7, 4, 2, 1, 1)
    assert (all_.accuracy, all_.review_rate, all_.false_accept_rate, all_.false_reject_rate) == (4 / 7, 2 / 7, 1 / 2, 1 / 3)
    assert out["group", "x", None].accuracy == 2 / 3 and out["group", None, None].reviewed == 1 and out["decision", None, "REVIEW"].reviewed == 2
    assert out["group and decision", "x", "REVIEW"].false_accept_rate == 0 and ("group and decision", "y", None) not in out
    none = measures.specialist_measures(spark.createDataFrame([], "group string, decision string, human_decision string")).collect()
    assert none == []


def test_nothing_assessed(spark):
    out = measures.as_of(spark.createDataFrame([], A), spark.createDataFrame([("a", dt.datetime(2020, 1, 1), "APPROVE")], R))
    assert [tuple(r)[3:] for r in out.collect()] == [(None, None, None)] and measures.as_of(spark.createDataFrame([], A), spark.createDataFrame([], R)).where(F.lit(True)).count() == 0
