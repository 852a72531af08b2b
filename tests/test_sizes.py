"""What queries leave on disk and shuffle, on few rows: the text that they carry, not the time."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans import bindings, catalogue
from tessera.sources import files
from tessera.sources.logstore import AUDIT, LIFECYCLE, AuditStore, LifecycleStore, Version

SF = "/root/testdata/sf0.001"


def test_broken_log_is_sorted_before_it_is_spelt_out_and_packed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalogue, "new_path", lambda spark, name: str(tmp_path / name))
    got = catalogue.log_read_failclosed(spark, SF).first()
    text = spark.read.text(str(tmp_path / "broken" / f"{catalogue.files.BATCH}0"))
    plain = text.agg(F.sum(F.length("value") + 1)).first()[0]
    on_disk = sum(p.stat().st_size for p in (tmp_path / "broken").rglob("part-*"))
    assert got.line_no > 0 and on_disk * 5 < plain
    want = [r.raw for r in catalogue._broken_lines(catalogue.lifecycle(spark, SF)).orderBy("seq").collect()]
    assert [r.value for r in text.orderBy("_metadata.file_path", F.monotonically_increasing_id()).collect()] == want


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lifecycle_is_its_sql_in_one_shuffle(spark, tmp_path):
    """Also where an order's key comes twice, a line item has no order, or there is no key."""
    orders, lines = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("orders", "lineitem"))
    lines = lines.where("l_orderkey <= 300")
    odd = lines.limit(40).withColumn("l_orderkey", F.when(F.col("l_linenumber") > 2, F.lit(10**9)).cast(lines.schema["l_orderkey"].dataType))
    orders.where("o_orderkey <= 300").unionByName(orders.where("o_orderkey in (7, 9, 20)").withColumn("o_custkey", F.col("o_custkey") + 1)).write.parquet(f"{tmp_path}/orders.parquet")
    lines.unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = bindings.lifecycle(spark, str(tmp_path))
    want = spark.sql(bindings.LIFECYCLE, **{x: spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("orders", "lineitem")})
    # Copies of an order tie, so places among them are open: rows are compared without.
    ties = lambda rows: rows.withColumn("seq", (F.col("seq") / 1000).cast("long"))
    assert got.schema == want.schema and got.count() == want.count() > 500
    assert ties(got).exceptAll(ties(want)).isEmpty() and ties(want).exceptAll(ties(got)).isEmpty() and got.select("seq").exceptAll(want.select("seq")).isEmpty()
    plain = got.where("not workflow_id in ('WF-7', 'WF-9', 'WF-20')")
    assert plain.exceptAll(want).isEmpty()
    assert _plan(got).count("Exchange") == 1


def test_rejected_events_leave_their_outcome_only(spark, tmp_path):
    store = LifecycleStore(spark, str(tmp_path / "log"))
    rows = [(1, "a", "w", "OPENED", "m", "REVIEW", None), (2, "b", "w", "OPENED", "m", "REVIEW", None), (3, " ", "w", "OPENED", "m", "REVIEW", None)]
    store.append(spark.createDataFrame(rows, LIFECYCLE.rsplit(",", 1)[0]).withColumn("event_at", F.lit("2024-01-01").cast("timestamp")))
    kept = spark.read.parquet(str(tmp_path / "log" / "outcomes")).orderBy("seq").collect()
    assert [(r.seq, r.outcome, r.workflow_id, r.material_id) for r in kept] == [(1, "ok", "w", "m"), (2, "already_opened", None, None), (3, "invalid", None, None)]


def test_stored_events_are_not_copied(spark, monkeypatch, tmp_path):
    from tessera.sources import logstore

    monkeypatch.setattr(logstore, "materialise", lambda *a, **k: pytest.fail("a copy"))
    store = LifecycleStore(spark, str(tmp_path / "log"))
    first = catalogue._parts(bindings.lifecycle(spark, SF).limit(50))[0]
    assert store.append(first, stored=True).count() == first.count() > 0


def test_audit_events_stay_where_they_are_while_ids_are_judged(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(i, f"e{i % 5}", "t", "m", "a", f"r{i}", None) for i in range(8)], AUDIT)
    judged = store._judge(Version(buckets=4), rows)
    assert "hashpartitioning" not in _plan(judged)
    assert sorted((r.seq, r.outcome) for r in judged.collect()) == [(i, "ok" if i < 5 else "dup") for i in range(8)]


def test_lines_are_packed_and_their_store_holds_what_it_judges_by(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_lifecycle_lines(spark, path, catalogue._lifecycle_lines(bindings.lifecycle(spark, SF).where("seq < 200000")))
    assert all(p.name.endswith(".gz") for p in Path(path).glob("batch-*/part-*")) and list(Path(path).glob("batch-*/part-*"))
    assert set(LifecycleStore(spark, files._index(path)).events().columns) == {x.split()[0] for x in LIFECYCLE.split(", ")}
    assert files.read_lifecycle_log(spark, path).where("evidence is not null and rationale = 'r'").count() > 0


def test_strip_searches_no_pattern():
    assert "regexp" not in str(text.strip(F.col("a"))) and "regexp" not in str(text.is_blank(F.col("a")))


def test_a_time_is_spelt_once():
    said = str(text.offset_time(F.col("a")))
    assert said.count("RLIKE") + said.lower().count("rlike(") <= 2, said


def _by_variant(raw: str) -> str:
    """The same record with a space more, which no writer here puts."""
    return raw.replace(":", ": ", 1)


def test_records_as_they_are_written_need_no_variant(spark, monkeypatch):
    """And what is said of them is what the variant tells of the same record spelt otherwise."""
    from tessera.operators import records

    life = catalogue._broken_lines(bindings.lifecycle(spark, SF).where("seq < 300000")).collect()
    good = catalogue._lifecycle_lines(bindings.lifecycle(spark, SF).where("seq < 300000")).collect()
    audit = catalogue._audit_lines(spark, SF).limit(300).collect()
    odd = lambda raw: [raw.replace('"event_id":"', '"event_id":null,"x":"'), raw.replace('"evidence":[{', '"evidence":[null,{'), raw.replace('"schema_version":1', '"schema_version":2'), raw.replace("human_decision\":true", "human_decision\":false"), raw.replace("2", "x", 1)]
    for rows, read in ((life, records.lifecycle_records), (audit, records.audit_records)):
        lines = [(10 * r.seq + i, raw) for r in rows for i, raw in enumerate([r.raw, *odd(r.raw)])]
        told = {}
        for name, own in (("as written", lines), ("otherwise", [(n, _by_variant(raw)) for n, raw in lines])):
            found = read(spark.createDataFrame(own, "seq long, raw string")).select("seq", "violation", F.to_json("event").alias("event"), F.col("event.event_id").alias("id")).collect()
            told[name] = {r.seq: (r.violation, None if r.event is None else r.event.split('"raw":')[0]) for r in found}
        assert told["as written"] == told["otherwise"] and len({v for v, _ in told["otherwise"].values()}) > 3
    monkeypatch.setattr(records, "parsed", lambda raw: F.raise_error(F.concat(F.lit("a variant of "), raw)).cast("variant"))
    for rows, read in ((good, records.lifecycle_records), (audit, records.audit_records)):
        lines = spark.createDataFrame([(r.seq, r.raw) for r in rows], "seq long, raw string")
        assert read(lines).where("violation is null and event.event_at is not null" if read is records.lifecycle_records else "violation is null").count() == len(rows) > 100
