import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, storage
from tessera.operators import decisions, evaluation, log
from tessera.sources import files
from tests.test_contracts import AUDIT, CONCLUDED, OPENED, changed

LINES = "seq long, raw string"


def lines(spark, *found):
    return spark.createDataFrame([(i, json.dumps(x, sort_keys=True)) for i, x in enumerate(found, 1)], LINES)


def test_audit_lines_are_appended_and_read_back(spark, tmp_path):
    path = str(tmp_path / "audit")
    a, b = AUDIT, changed(AUDIT, "event_id", "other")
    assert {r.seq: r.outcome for r in files.append_audit_lines(spark, path, lines(spark, a, b, a)).collect()} == {1: "ok", 2: "ok", 3: "dup"}
    assert [r.outcome for r in files.append_audit_lines(spark, path, lines(spark, b)).collect()] == ["dup"]
    assert [r.outcome for r in files.append_audit_lines(spark, path, lines(spark, changed(AUDIT, "event_id", "third"))).collect()] == ["ok"]
    assert [(r.seq, r.event_id) for r in files.read_audit_log(spark, path).orderBy("seq").collect()] == [(1, AUDIT["event_id"]), (2, "other"), (3, "third")]
    with pytest.raises(ValueError, match="event_id is blank"):
        files.append_audit_lines(spark, path, lines(spark, changed(AUDIT, "event_id", " ")))
    assert files.read_audit_log(spark, path).count() == 3


def test_lifecycle_lines_are_admitted(spark, tmp_path):
    path = str(tmp_path / "log")
    assert [r.outcome for r in files.append_lifecycle_lines(spark, path, lines(spark, CONCLUDED)).collect()] == ["not_opened"]
    assert {r.seq: r.outcome for r in files.append_lifecycle_lines(spark, path, lines(spark, OPENED, OPENED)).collect()} == {1: "ok", 2: "dup"}
    assert [(r.seq, r.kind) for r in files.read_lifecycle_log(spark, path).orderBy("seq").collect()] == [(1, "OPENED")]


def test_a_log_without_its_store_is_adopted(spark, tmp_path):
    """Batches that were written before there was a store, and one of a writer that never committed."""
    path = tmp_path / "log"
    for i, e in enumerate((OPENED, CONCLUDED)):
        (path / f"batch-{i:08d}").mkdir(parents=True)
        (path / f"batch-{i:08d}" / "part-0.txt").write_text(json.dumps(e) + "\n")
    (path / "_index").mkdir()
    assert files.read_lifecycle_log(spark, str(path)).count() == 2
    more = changed(changed(OPENED, "event_id", "n"), "workflow_id", "v")
    assert {r.seq: r.outcome for r in files.append_lifecycle_lines(spark, str(path), lines(spark, OPENED, more)).collect()} == {1: "dup", 2: "ok"}
    (path / "batch-00000009").mkdir()
    (path / "batch-00000009" / "part-0.txt").write_text("never committed\n")
    assert [(r.seq, r.event_id) for r in files.read_lifecycle_log(spark, str(path)).orderBy("seq").collect()] == [(1, "e1"), (2, "e2"), (3, "n")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    at = tmp_path / "log.jsonl"
    at.write_text("".join(json.dumps(changed(AUDIT, "event_id", f"e{i}")) + "\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = files.read_audit_log(spark, str(at)).orderBy("seq").collect()
        assert files._numbered(spark, str(at)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.seq, r.event_id) for r in got] == [(i + 1, f"e{i}") for i in range(500)]


def test_a_folder_of_any_files_is_no_log(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.jsonl").write_text(json.dumps(AUDIT) + "\n")
    with pytest.raises(files.LogError, match="several files"):
        files.read_audit_log(spark, str(tmp_path))


def test_lookups(spark):
    rows = [(1, "o", "w", "OPENED", "M"), (2, "c", "w", "CONCLUDED", "M")]
    stored = spark.createDataFrame(rows, "seq long, event_id string, workflow_id string, kind string, material_id string")
    assert log.by_event(stored, "c").count() == 1 and log.opened_by_event(stored, "c").count() == 0 and log.opened_by_event(stored, "o").count() == 1
    assert log.by_workflow(stored, "w").count() == 2 and log.opened_by_workflow(stored, "w").first().seq == 1
    assert log.by_material(stored, "M").count() == 2 and log.opened_by_material(stored, "M").count() == 1 and log.opened(stored).count() == 1
    for lookup in (log.by_event, log.by_material, log.by_workflow, log.opened_by_event, log.opened_by_workflow, log.opened_by_material):
        with pytest.raises(ValueError, match="must be a string, got int"):
            lookup(stored, 7)


def test_labels_must_be_one_to_one(spark):
    materials = spark.createDataFrame([(i, f"M{i}", "VALVULA 2 POL", "", "PC", "", "", "", "ACTIVE") for i in range(2)], "ord long, material_id string, description_short string, long_description string, unit string, manufacturer string, manufacturer_part_number string, material_group string, status string")
    labels = spark.createDataFrame([(0, "VALID"), (5, "VALID")], "ord long, expected_issue string")
    for known in (labels, labels.where("ord = 0"), labels.union(labels.limit(0))):
        with pytest.raises(Exception, match="not one to one"):
            evaluation.report(evaluation.with_outcome(decisions.assess(materials), known)).collect()


def test_report_of_a_file(spark, tmp_path, capsys):
    at = tmp_path / "m.csv"
    at.write_text("material_id,description_short,unit,status,expected_issue\nM-1,TUBO 2,PC,ACTIVE,VALID\nM-2,TUBO 2,CX,ACTIVE,VALID\n", encoding="utf-8")
    cli.main([str(at)])
    out = capsys.readouterr().out.split("\n")
    assert out[0].startswith("material_id | decisão") and out[1] == "-" * 78 and out[2] == "M-1         | APPROVE |       1.00 |      0.95 | VALID"
    assert out[3].startswith("M-2         | REJECT  |") and out[3].endswith("| INVALID_UNIT") and "- Registros: 2" in out and "- Correspondência exata: 50.0%" in out
    assert out[-4:] == ["- Decisões: {'APPROVE': 1, 'REJECT': 1}", "- Erros:", "  - M-2: esperado=VALID, previsto=['INVALID_UNIT']", ""]


def test_shared_dir_is_that_of_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    table = storage.materialise(spark.range(3).withColumn("x", F.lit(1)), "t")
    assert table.count() == 3 and table._tessera_path.startswith(storage.shared_dir(spark))
    storage.discard(table)
