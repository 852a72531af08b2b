import random
from collections import Counter

import corpus_pipeline as cp
import pyarrow as pa
import pytest

from .conftest import DOCS, clash, prose
from .test_simhash import classes, shingles
from .test_texts import brute_leaks, removed


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = [r for r in corpus]
    for i in range(300, 420):
        text = prose(rng, 80)
        if i % 4 == 0:
            text += " filth vermin scoundrel"
        elif i % 9 == 0:
            text += " " + items[i % 5][1] + " " + prose(rng, 10)
        rows.append((i, text, "en", "s1", len(text)))
    clash(spark.createDataFrame(rows, DOCS)).write.parquet(str(at / "documents.parquet"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300, 420)] + [(i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return rows, items, str(at)


def key(rows):
    return sorted(((d, t) for d, t in rows), key=str)


def test_stages(spark, tables):
    rows, items, at = tables
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = cp.materialise(stage(spark, docs, at), "stage")
        assert docs.columns[:5] == cp.COLUMNS
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    toxic, near, cut, clean, mixed = seen

    assert key(toxic) == key((d, t) for d, t, *_ in rows if "vermin" not in (t or ""))

    sets = [set(shingles(t, 5)) for _, t in toxic]
    top = classes(len(sets), lambda i, j: (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)
    groups = {}
    for c, (d, t) in zip(top, toxic):
        groups.setdefault(c, []).append((d, t))
    firsts = Counter(d for d, _ in near if d is not None)
    assert len(near) == len(groups) and firsts == Counter(min((d for d, _ in g if d is not None), default=None) for g in groups.values() if any(d is not None for d, _ in g))

    want = [(d, t if not gone else kept) for (d, t), (_, n, gone, kept) in zip(near, removed(near, 50)) if not gone or gone < n]
    assert key(cut) == key(want) and any(gone for _, _, gone, _ in removed(near, 50))

    leaks = brute_leaks([(i, t) for i, (_, t) in enumerate(cut)], items)
    bad = {i for i, _ in leaks}
    assert key(clean) == key(x for i, x in enumerate(cut) if i not in bad) and bad

    last = docs.collect()
    assert {(r.doc_id, r.text) for r in last} <= set(clean) and all(1 <= r.copies <= 3 and r.taken == r.copies * r.size for r in last)
    for s, target in {(r.source, r.target) for r in last}:
        assert abs(sum(r.taken for r in last if r.source == s) - target) <= 3 * max(len((t or "").split()) for _, t in clean)


def test_run_equals_the_stages_and_reruns_agree(spark, tables):
    _, _, at = tables
    once, again = (sorted(map(str, cp.run(spark, at).collect())) for _ in range(2))
    assert once == again and once


def test_empty_documents(spark, tables, tmp_path):
    _, _, at = tables
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_get_their_texts_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stage = cp._in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
    rows = stage(spark, spark.range(0, 2000, 1, 1), "").collect()
    assert sum(r.n for r in rows) == 2000 and max(r.n for r in rows) <= cp.ARROW_ROWS
    assert all(hasattr(stage, "__wrapped__") for _, stage in cp.STAGES)
