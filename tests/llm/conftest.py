import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, junk, a long text, nulls, repeated rows and repeated ids."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 20, 60, 120, 200])) for _ in range(60)]
    passage = prose(rng, 70)
    for i in range(12):
        texts.append(prose(rng, 30) + " " + passage + "\n" + prose(rng, rng.randrange(40)))
    texts += [texts[3], texts[3].upper(), texts[4], "", "  \n\t", None, "w1", "w1 w2 w3 w4", prose(rng, 6000)]
    for i in range(6):
        near = texts[10 + i].split() or ["x"]
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += ["w5 " * 300, "w5 " * 260]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (7, texts[8], None, None, None), (None, texts[9], "en", "s0", 1), (None, passage, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


CLASHING = "fp held_out score size target taken tid words token n bucket kept component_id root h source_size digest id table".split()


def clash(df):
    """The same rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHING if c not in df.columns})
