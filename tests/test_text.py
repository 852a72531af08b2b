import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.domain import FIELDS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("Válvula, esfera!", "VALVULA ESFERA"), ("", ""), ("--", ""), ("straße", "STRASSE"), ("m²", "M2"), ("a\u0301b", "AB"), (" x\ty ", "X Y")])
def test_normalize(spark, given, wanted):
    assert one(spark, t.normalize(F.col("a")), a=given) == wanted


def test_normalize_equals_nfkd_for_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    wanted = []
    for c in codes:
        plain = "".join(x for x in unicodedata.normalize("NFKD", f"a{chr(c)}b") if not unicodedata.combining(x)).upper()
        wanted.append(" ".join(re.sub("[^A-Z0-9]+", " ", plain).split()))
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"a": [f"a{chr(c)}b" for c in codes], "w": wanted}))
    assert [(hex(ord(r.a[1])), r.n) for r in rows.withColumn("n", t.normalize(F.col("a"))).where("n <> w").limit(20).collect()] == []
    assert one(spark, t.normalize(F.col("a")), a="ﬁn ½ ＡＢ № ⑩ ½ Ⅳ") == "FIN 1 2 AB NO 10 1 2 IV"


def test_fast_fold_equals_python_on_latin(spark):
    chars = [chr(c) for c in range(0xC0, 0x250) if unicodedata.category(chr(c))[0] == "L"]
    plain = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in chars]
    rows = spark.createDataFrame([(c, p) for c, p in zip(chars, plain) if len(p) == 1], "a string, p string")
    assert rows.where(t.fold(F.col("a")) != F.col("p")).count() == 0


@pytest.mark.parametrize(("given", "words", "numbers", "category"), [
    ("VALV ESF 2IN", {"VALVULA", "ESFERA", "2IN"}, {"2"}, "VALVULA"), ("M10X30 CL8.8", {"M10X30", "CL8"}, {"10", "30", "8"}, "M10X30"),
    ("PARAF. SEXTAVADA 2 POLEGADAS", {"PARAFUSO", "SEXTAVADO", "POLEGADA"}, {"2"}, "PARAFUSO"), ("de 10", set(), {"10"}, ""), ("POLEGADAS 08 8", {"POLEGADA"}, {"08", "8"}, "POLEGADAS"),
])
def test_tokens(spark, given, words, numbers, category):
    n = t.normalize(F.col("a"))
    assert set(one(spark, t.word_tokens(n), a=given)) == words
    assert set(one(spark, t.numeric_tokens(n), a=given)) == numbers
    assert one(spark, t.category_token(n), a=given) == category


@pytest.mark.parametrize("blank", ["", " ", "\t\n", "\u00a0", "\x1c", "\u2003"])
def test_strip_is_pythons(spark, blank):
    assert blank.strip() == ""
    assert one(spark, t.strip(F.col("a")), a=f"{blank}x y{blank}") == "x y"
    assert one(spark, t.is_blank(F.col("a")), a=blank) is True


def test_completeness(spark):
    assert one(spark, t.completeness(["material_id", "description_short", "unit", "status"]), material_id="a", description_short=" ", unit="u", status="s") == 0.75
    assert one(spark, t.completeness(["unit"], ("unit", "nothing")), unit="u") == 0.5
    with pytest.raises(ValueError):
        t.completeness(["unit"], ())


def test_prompt_keeps_empty_values(spark):
    said = one(spark, t.prompt(), **{f: "" for f in FIELDS} | {"unit": "PC"})
    lines = said.split("\n")
    assert len(lines) == 14 and lines[4] == "" and lines[5] == "Material:" and "unit: PC" in lines and lines[-1] == "status: "


@pytest.mark.parametrize(("raw", "fine"), [("2026-01-02T03:04:05Z", True), ("2026-01-02T03:04:05.123456+02:00", True), ("2026-01-02T03:04:05", False), ("yesterday", False), ("yesterdayZ", False), ("20260102T030405+00:00", True), ("20260102T0304Z", True), ("2026-1-2T3:4:5Z", False), ("2026-01-02 03:04+0200", True), ("2026-01-02T03:04:05,5Z", True), ("2026-13-02T03:04:05Z", False), ("20260132T030405Z", False)])
def test_offset_time(spark, raw, fine):
    assert (one(spark, t.offset_time(F.col("a")), a=raw) is not None) == fine
