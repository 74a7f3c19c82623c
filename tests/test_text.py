from pyspark.sql import functions as F

from tessera.functions.text import base_id, padded_id, py_capitalize, py_str, py_strip
from tessera.operators.assets import asset_candidates
from tessera.operators.captions import caption_expr


def test_padded_ids(spark):
    df = spark.createDataFrame([("7",), ("25_1",), ("1234",), ("abc",), (None,)], "nn string")
    out = df.select(padded_id(base_id("nn"), strict=True).alias("p")).collect()
    assert [r.p for r in out] == ["007", "025", "1234", None, None]


def test_zfill_keeps_sign_and_long_ids(spark):
    df = spark.createDataFrame([("7",), ("-5",), ("1234",), ("ab",)], "x string")
    out = [r.p for r in df.select(padded_id("x", strict=False).alias("p")).collect()]
    assert out == ["7".zfill(3), "-5".zfill(3), "1234".zfill(3), "ab".zfill(3)]


def test_capitalize_is_python_capitalize(spark):
    df = spark.createDataFrame([("fire FLYING",), ("GRASS",), (None,)], "t string")
    out = [r.c for r in df.select(py_capitalize(py_str("t")).alias("c")).collect()]
    assert out == ["Fire flying", "Grass", "Nan"]


def test_strip_matches_python(spark):
    samples = ["\tab ", "\x1cx\x1f", " y　", "  z\n", "  w  ", "keep inner  space"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    out = [r.s for r in df.select(py_strip("t").alias("s")).collect()]
    assert out == [s.strip() for s in samples]


def test_candidates_priority(spark):
    df = spark.createDataFrame([("7",), ("25_1",), ("abc",)], "national_number string")
    rows = {r.national_number: (r.candidate1, r.candidate2) for r in asset_candidates(df).collect()}
    assert rows["7"] == ("007.png", "7.png")
    assert rows["25_1"] == ("25_1.png", "25.png")
    assert rows["abc"] == (None, None)


def test_caption_template(spark):
    df = spark.createDataFrame(
        [(" A cat.\t", "fire", "FLYING", "small"), ("b", None, None, None), ("c", "GRASS", "", "x")],
        "description string, primary_type string, secondary_type string, classification string")
    out = [r.c for r in df.select(caption_expr("item").alias("c")).collect()]
    assert out[0] == "A cat. This item is classified as a small. It is of Fire type and Flying type"
    assert out[1] == "b This item is classified as a nan. It is of Nan type"
    # an empty second type is falsy in the reference: no clause
    assert out[2] == "c This item is classified as a x. It is of Grass type"
