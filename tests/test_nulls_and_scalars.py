import math

import pytest
from pyspark.sql import functions as F

from levyscape.functions import codebook, nulls, scalars
from levyscape.functions.survey_codes import CAPTION_ORDER, INDICATORS, MODEL_SPECS, TERM_CAPTIONS


def test_strict_sum_is_null_as_soon_as_one_input_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    got = {
        r.k: (r.s, r.p, r.m)
        for r in df.groupBy("k")
        .agg(
            nulls.strict_sum("v").alias("s"),
            nulls.strict_sum("v", "skip").alias("p"),
            nulls.strict_mean("v").alias("m"),
        )
        .collect()
    }
    assert got == {"a": (None, 1.0, None), "b": (5.0, 5.0, 2.5)}


def test_ratio_follows_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (6.0, 3.0)], "a double, b double")
    got = [r.r for r in df.select(nulls.ratio("a", "b").alias("r")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3] is None and got[4] == 2.0


@pytest.mark.parametrize("how, rows", [("left", 3), ("inner", 2), ("full", 4), ("left_anti", 1), ("left_semi", 2)])
def test_natural_join_lets_missing_keys_meet(spark, how, rows):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, l string")
    b = spark.createDataFrame([(1, 10), (None, 20), (9, 30)], "k int, r int")
    out = nulls.natural_join(a, b, how).collect()
    assert len(out) == rows
    if how == "left":
        assert {(r.k, r.l, r.r) for r in out} == {(1, "x", 10), (None, "y", 20), (3, "z", None)}
    if how == "full":
        assert (9, None, 30) in {(r.k, r.l, r.r) for r in out}


def test_natural_join_of_a_table_with_its_own_aggregate(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "k int, v double")
    out = nulls.natural_join(df, df.groupBy("k").agg(F.sum("v").alias("t")), "left", ["k"])
    assert sorted((r.k, r.v, r.t) for r in out.collect()) == [(1, 2.0, 5.0), (1, 3.0, 5.0), (2, 4.0, 4.0)]


def test_if_else_keeps_unknown_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    got = [r.y for r in df.select(scalars.if_else(F.col("x") == 1, "a", "b").alias("y")).collect()]
    assert got == ["a", "b", None]


def test_stars_and_bounds(spark):
    df = spark.createDataFrame([(0.0005,), (0.001,), (0.01,), (0.05,), (0.2,), (None,)], "p double")
    assert [r.s for r in df.select(scalars.stars("p").alias("s")).collect()] == ["***", "***", "**", "*", "", None]
    low, high = scalars.confidence_bounds(F.lit(1.0), F.lit(2.0))
    r = df.select(low.alias("l"), high.alias("h")).first()
    assert r.l == pytest.approx(1 - 3.919927969) and r.h == pytest.approx(1 + 3.919927969)


def test_captions_and_their_order(spark):
    df = spark.createDataFrame([("provinceGauteng",), ("cookingsourceGas",), ("log_expenditures_hh",), ("x",)], "t string")
    out = df.withColumn("c", scalars.replace_all("t", TERM_CAPTIONS)).withColumn(
        "o", scalars.prefix_rank("c", CAPTION_ORDER)
    )
    assert [(r.c, r.o) for r in out.collect()] == [
        ("Province: Gauteng", 2),
        ("Cooking Fuel: Gas", 11),
        ("Expenditures (log)", 1),
        ("x", 14),
    ]


def test_recode_with_and_without_default(spark):
    df = spark.createDataFrame([(1,), (7,), (None,)], "c int")
    plain = codebook.CategorySpec("c", {1: "one"}, ("one", "Other"))
    other = codebook.CategorySpec("c", {1: "one"}, ("one", "Other"), "Other")
    assert [r.c for r in codebook.recode(df, [plain]).collect()] == ["one", None, None]
    out = codebook.recode(df, [other], ordinals=True).collect()
    assert [(r.c, r.c_ord) for r in out] == [("one", 1), ("Other", 2), (None, None)]


def test_label_outside_levels_is_null(spark):
    df = spark.createDataFrame([(1,), (2,)], "c int")
    spec = codebook.CategorySpec("c", {1: "one", 2: "two"}, ("one",))
    assert [r.c for r in codebook.recode(df, [spec]).collect()] == ["one", None]


def test_indicator_names_and_levels():
    assert len(INDICATORS) == 77
    for spec in MODEL_SPECS:
        assert set(spec.labels.values()) <= set(spec.levels)


def test_one_hot_marks_missing(spark):
    df = spark.createDataFrame([(1, 3), (2, None)], "id int, c int")
    out = codebook.one_hot(df, {"c_three": ("c", [3, 4])}, ["id"]).collect()
    assert [(r.id, r.c_three) for r in out] == [(1, 1.0), (2, None)]
