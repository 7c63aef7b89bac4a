"""The ways taken when nothing may be broadcast, and under a hot key, give the same rows."""

import pytest
from pyspark.sql import functions as F

from levyscape.functions.survey_codes import INDICATOR_WORDS, INDICATORS
from levyscape.operators import quality, ranking
from levyscape.operators import weighted as w
from levyscape.sources import staging
from workload.bindings import SQL, Tables
from workload.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "final_mart",
    "winsorise_items",
    "weighted_quantile_grouped",
    "weighted_quantile_many_groups",
    "equal_count_buckets_ties",
    "dq_dup_baskets",
    "share_of_group_total",
    "household_frame",
    "energy_mix_cooking_province_a",
]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def usual(spark):
    return {n: sorted(QUERIES[n](spark, SF).collect(), key=str) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_without_broadcast(spark, usual, no_broadcast, name):
    df = QUERIES[name](spark, SF)
    assert sorted(df.collect(), key=str) == usual[name]
    if name != "final_mart":  # its bins come from an ungrouped quantile: two rows per probability
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_staged_rows_have_no_lineage(spark):
    staged = staging.stage(spark.range(5).selectExpr("id", "id * 2 AS b"))
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()
    assert "ReadSchema: struct<b:bigint>" in staged.select("b")._jdf.queryExecution().executedPlan().toString()
    assert staged.count() == 5


def test_no_cell_holds_a_large_part_of_a_hot_group(spark):
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.when(F.col("id") % 4 == 0, 7.5).otherwise(F.rand(3) * 100).alias("x"),
        F.col("id"),
    )
    bounds = ranking.cell_bounds(hot, {"x": 4096}, rows_per_cell=100)["x"]
    placed = ranking.with_cell(hot, "x", bounds, "c")
    sizes = placed.groupBy("g", "c").agg(F.countDistinct("x").alias("n")).agg(F.max("n")).first()[0]
    assert sizes < 400  # of about 6,700 rows in the hot group
    stats = w.weighted_stats(hot, "x", None, [0.5], ["m"], ["g"], rows_per_cell=100)
    want = hot.groupBy("g").agg(F.expr("percentile(x, 0.5)").alias("m"))
    assert {r.g: r.m for r in stats.collect()} == pytest.approx({r.g: r.m for r in want.collect()})


def test_colliding_hashes_still_compare_whole_baskets(spark, monkeypatch):
    """With a useless hash every basket of equal length collides; the result stays exact."""
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(1).cast("bigint"))
    rows = [(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0), (4, "c", 1.0), (5, "b", 1.0), (6, "d", 9.0)]
    df = spark.createDataFrame(rows, "hh_id bigint, item_code string, v double")
    got = {r.hh_id: r.number for r in quality.duplicate_baskets(df, "hh_id", "item_code", "v").collect()}
    assert got == {1: 2, 2: 2, 3: 2, 5: 2}


def test_every_indicator_has_a_caption(spark):
    from levyscape.functions.scalars import replace_all
    from levyscape.functions.survey_codes import INDICATOR_PREFIXES

    words = [(f"_{word}$", f"_{text}") for word, text in INDICATOR_WORDS.items()]
    df = spark.createDataFrame([(n,) for n in INDICATORS], "n string")
    got = {r.n: r.c for r in df.select("n", replace_all("n", [*words, *INDICATOR_PREFIXES]).alias("c")).collect()}
    assert got["cooking_gas"] == "Cooking Fuel: Gas" and got["elec_noaccess"] == "Electricity Source: No Access"
    assert got["edu_primary"] == "Education: Primary" and got["heat_w_elecmains"] == "Heating Water: Electricity Mains"
    assert got["urb_urban_formal"] == "Res. Area: Urban Formal" and got["gender_female"] == "Gender: Female"
    assert all(": " in c for c in got.values())


@pytest.fixture
def small_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "48k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(df):
    """How often the plan, before it adapts, moves rows for a join."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_outlier_bounds_come_to_the_lines(spark, small_broadcast):
    """Few groups, many rows: the bounds travel, the rows stay."""
    lines = staging.stage(spark.range(40_000).select((F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 10007).cast("double").alias("x"), F.lit(1.0).alias("w")))
    assert moved(w.replace_outliers(lines, "x", "w", ["g"])) == 0
    assert moved(w.flag_outliers(lines, "x", "w", ["g"])) == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_offsets_of_ranges_come_to_the_rows(spark, small_broadcast, by):
    rows = spark.range(40_000).select((F.col("id") % 5).alias("g"), F.col("id"), (F.col("id") * 7919 % 10007).alias("x"))
    got = ranking.ranked(rows, "x", "id", by)
    assert moved(got) == 0
    assert got.count() == 40_000 and got.agg(F.max("rn")).first()[0] == (8_000 if by else 40_000)


def test_items_are_the_rows_of_their_sql(spark):
    """Lines carry their amount through the joins, not what it is made of."""
    t = Tables(spark, SF)
    plain = spark.sql(SQL["items"], lineitem=t.lineitem, orders=t.orders, part=t.part)
    assert t.items.columns == plain.columns and t.items.count() == plain.count()
    assert t.items.exceptAll(plain).count() == 0
    plan = t.items._jdf.queryExecution().optimizedPlan().toString()
    assert "Project [l_orderkey#" in plan and not any("l_extendedprice" in x and "expenditures_year" not in x for x in plan.splitlines() if "Project" in x)


def test_ranked_tables_hold_only_what_is_asked_for(spark, monkeypatch):
    """What the ranking of the mart writes: keys, flags and model columns."""
    widths, plain = [], ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df: widths.append(len(df.columns)) or plain(df))
    for name, most in (("top_decile_flag", 4), ("logit_side_by_side", 24), ("transfer_full", 14)):
        widths.clear()
        QUERIES[name](spark, SF)
        assert widths and max(widths) <= most, (name, widths)
