import pytest
from pyspark.sql import functions as F

from levyscape.plans import carbon, energy, households, mart, recycling, spending
from workload.bindings import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def the_mart(t):
    return t.mart


def test_other_stays_in_the_denominator_and_other_only_households_drop_out(spark):
    exp = spark.createDataFrame(
        [(1, "i1", 60.0), (1, "i2", 40.0), (2, "i2", 10.0), (3, "i3", 5.0)],
        "hh_id bigint, item_code string, expenditures double",
    )
    sectors = spark.createDataFrame([("i1", "s1"), ("i2", "other"), ("i3", "deleted")], "item_code string, GTAP string")
    fx = spark.createDataFrame([("X", "0.5")], "Country string, exchange_rate string")
    intensity = spark.createDataFrame(
        [("s1", 0.01, 0.02, 0.03, 0.04)],
        "GTAP string, " + ", ".join(f"CO2_t_per_dollar_{c} double" for c in carbon.CARRIERS),
    )
    usd = spending.to_reference_currency(spending.sector_spending(exp, sectors), fx, "X")
    out = carbon.incidence(carbon.carbon_footprint(usd, intensity), 30.0).collect()
    assert [r.hh_id for r in out] == [1]
    assert out[0].hh_expenditures_USD_2014 == pytest.approx(50.0)
    assert out[0].CO2_t_national == pytest.approx(30 * 0.02)
    assert out[0].burden_CO2_national == pytest.approx(30 * 0.02 * 30 / 50)


def test_a_sector_without_intensity_makes_tonnes_unknown(spark):
    usd = spark.createDataFrame(
        [(1, "s1", 10.0, 30.0), (1, "s9", 20.0, 30.0), (2, "s1", 10.0, 10.0)],
        "hh_id bigint, GTAP string, expenditures_USD_2014 double, hh_expenditures_USD_2014 double",
    )
    intensity = spark.createDataFrame(
        [("s1", 0.1, 0.1, 0.1, 0.1)],
        "GTAP string, " + ", ".join(f"CO2_t_per_dollar_{c} double" for c in carbon.CARRIERS),
    )
    got = {r.hh_id: r.CO2_t_global for r in carbon.carbon_footprint(usd, intensity).collect()}
    assert got == {1: None, 2: pytest.approx(1.0)}


def test_gas_sectors_merge_before_the_ratio(spark):
    sectors = spark.createDataFrame([(1, "gas", ""), (2, "gdt", ""), (3, "ely", "")], "Number int, GTAP string, Explanation string")
    emissions = spark.createDataFrame(
        [(1, 2.0, 1.0, 0.0, 0.0, 10.0), (2, 4.0, 1.0, 0.0, 0.0, 20.0), (3, 5.0, 1.0, 0.0, 0.0, 0.0)],
        "GTAP int, CO2_Mt double, CO2_Mt_within double, CO2_Mt_Electricity double, CO2_Mt_Transport double, Total_HH_Consumption_MUSD double",
    )
    got = {r.GTAP: r.CO2_t_per_dollar_global for r in carbon.carbon_intensity(sectors, emissions).collect()}
    assert got == {"gasgdt": pytest.approx(0.2), "ely": float("inf")}


@pytest.mark.parametrize(
    "base, target, want",
    [(2010, 2014, 1.1 * 1.2 * 1.3 * 1.4), (2014, 2014, 1.0), (2016, 2014, 1 / (1.5 * 1.6)), (2011, 2014, 1.2 * 1.3 * 1.4)],
)
def test_price_chain(spark, base, target, want):
    cpi = spark.createDataFrame(
        [("X", *[str(10.0 * i) for i in range(7)])],
        "Country string, " + ", ".join(f"`{y}` string" for y in range(2010, 2017)),
    )
    got = spark.range(1).select(spending.price_factor(cpi, "X", base, target).alias("f")).first().f
    assert got == pytest.approx(want)


def test_price_chain_with_a_missing_year_is_unknown(spark):
    cpi = spark.createDataFrame([("X", "1.0", "n/a", "2.0")], "Country string, `2010` string, `2011` string, `2012` string")
    got = {r.base_year: r.factor for r in spending.price_factors(cpi, 2012).collect()}
    assert got[2010] is None and got[2011] == pytest.approx(1.02) and got[2012] == 1.0


def test_category_shares_keep_other_categories_in_the_total(spark):
    exp = spark.createDataFrame([(1, "a", 2.0), (1, "b", 6.0), (1, "c", 99.0), (2, "b", 1.0)], "hh_id int, item_code string, expenditures double")
    cats = spark.createDataFrame([("a", "Food"), ("b", "Rent"), ("c", "deleted")], "item_code string, category string")
    got = {r.hh_id: r.share_Food for r in spending.category_shares(exp, cats, ["Food"]).collect()}
    assert got == {1: 0.25, 2: 0.0}


def test_household_frame_is_fully_outer(spark):
    house = spark.createDataFrame([(1, 2, 1, 1), (1, 3, 1, 1), (2, 1, 1, 1)], "hh_id int, hh_size int, gender_hhh int, ethnicity_hhh int")
    persons = spark.createDataFrame([(1, 40, 1, 9), (1, None, 2, 3), (1, 10, None, 2), (3, 50, 1, 7)], "hh_id int, age int, relationhhh int, education_hhh int")
    assets = spark.createDataFrame([(4, 1, 1)], "hh_id int, own_stove int, own_vehicle int")
    out = {r.hh_id: r for r in households.household_frame(house, persons, assets, with_composition=True).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert (out[1].hh_size, out[1].education_hhh, out[1].adult, out[1].child, out[1].adulteq) == (2, 9, 1, 1, 1.3)
    assert out[4].own_stove == 1 and out[2].education_hhh is None


def test_electricity_source_priority(spark):
    rows = [(2, 1, 4), (1, 1, 4), (1, 2, 4), (1, 2, 5), (1, None, 8), (1, None, None), (None, 1, 3)]
    df = spark.createDataFrame(rows, "electricitycon int, electricitymains int, electricitysource int")
    got = [r.electricitysource for r in energy.with_electricity_source(df).collect()]
    assert got == ["No Access", "Mains", "Solar Energy", "Other", "Other", None, "Mains"]


def test_energy_mix_rows_and_shares(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 11), (1, 99), (1, 7), (None, 3)], "province int, cookingsource int")
    a = {(r.province, r.cookingsource): r.perc for r in energy.energy_mix(df, "A", "cookingsource", ["province"]).collect()}
    assert a == {(1, "Electricity Mains"): pytest.approx(2 / 3), (1, None): pytest.approx(1 / 3), (None, "Gas"): 1.0}
    c = {(r.province, r.cookingsource): r.perc for r in energy.energy_mix(df, "C", "cookingsource", ["province"]).collect()}
    assert c[(1, "Other")] == pytest.approx(0.2) and c[(1, None)] == pytest.approx(0.4)


def test_mart_invariants(the_mart):
    shares = [c for c in the_mart.columns if c.startswith("share_")]
    off = the_mart.filter(F.abs(sum(F.col(c) for c in shares) - 1) > 1e-9).count()
    assert off == 0
    assert the_mart.count() == the_mart.select("hh_id").distinct().count() == 150
    by10 = {r.Income_Group_10 for r in the_mart.select("Income_Group_10").distinct().collect()}
    assert by10 == set(range(1, 11))
    for c in ("hh_expenditures_USD_2014", "CO2_t_national", "exp_CO2_transport", "burden_CO2_global", "Income_Group_3"):
        assert c in the_mart.columns


def test_lump_sum_is_budget_neutral(the_mart):
    r = recycling.lump_sum_gain(the_mart).agg(
        F.sum(F.col("net_gain") * F.col("hh_expenditures_USD_2014") * F.col("hh_weights")).alias("net"),
        F.sum(F.col("exp_CO2_national") * F.col("hh_weights")).alias("cost"),
    ).first()
    assert abs(r.net) < 1e-9 * r.cost


def test_no_recycling_turns_the_signs(the_mart):
    rows = recycling.no_recycling(the_mart).collect()
    assert len(rows) == 5
    for r in rows:
        assert r.y5 >= r.y25 >= r.y50 >= r.y75 >= r.y95 and r["mean"] < 0
        assert r.category == "burden_CO2_national"


def test_output_headers(spark):
    from workload.catalogue import QUERIES

    heads = {
        "mean_by_decile": ["Income_Group_10", "mean"],
        "box_by_quintile_gender": ["Income_Group_5", "gender_hhh", "y5", "y25", "y50", "y75", "y95", "mean"],
        "crosstab_eth": ["ethnicity_hhh", "1", "2", "3", "4", "5"],
        "crosstab_prov": ["province", "1", "2", "3"],
        "tonnes_by_decile": ["Income_Group_10", "t_national"],
        "spend_by_decile": ["Income_Group_10", "mean_hh_expendituresUSD"],
        "category_pct_by_decile": ["Income_Group_10", "Services", "Goods", "Food", "Energy"],
        "compare_schemes": ["category", "1", "2", "3", "4", "5"],
    }
    for name, columns in heads.items():
        assert QUERIES[name](spark, SF).columns == columns


def test_one_pass_mart_equals_the_assembled_parts(t, the_mart):
    from workload.catalogue import QUERIES

    a = sorted(map(tuple, QUERIES["final_mart"](t.spark, SF).collect()), key=str)
    b = sorted(map(tuple, QUERIES["final_mart_assembled"](t.spark, SF).collect()), key=str)
    assert a == b


def test_ambiguous_concordance_stops_the_mart(t):
    from dataclasses import replace

    from levyscape.operators.quality import CheckFailed

    doubled = replace(t.survey, sector_map=t.sector_map.unionByName(t.sector_map))
    with pytest.raises(CheckFailed):
        mart.build_mart(doubled, on_unmatched="drop")


def test_each_gate_stops_the_mart(t):
    from dataclasses import replace

    from levyscape.operators.quality import CheckFailed

    used = t.lines.select("item_code").distinct()
    everything = replace(
        t.survey,
        sector_map=used.withColumn("GTAP", F.lit("s1")),
        categories=used.withColumn("category", F.lit("Food")),
    )
    assert mart.gate_reports(everything, t.lines).isEmpty()
    one = F.col("item_code") != used.agg(F.min("item_code")).first()[0]
    for broken, message in (
        (replace(everything, sector_map=everything.sector_map.filter(one)), mart.NO_SECTOR),
        (replace(everything, categories=everything.categories.filter(one)), mart.NO_CATEGORY),
        (replace(everything, emissions=t.emissions.withColumn("Total_HH_Consumption_MUSD", F.lit(0.0))), "infinite"),
    ):
        with pytest.raises(CheckFailed, match=message):
            mart.build_mart(broken)
