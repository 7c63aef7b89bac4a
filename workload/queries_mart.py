"""Tables of the mart, compensation schemes, energy mix, code books and models."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from levyscape.functions import codebook
from levyscape.functions.survey_codes import (
    INDICATORS,
    MODEL_FACTORS,
    MODEL_SPECS,
    TRANSFER_FACTORS,
    TRANSFER_MAINS_LEVELS,
)
from levyscape.operators import clusters, learning, regression, splits
from levyscape.operators.design import Factor, ModelSpec
from levyscape.operators.quality import has_infinite
from levyscape.plans import distribution, energy, recycling
from levyscape.sources.staging import stage
from workload.oracle import BOX, box_sql
from workload.registry import query, register

_B = "burden_CO2_national"
_WMEAN = "sum(hh_weights * {x}) / sum(CASE WHEN {x} IS NOT NULL THEN hh_weights END)"


def wmean_sql(x: str) -> str:
    return _WMEAN.format(x=x)


# --- distribution tables -----------------------------------------------------------
register(
    "mean_by_decile",
    "Income_Group_10:i mean:6",
    lambda t: distribution.mean_by(t.mart, _B, ["Income_Group_10"]),
    f"SELECT Income_Group_10, {wmean_sql(_B)} AS mean FROM mart GROUP BY 1",
)
_BOXSPEC = " ".join(f"{n}:6" for n in [*BOX[1], "mean"])
for _attr, _name in (("gender_hhh", "gender"), ("electricitycon", "electricity_access")):
    register(
        f"box_by_quintile_{_name}",
        f"Income_Group_5:i {_attr}:i {_BOXSPEC}",
        lambda t, a=_attr: distribution.box_by(t.mart, _B, ["Income_Group_5", a]),
        box_sql("SELECT * FROM mart", _B, "hh_weights", ["Income_Group_5", _attr]),
    )
_STACK = " UNION ALL ".join(
    f"SELECT Income_Group_5, hh_weights, 'burden_CO2_{c}' AS category, burden_CO2_{c} AS burden FROM mart"
    for c in ("transport", "electricity", "national")
)
register(
    "box_by_carrier",
    f"Income_Group_5:i category:s {_BOXSPEC}",
    lambda t: distribution.box_by_carrier(t.mart, "Income_Group_5", ["transport", "electricity", "national"]),
    box_sql(_STACK, "burden", "hh_weights", ["Income_Group_5", "category"]),
)
for _name, _row, _k in (
    ("eth", "ethnicity_hhh", 5),
    ("urb", "urban_1", 5),
    ("elec_free", "electricityfree", 5),
    ("elec_mains", "electricitymains", 5),
    ("elec_access", "electricitycon", 5),
    ("prov", "province", 3),
):
    register(
        f"crosstab_{_name}",
        f"{_row}:i " + " ".join(f"{i}:6" for i in range(1, _k + 1)),
        lambda t, r=_row, k=_k: distribution.crosstab(t.mart, _B, r, f"Income_Group_{k}", range(1, k + 1)),
        f"SELECT {_row}, "
        + ", ".join(
            f"sum(hh_weights * {_B}) FILTER (Income_Group_{_k} = {i}) / sum(hh_weights) FILTER (Income_Group_{_k} = {i}) AS \"{i}\""
            for i in range(1, _k + 1)
        )
        + f" FROM mart GROUP BY {_row}",
    )
register(
    "tonnes_by_decile",
    "Income_Group_10:i t_national:5",
    lambda t: distribution.mean_by(t.mart, "CO2_t_national", ["Income_Group_10"], "t_national"),
    f"SELECT Income_Group_10, {wmean_sql('CO2_t_national')} AS t_national FROM mart GROUP BY 1",
)
register(
    "spend_by_decile",
    "Income_Group_10:i mean_hh_expendituresUSD:3",
    lambda t: distribution.mean_by(
        t.mart, "hh_expenditures_USD_2014", ["Income_Group_10"], "mean_hh_expendituresUSD"
    ),
    f"SELECT Income_Group_10, {wmean_sql('hh_expenditures_USD_2014')} AS mean_hh_expendituresUSD FROM mart GROUP BY 1",
)
_CATS = ("Services", "Goods", "Food", "Energy")
register(
    "category_pct_by_decile",
    "Income_Group_10:i " + " ".join(f"{c}:6" for c in _CATS),
    lambda t: distribution.means_by(t.mart, {c: f"share_{c}" for c in _CATS}, ["Income_Group_10"], 100.0),
    f"SELECT Income_Group_10, {', '.join('100 * ' + wmean_sql(f'share_{c}') + f' AS {c}' for c in _CATS)} FROM mart GROUP BY 1",
)
register(
    "mart_is_finite",
    "infinite:b",
    lambda t: has_infinite(t.mart, ["CO2_t_global", "burden_CO2_global"]),
    "SELECT coalesce(bool_or(isinf(CO2_t_global) OR isinf(burden_CO2_global)), false) AS infinite FROM mart",
)

# --- compensation ----------------------------------------------------------------------
_TRANSFER = "SELECT sum(exp_CO2_national * hh_weights) / sum(hh_size * hh_weights) AS transfer FROM mart"
register("per_head_transfer", "transfer:4", lambda t: recycling.per_head_transfer(t.mart), _TRANSFER)
register(
    "unweighted_totals",
    "cost_per_household:4 total_electricity:2",
    lambda t: recycling.unweighted_totals(t.mart),
    "SELECT avg(exp_CO2_national) AS cost_per_household, sum(exp_CO2_electricity) AS total_electricity FROM mart",
)
_LUMP = f"""SELECT hh_id, Income_Group_5, hh_weights,
  -((exp_CO2_national - (SELECT transfer FROM ({_TRANSFER}) tr) * hh_size) / hh_expenditures_USD_2014) AS gain FROM mart"""
_ELEC = """SELECT Income_Group_5, hh_weights,
  -((exp_CO2_national - exp_CO2_electricity) / hh_expenditures_USD_2014) AS gain FROM mart"""
_SCHEMES = {
    "burden_CO2_revenue100": f"SELECT * FROM ({box_sql(_LUMP, 'gain', 'hh_weights', ['Income_Group_5'])}) a",
    "burden_elec_sub": f"SELECT * FROM ({box_sql(_ELEC, 'gain', 'hh_weights', ['Income_Group_5'])}) a",
    "burden_CO2_national": "SELECT Income_Group_5, "
    + ", ".join(f"-{c} AS {c}" for c in [*BOX[1], "mean"])
    + f" FROM ({box_sql('SELECT * FROM mart', _B, 'hh_weights', ['Income_Group_5'])}) a",
}
register("lump_sum_gain", "hh_id:i net_gain:6", lambda t: recycling.lump_sum_gain(t.mart),
         f"SELECT hh_id, gain AS net_gain FROM ({_LUMP}) g")
for _name, _label, _fn in (
    ("lump_sum", "burden_CO2_revenue100", recycling.lump_sum),
    ("carrier_compensation", "burden_elec_sub", recycling.carrier_compensation),
    ("no_recycling", "burden_CO2_national", recycling.no_recycling),
):
    register(
        _name,
        f"Income_Group_5:i {_BOXSPEC} category:s",
        lambda t, fn=_fn: fn(t.mart),
        f"SELECT s.*, '{_label}' AS category FROM ({_SCHEMES[_label]}) s",
    )
register(
    "compare_schemes",
    "category:s " + " ".join(f"{i}:6" for i in range(1, 6)),
    lambda t: recycling.compare_schemes(t.mart),
    "SELECT category, "
    + ", ".join(f"max(mean) FILTER (Income_Group_5 = {i}) AS \"{i}\"" for i in range(1, 6))
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT Income_Group_5, mean, '{label}' AS category FROM ({sql}) s" for label, sql in _SCHEMES.items()
    )
    + ") u GROUP BY category",
)

# --- energy mix --------------------------------------------------------------------------
_FUEL = "WHEN 1 THEN 'Electricity Mains' WHEN 2 THEN 'Other Electricity' WHEN 3 THEN 'Gas' WHEN 4 THEN 'Paraffin' "
_SOLID = "WHEN 5 THEN 'Wood' WHEN 6 THEN 'Coal' WHEN 8 THEN 'Animal Dung' WHEN 9 THEN 'Solar Energy' "
_SQL_MIX = {
    # attribute: {survey: (label, rows that count)}
    "electricitycon": dict.fromkeys(
        "AC", ("CASE electricitycon WHEN 1 THEN 'Access' WHEN 2 THEN 'No Access' END", "electricitycon <> 9")
    ),
    "electricitysource": {
        "A": ("CASE WHEN electricitymains = 1 THEN 'Mains' WHEN electricitysource IN (1, 2, 6) THEN 'Other' "
              "WHEN electricitysource = 3 THEN 'Generator' WHEN electricitysource = 4 THEN 'Solar Energy' END",
              "(electricitymains = 1 OR electricitysource IN (1, 2, 3, 4, 6))"),
        "C": ("CASE WHEN electricitymains = 1 THEN 'Mains' WHEN electricitysource IN (1, 2, 3, 4, 7) THEN 'Other' "
              "WHEN electricitysource = 5 THEN 'Generator' WHEN electricitysource = 6 THEN 'Solar Energy' END",
              "(electricitymains = 1 OR electricitysource IN (1, 2, 3, 4, 5, 6, 7))"),
    },
    "cookingsource": {
        "A": (f"CASE cookingsource {_FUEL}{_SOLID}WHEN 10 THEN 'Other' END", "cookingsource NOT IN (99, 11)"),
        "C": (f"CASE cookingsource {_FUEL}{_SOLID}WHEN 11 THEN 'Other' END", "true"),
    },
    "lightingsource": {
        "A": (f"CASE lightingsource {_FUEL}WHEN 7 THEN 'Candles' WHEN 9 THEN 'Solar Energy' WHEN 10 THEN 'Other' END",
              "lightingsource <> 99"),
        "C": (f"CASE lightingsource {_FUEL}WHEN 7 THEN 'Candles' WHEN 9 THEN 'Solar Energy' WHEN 11 THEN 'Other' END",
              "lightingsource <> 10"),
    },
    "heatingsourcewater": {
        "A": (f"CASE heatingsourcewater {_FUEL}{_SOLID}WHEN 10 THEN 'Other' WHEN 11 THEN 'No Access' END",
              "heatingsourcewater <> 99"),
        "C": (f"CASE heatingsourcewater {_FUEL}{_SOLID}WHEN 10 THEN 'No Access' WHEN 11 THEN 'Other' END",
              "heatingsourcewater <> 99"),
    },
    "heatingsourcespace": {
        "A": (f"CASE heatingsourcespace {_FUEL}{_SOLID}WHEN 10 THEN 'Other' WHEN 11 THEN 'No Access' END",
              "heatingsourcespace <> 99"),
        "C": (f"CASE heatingsourcespace {_FUEL}{_SOLID}WHEN 10 THEN 'No Access' WHEN 11 THEN 'Other' END", "true"),
    },
}
_SHORT = {
    "electricitycon": "access",
    "electricitysource": "source",
    "cookingsource": "cooking",
    "lightingsource": "lighting",
    "heatingsourcewater": "water",
    "heatingsourcespace": "space",
}


def _mix_sql(src: str, by: str, attr: str, survey: str) -> str:
    label, rows = _SQL_MIX[attr][survey]
    return f"""SELECT {by}, label AS {attr}, count(*) / sum(count(*)) OVER (PARTITION BY {by}) AS perc
        FROM (SELECT {by}, {label} AS label FROM {src} WHERE {rows}) AS coded GROUP BY {by}, label"""


for _attr, _name in _SHORT.items():
    register(
        f"energy_mix_{_name}_province_a",
        f"province:i {_attr}:s perc:6",
        lambda t, a=_attr: energy.energy_mix(t.hh, "A", a, ["province"]),
        _mix_sql("hh", "province", _attr, "A"),
    )
    register(
        f"energy_mix_{_name}_province_c",
        f"province:i {_attr}:s perc:6",
        lambda t, a=_attr: energy.energy_mix(t.hh, "C", a, ["province"]),
        _mix_sql("hh", "province", _attr, "C"),
    )
    register(
        f"energy_mix_{_name}_decile",
        f"Income_Group_10:i {_attr}:s perc:6",
        lambda t, a=_attr: energy.energy_mix(t.mart, "A", a, ["Income_Group_10"]),
        _mix_sql("mart", "Income_Group_10", _attr, "A"),
    )
_PROV = """CASE province WHEN 1 THEN 'Western Cape' WHEN 2 THEN 'Eastern Cape' WHEN 3 THEN 'Northern Cape' WHEN 4 THEN 'Free State'
  WHEN 5 THEN 'KwaZulu-Natal' WHEN 6 THEN 'North West' WHEN 7 THEN 'Gauteng' WHEN 8 THEN 'Mpumalanga' WHEN 9 THEN 'Limpopo' END"""
_HARM = " UNION ALL ".join(
    f"SELECT hh_id, '{s}' AS survey, {_PROV} AS province, "
    + ", ".join(f"{_SQL_MIX[a][s][0]} AS {a}" for a in _SHORT)
    + " FROM hh"
    for s in ("A", "C")
)
register(
    "harmonise_surveys",
    "hh_id:i survey:s province:s " + " ".join(f"{a}:s" for a in _SHORT),
    lambda t: energy.harmonise(t.hh, "A").unionByName(energy.harmonise(t.hh, "C")),
    _HARM,
)
_SOURCE = """CASE WHEN electricitycon = 2 THEN 'No Access' WHEN electricitymains = 1 THEN 'Mains'
  WHEN electricitysource = 4 THEN 'Solar Energy' WHEN electricitysource IS NOT NULL THEN 'Other' END"""
register("electricity_source", "hh_id:i electricitysource:s",
         lambda t: energy.with_electricity_source(t.hh),
         f"SELECT hh_id, {_SOURCE} AS electricitysource FROM hh")
register("renumbered_households", "hh_id:i province:i",
         lambda t: energy.renumber(t.hh),
         "SELECT row_number() OVER (ORDER BY hh_id) AS hh_id, province FROM hh")

# --- recoding and indicators ---------------------------------------------------------------
_OWN = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 1 THEN 'Ownership' WHEN {c} = 3 THEN 'No Access' ELSE 'Other' END"
_MF = "CASE {c} WHEN 1 THEN 'Mains' WHEN 2 THEN 'Electricity Other' WHEN 3 THEN 'Gas' WHEN 4 THEN 'Paraffin' WHEN 5 THEN 'Wood' WHEN 6 THEN 'Coal' WHEN 8 THEN 'Animal Dung' WHEN 9 THEN 'Solar Energy' WHEN 11 THEN 'No Access' ELSE CASE WHEN {c} IS NOT NULL THEN 'Other' END END"
_RECODED = f"""SELECT hh_id, {_PROV} AS province,
  CASE urban_1 WHEN 1 THEN 'Urban formal' WHEN 2 THEN 'Urban informal' WHEN 4 THEN 'Traditional area' WHEN 5 THEN 'Rural formal' END AS urban_1,
  CASE gender_hhh WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender_hhh,
  CASE ethnicity_hhh WHEN 1 THEN 'African Black' WHEN 2 THEN 'Coloured' WHEN 3 THEN 'Indian/Asian' WHEN 4 THEN 'White' END AS ethnicity_hhh,
  {_OWN.format(c="own_vehicle")} AS own_vehicle, {_OWN.format(c="own_stove")} AS own_stove,
  {_MF.format(c="cookingsource")} AS cookingsource, {_MF.format(c="heatingsourcespace")} AS heatingsourcespace,
  CASE electricityfree WHEN 1 THEN 'Free Electricity' WHEN 2 THEN 'No Free Electricity' ELSE CASE WHEN electricityfree IS NOT NULL THEN 'Other' END END AS electricityfree,
  CASE WHEN education_hhh IS NULL THEN NULL WHEN education_hhh = 1 THEN 'Pre-primary Education' WHEN education_hhh BETWEEN 2 AND 5 THEN 'Primary Education'
    WHEN education_hhh BETWEEN 6 AND 8 THEN 'Lower Secondary Education' WHEN education_hhh BETWEEN 9 AND 14 THEN 'Upper Secondary Education'
    WHEN education_hhh BETWEEN 15 AND 24 THEN 'Post-secondary Non-tertiary Education' WHEN education_hhh IN (25, 26) THEN 'Short-cycle Tertiary Education'
    WHEN education_hhh BETWEEN 27 AND 29 THEN 'Bachelors or Equivalent' WHEN education_hhh = 30 THEN 'Masters or Equivalent'
    WHEN education_hhh = 98 THEN 'No Schooling' ELSE 'Other' END AS education_hhh,
  CASE lightingsource WHEN 1 THEN 'Electricity Mains' WHEN 2 THEN 'Electricity Other' WHEN 4 THEN 'Paraffin' WHEN 7 THEN 'Candles' WHEN 9 THEN 'Solar Energy'
    ELSE CASE WHEN lightingsource IS NOT NULL THEN 'Other' END END AS lightingsource,
  {_MF.format(c="heatingsourcewater")} AS heatingsourcewater,
  {_SOURCE} AS electricitysource FROM frame"""
_RC = ("province", "urban_1", "gender_hhh", "ethnicity_hhh", "own_vehicle", "own_stove", "cookingsource",
       "heatingsourcespace", "electricityfree", "electricitysource", "education_hhh", "lightingsource", "heatingsourcewater")


def _frame(t):
    from levyscape.plans.households import household_frame

    return household_frame(t.hh, t.persons, t.assets)


register(
    "harmonise_b",
    "hh_id:i survey:s electricitymains:s province:s urban_1:s gender_hhh:s ethnicity_hhh:s",
    lambda t: energy.transfer_factors(_frame(t).drop("electricitymains"), "B").withColumn("survey", F.lit("B"))
    .unionByName(energy.transfer_factors(_frame(t), "A").withColumn("survey", F.lit("A")), allowMissingColumns=True),
    " UNION ALL ".join(
        f"""SELECT hh_id, '{s}' AS survey, CASE WHEN {c} = 1 THEN 'Mains' WHEN {c} > 1 THEN 'Other' END AS electricitymains, {_PROV} AS province,
  CASE urban_1 WHEN 1 THEN 'Urban formal' WHEN 2 THEN 'Urban informal' WHEN 4 THEN 'Traditional area' WHEN 5 THEN 'Rural formal' END AS urban_1,
  CASE gender_hhh WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender_hhh,
  CASE ethnicity_hhh WHEN 1 THEN 'African Black' WHEN 2 THEN 'Coloured' WHEN 3 THEN 'Indian/Asian' WHEN 4 THEN 'White' END AS ethnicity_hhh
  FROM frame"""
        for s, c in (("A", "electricitymains"), ("B", "electricitycon"))
    ),
)
register(
    "recode_factors",
    "hh_id:i " + " ".join(f"{c}:s" for c in _RC),
    lambda t: codebook.recode(energy.with_electricity_source(_frame(t)), MODEL_SPECS),
    _RECODED,
)


# what each indicator must hold: name, column, SQL list of codes
_HOT_CODES = """
pro_westerncape province 1
pro_easterncape province 2
pro_northerncape province 3
pro_freestate province 4
pro_kwazulunatal province 5
pro_northwest province 6
pro_gauteng province 7
pro_mpumalanga province 8
pro_limpopo province 9
urb_urban_formal urban_1 1
urb_urban_informal urban_1 2
urb_rural_traditional urban_1 4
urb_rural_formal urban_1 5
gender_male gender_hhh 1
gender_female gender_hhh 2
eth_africanblack ethnicity_hhh 1
eth_coloured ethnicity_hhh 2
eth_indian_asian ethnicity_hhh 3
eth_white ethnicity_hhh 4
edu_preprimary education_hhh 1
edu_primary education_hhh 2,3,4,5
edu_lower_secondary education_hhh 6,7,8
edu_upper_secondary education_hhh 9,10,11,12,13,14
edu_postsecondary_nontertiary education_hhh 15,16,17,18,19,20,21,22,23,24
edu_shortcycle_tertiary education_hhh 25,26
edu_bachelor_eq education_hhh 27,28,29
edu_master_eq education_hhh 30
edu_other education_hhh 31,32
edu_no_schooling education_hhh 98
veh_own own_vehicle 1
veh_other own_vehicle 2,9
veh_noaccess own_vehicle 3
sto_own own_stove 1
sto_other own_stove 2,9
sto_noaccess own_stove 3
elec_mains electricitysource 'Mains'
elec_other electricitysource 'Other'
elec_solar electricitysource 'Solar Energy'
elec_noaccess electricitysource 'No Access'
elecf_free electricityfree 1
elecf_nofree electricityfree 2
light_elecmains lightingsource 1
light_elecother lightingsource 2
light_other lightingsource 3,10,99
light_paraffin lightingsource 4
light_candles lightingsource 7
light_solar lightingsource 9
cooking_elecmains cookingsource 1
cooking_elecother cookingsource 2
cooking_gas cookingsource 3
cooking_paraffin cookingsource 4
cooking_coal cookingsource 6
cooking_wood cookingsource 5
cooking_dung cookingsource 8
cooking_solar cookingsource 9
cooking_other cookingsource 10,99
cooking_noaccess cookingsource 11
heat_w_elecmains heatingsourcewater 1
heat_w_elecother heatingsourcewater 2
heat_w_gas heatingsourcewater 3
heat_w_paraffin heatingsourcewater 4
heat_w_coal heatingsourcewater 6
heat_w_wood heatingsourcewater 5
heat_w_dung heatingsourcewater 8
heat_w_solar heatingsourcewater 9
heat_w_other heatingsourcewater 10,99
heat_w_noaccess heatingsourcewater 11
heat_s_elecmains heatingsourcespace 1
heat_s_elecother heatingsourcespace 2
heat_s_gas heatingsourcespace 3
heat_s_paraffin heatingsourcespace 4
heat_s_coal heatingsourcespace 6
heat_s_wood heatingsourcespace 5
heat_s_dung heatingsourcespace 8
heat_s_solar heatingsourcespace 9
heat_s_other heatingsourcespace 10,99
heat_s_noaccess heatingsourcespace 11
"""
_HOT_ROWS = [line.split(" ", 2) for line in _HOT_CODES.split("\n") if line]
_HOT = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CAST({c} IN ({codes}) AS INT) END AS {name}" for name, c, codes in _HOT_ROWS)
register(
    "one_hot",
    "hh_id:i " + " ".join(f"{name}:i" for name, _, _ in _HOT_ROWS),
    lambda t: codebook.one_hot(energy.with_electricity_source(_frame(t)), INDICATORS, ["hh_id"]),
    f"SELECT hh_id, {_HOT} FROM (SELECT * REPLACE ({_SOURCE} AS electricitysource) FROM frame) f",
)

# --- driver models -------------------------------------------------------------------------
_LEVELS = {s.column: s.levels for s in MODEL_SPECS}


@lru_cache
def full_spec() -> ModelSpec:
    from levyscape.functions.survey_codes import ELECTRICITY_LEVELS

    levels = {**_LEVELS, "electricitysource": ELECTRICITY_LEVELS}
    return ModelSpec(("log_expenditures_hh",), tuple(Factor(c, levels[c]) for c in MODEL_FACTORS))


def model_frame(t, mart=None):
    """Mart with recoded predictors and log spending."""
    coded = codebook.recode(energy.with_electricity_source(t.mart if mart is None else mart), MODEL_SPECS)
    return coded.withColumn("log_expenditures_hh", F.ln("hh_expenditures_USD_2014"))


_GENDER = ModelSpec(factors=(Factor("gender_hhh", ("Male", "Female")),))
_WITHIN = ModelSpec(("hh_size",), _GENDER.factors)

register(
    "top_decile_flag",
    "hh_id:i overall:b",
    lambda t: regression.top_decile_flag(t.mart.select("hh_id", _B), _B, out="overall"),
    f"SELECT hh_id, ntile(10) OVER (ORDER BY {_B}, hh_id) = 10 AS overall FROM mart",
)
register(
    "top_decile_flag_by_quintile",
    "hh_id:i Income_Group_5:i burden_decile:b",
    lambda t: regression.top_decile_flag(t.mart.select("hh_id", "Income_Group_5", _B), _B, by=["Income_Group_5"]),
    f"SELECT hh_id, Income_Group_5, ntile(10) OVER (PARTITION BY Income_Group_5 ORDER BY {_B}, hh_id) = 10 AS burden_decile FROM mart",
)
_G = "CASE gender_hhh WHEN 1 THEN 'Male' ELSE 'Female' END"


def _one_factor(t, y: str):
    people = t.hh.select("hh_id", F.col("income").alias("y"), "hh_size", "gender_hhh", "electricitycon")
    coded = codebook.recode(people, [s for s in MODEL_SPECS if s.column == "gender_hhh"])
    return coded.withColumn("high", (F.col("y") > 5000).cast("double")) if y == "high" else coded


register(
    "ols_within_slope",
    "term:s estimate:6",
    lambda t: regression.ols(_one_factor(t, "y"), "y", _WITHIN).table(t.spark).filter("term = 'hh_size'"),
    """SELECT 'hh_size' AS term, sum((hh_size - mx) * (income - my)) / sum((hh_size - mx) * (hh_size - mx)) AS estimate
       FROM (SELECT *, avg(hh_size) OVER (PARTITION BY gender_hhh) AS mx, avg(income) OVER (PARTITION BY gender_hhh) AS my FROM hh)""",
)
register(
    "ols_one_factor",
    "term:s estimate:5 std_error:5",
    lambda t: regression.ols(_one_factor(t, "y"), "y", _GENDER).table(t.spark),
    """WITH s AS (SELECT avg(income) FILTER (gender_hhh = 1) AS m1, avg(income) FILTER (gender_hhh = 2) AS m2,
         count(*) FILTER (gender_hhh = 1) AS n1, count(*) FILTER (gender_hhh = 2) AS n2, count(*) AS n FROM hh),
       r AS (SELECT sum((income - CASE gender_hhh WHEN 1 THEN m1 ELSE m2 END) ** 2) / (max(n) - 2) AS v FROM hh, s)
       SELECT '(Intercept)' AS term, m1 AS estimate, sqrt(v / n1) AS std_error FROM s, r
       UNION ALL SELECT 'gender_hhhFemale', m2 - m1, sqrt(v / n1 + v / n2) FROM s, r""",
)
_P = """WITH s AS (SELECT avg(CASE WHEN income > 5000 THEN 1e0 ELSE 0 END) FILTER (gender_hhh = 1) AS p1,
  avg(CASE WHEN income > 5000 THEN 1e0 ELSE 0 END) FILTER (gender_hhh = 2) AS p2,
  avg(CASE WHEN income > 5000 THEN 1e0 ELSE 0 END) AS p,
  count(*) FILTER (gender_hhh = 1) AS n1, count(*) FILTER (gender_hhh = 2) AS n2, count(*) AS n FROM hh)"""
register(
    "logit_one_factor",
    "term:s estimate:6 std_error:6",
    lambda t: regression.logit(_one_factor(t, "high"), "high", _GENDER).table(t.spark),
    f"""{_P} SELECT '(Intercept)' AS term, ln(p1 / (1 - p1)) AS estimate, sqrt(1 / (n1 * p1 * (1 - p1))) AS std_error FROM s
        UNION ALL SELECT 'gender_hhhFemale', ln(p2 / (1 - p2)) - ln(p1 / (1 - p1)),
          sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n2 * p2 * (1 - p2))) FROM s""",
)
_STARRED = "CASE WHEN z >= 3.2905267314919255e0 THEN '***' WHEN z >= 2.5758293035489004e0 THEN '**' WHEN z >= 1.959963984540054e0 THEN '*' ELSE '' END"
register(
    "star_table_one_factor",
    "variable_name:s intercept:6 standard_error:6 signif:s",
    lambda t: regression.star_table(regression.logit(_one_factor(t, "high"), "high", _GENDER).table(t.spark)),
    f"""{_P}, c AS (SELECT '(Intercept)' AS variable_name, ln(p1 / (1 - p1)) AS intercept, sqrt(1 / (n1 * p1 * (1 - p1))) AS standard_error FROM s
        UNION ALL SELECT 'gender_hhhFemale', ln(p2 / (1 - p2)) - ln(p1 / (1 - p1)), sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n2 * p2 * (1 - p2))) FROM s)
        SELECT variable_name, intercept, standard_error, {_STARRED} AS signif FROM (SELECT *, abs(intercept / standard_error) AS z FROM c)""",
)
_SIZES = {"all": "true", "small": "hh_size <= 3", "large": "hh_size > 3"}


@query(
    "side_by_side_one_factor",
    "term:s " + " ".join(f"{n}:6" for n in _SIZES),
    " UNION ALL ".join(
        f"SELECT {term} AS term, " + ", ".join(f"max({value}) FILTER (g = '{n}') AS \"{n}\"" for n in _SIZES)
        + " FROM (" + " UNION ALL ".join(
            f"""SELECT '{n}' AS g, avg(CASE WHEN income > 5000 THEN 1e0 ELSE 0 END) FILTER (gender_hhh = 1) AS p1,
            avg(CASE WHEN income > 5000 THEN 1e0 ELSE 0 END) FILTER (gender_hhh = 2) AS p2 FROM hh WHERE {rows}"""
            for n, rows in _SIZES.items()
        ) + ") s"
        for term, value in (
            ("'(Intercept)'", "ln(p1 / (1 - p1))"),
            ("'gender_hhhFemale'", "ln(p2 / (1 - p2)) - ln(p1 / (1 - p1))"),
            ("'(converged)'", "1e0"),
        )
    ),
)
def _(t):
    models = {n: ("high", F.expr(rows)) for n, rows in _SIZES.items()}
    return regression.compare_models(regression.logits(_one_factor(t, "high"), models, _GENDER), t.spark)


register(
    "ols_t_values",
    "term:s statistic:4",
    lambda t: regression.ols(_one_factor(t, "y"), "y", _GENDER).table(t.spark),
    """WITH s AS (SELECT avg(income) FILTER (gender_hhh = 1) AS m1, avg(income) FILTER (gender_hhh = 2) AS m2,
         count(*) FILTER (gender_hhh = 1) AS n1, count(*) FILTER (gender_hhh = 2) AS n2, count(*) AS n FROM hh),
       r AS (SELECT sum((income - CASE gender_hhh WHEN 1 THEN m1 ELSE m2 END) ** 2) / (max(n) - 2) AS v FROM hh, s)
       SELECT '(Intercept)' AS term, m1 / sqrt(v / n1) AS statistic FROM s, r
       UNION ALL SELECT 'gender_hhhFemale', (m2 - m1) / sqrt(v / n1 + v / n2) FROM s, r""",
)


@query(
    "relabel_terms",
    "caption:s prefix_order:i AME:6 position:i",
    """SELECT caption, prefix_order, "AME", row_number() OVER (ORDER BY prefix_order, "AME", caption) AS position FROM (
         SELECT 'Gender: ' || CASE gender_hhh WHEN 1 THEN 'Male' ELSE 'Female' END AS caption, 6 AS prefix_order, avg(income) AS "AME" FROM hh GROUP BY gender_hhh
         UNION ALL SELECT 'Province: ' || CAST(province AS VARCHAR), 2, avg(income) FROM hh WHERE province <> 9 GROUP BY province
         UNION ALL SELECT 'Cooking Fuel: ' || CAST(cookingsource AS VARCHAR), 11, avg(income) FROM hh WHERE cookingsource IS NOT NULL GROUP BY cookingsource
         UNION ALL SELECT 'hh_size' || CAST(hh_size AS VARCHAR), 14, avg(income) FROM hh GROUP BY hh_size) AS terms""",
)
def _(t):
    gender = F.when(F.col("gender_hhh") == 1, "Male").otherwise("Female")
    named = {"gender_hhh": gender, "province": F.col("province"), "cookingsource": F.col("cookingsource"), "hh_size": F.col("hh_size")}
    terms = F.explode(F.array(*[F.concat(F.lit(name), label.cast("string")) for name, label in named.items()])).alias("factor")
    effects = t.hh.select("income", terms).filter("factor IS NOT NULL").groupBy("factor").agg(F.avg("income").alias("AME"))
    ordered = regression.caption_terms(effects, exclude=["province9"])
    # the terms of one model
    return ordered.withColumn("position", F.row_number().over(Window.orderBy("prefix_order", "AME", "caption")))


register(
    "pseudo_r2",
    "value:8",
    lambda t: regression.fit_table({"m": regression.logit(_one_factor(t, "high"), "high", _GENDER)}, t.spark)
    .filter("statistic = 'pseudo_r2'"),
    f"""{_P} SELECT 1 - (n1 * (p1 * ln(p1) + (1 - p1) * ln(1 - p1)) + n2 * (p2 * ln(p2) + (1 - p2) * ln(1 - p2)))
          / (n * (p * ln(p) + (1 - p) * ln(1 - p))) AS value FROM s""",
)
register(
    "ame_one_factor",
    "factor:s AME:6 std_error:6 lower:6 upper:6 effect:s",
    lambda t: regression.average_marginal_effects(
        regression.logit(_one_factor(t, "high"), "high", _GENDER), _one_factor(t, "high")
    ),
    f"""{_P} SELECT 'gender_hhhFemale' AS factor, d AS "AME", e AS std_error, d - 1.959963984540054e0 * e AS lower,
          d + 1.959963984540054e0 * e AS upper, CASE WHEN d < 0 THEN 'Negative' ELSE 'Positive' END AS effect
        FROM (SELECT p2 - p1 AS d, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS e FROM s)""",
)
register(
    "simple_line",
    "slope:12 intercept:8 r2:8",
    lambda t: regression.simple_line(t.mart, _B, "hh_expenditures_USD_2014"),
    f"SELECT regr_slope({_B}, hh_expenditures_USD_2014) AS slope, regr_intercept({_B}, hh_expenditures_USD_2014) AS intercept, regr_r2({_B}, hh_expenditures_USD_2014) AS r2 FROM mart",
)
register(
    "errors_mse_mae",
    "mse:4 mae:5 rmse:5",
    lambda t: regression.prediction_errors(t.hh.withColumn("p", F.col("hh_size") * 1000.0), "income", "p"),
    """SELECT avg(g * g) AS mse, avg(abs(g)) AS mae, sqrt(avg(g * g)) AS rmse
       FROM (SELECT income - hh_size * 1000e0 AS g FROM hh)""",
)


def _transfer_one_factor(t):
    """Three quarters of the households are the first survey, the rest the second."""
    people = splits.hash_split(_one_factor(t, "y"), "hh_id", out="first")
    return regression.transfer_quality(
        regression.ols(people.filter("first"), "y", _GENDER), people.filter("NOT first")
    )


_FIRST = "((hh_id % 1000003) * 2654435761 % 4294967296) % 1000 < 750"
register(
    "transfer_one_factor",
    "mse:3 mae:5 r2_refit:8 r2_predictive:8",
    _transfer_one_factor,
    f"""WITH m AS (SELECT gender_hhh, avg(income) AS p FROM hh WHERE {_FIRST} GROUP BY 1),
       b AS (SELECT h.income AS y, m.p, avg(h.income) OVER (PARTITION BY h.gender_hhh) AS own, avg(h.income) OVER () AS mu
             FROM hh h JOIN m USING (gender_hhh) WHERE NOT ({_FIRST}))
       SELECT avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, 1 - sum((y - own) ** 2) / sum((y - mu) ** 2) AS r2_refit,
         1 - sum((y - p) ** 2) / sum((y - mu) ** 2) AS r2_predictive FROM b""",
)
_COEF = "term:s estimate:6 std_error:6 statistic:4 p_value:6"
register("ols_full", _COEF, lambda t: regression.ols(model_frame(t), _B, full_spec()).table(t.spark))


def _logit_frame(t):
    """Model rows with the tenth most affected, overall and within each quintile.

    Rows are ranked by their codes, without the mart's other columns; labels come after.
    """
    needed = {"hh_id", _B, "Income_Group_5", "hh_expenditures_USD_2014", "electricitycon", "electricitymains"}
    needed |= {*full_spec().predictors, *[s.column for s in MODEL_SPECS]}
    coded = t.mart.select(*[c for c in t.mart.columns if c in needed])
    overall = regression.top_decile_flag(coded, _B, out="burden_decile")
    both = regression.top_decile_flag(overall, _B, by=["Income_Group_5"], out="decile_within")
    flags = {c: F.col(c).cast("double") for c in ("burden_decile", "decile_within")}
    return stage(model_frame(t, both).select("hh_id", _B, "Income_Group_5", *full_spec().predictors, *flags).withColumns(flags))


@query("logit_full", "variable_name:s intercept:4 standard_error:4 signif:s")
def _(t):
    model = regression.logit(_logit_frame(t), "burden_decile", full_spec())
    return regression.star_table(model.table(t.spark))


@query("logit_side_by_side", "term:s " + " ".join(f"{n}:4" for n in ("full", "q1", "q2", "q3", "q4", "q5")))
def _(t):
    models = {"full": ("burden_decile", F.lit(True))}
    for q in range(1, 6):
        models[f"q{q}"] = ("decile_within", F.col("Income_Group_5") == q)
    return regression.compare_models(regression.logits(_logit_frame(t), models, full_spec()), t.spark)


@query("ame_full", "caption:s prefix_order:i AME:6 lower:6 upper:6 effect:s")
def _(t):
    frame = _logit_frame(t)
    model = regression.logit(frame, "burden_decile", full_spec().without("electricityfree"))
    effects = regression.average_marginal_effects(model, frame)
    return regression.caption_terms(effects, exclude=["heatingsourcewaterNo Access"])


def _transfer_spec() -> ModelSpec:
    levels = {**_LEVELS, "electricitymains": TRANSFER_MAINS_LEVELS}
    return ModelSpec(("log_expenditures_hh",), tuple(Factor(c, levels[c]) for c in TRANSFER_FACTORS))


@query("transfer_full", "sample:s mse:8 mae:8 r2_refit:6 r2_predictive:6")
def _(t):
    spent = F.ln("hh_expenditures_USD_2014").alias("log_expenditures_hh")
    mart = t.mart.select("hh_id", _B, spent, "electricitycon", *TRANSFER_FACTORS)
    people = stage(splits.hash_split(mart, "hh_id", out="first"))
    first = energy.transfer_factors(people.filter("first"), "A")
    split = stage(splits.stratified_split(first, _B, "hh_id"))
    model = regression.ols(split.filter("train"), _B, _transfer_spec())
    held_out = regression.transfer_quality(model, split.filter("NOT train"))
    second = regression.transfer_quality(model, energy.transfer_factors(people.filter("NOT first"), "B"))
    return held_out.withColumn("sample", F.lit("held out")).unionByName(
        second.withColumn("sample", F.lit("second survey"))
    )


# --- forest and clusters -------------------------------------------------------------------
_COLS = ("log_expenditures", *INDICATORS)


def indicator_frame(t):
    mart = energy.with_electricity_source(t.mart).withColumn(
        "log_expenditures", F.ln("hh_expenditures_USD_2014")
    )
    hot = codebook.one_hot(mart, INDICATORS, ["hh_id", _B, "log_expenditures"])
    return hot.na.drop("any")


# The search fits 10 mtry x 10 folds; the final forests have the usual 500 trees.
SEARCH_TREES = 20


@query("forest_cv", "mtry:i rmse:8")
def _(t):
    train = splits.hash_split(indicator_frame(t), "hh_id").filter("train")
    model = learning.forest_cv(train, _B, _COLS, trees=SEARCH_TREES)
    return learning.cv_table(model, t.spark)


@query("forest_importance", "variable:s caption:s overall:6")
def _(t):
    model = learning.forest(indicator_frame(t), _B, _COLS, mtry=3)
    return learning.importance(model, _COLS, t.spark)


@query("forest_predictions", "mse:8 mae:8 rmse:8")
def _(t):
    split = splits.hash_split(indicator_frame(t), "hh_id")
    model = learning.forest(split.filter("train"), _B, _COLS, mtry=3)
    scored = learning.predict_with_truth(model, split.filter("NOT train"), _COLS, _B, "hh_id")
    return regression.prediction_errors(scored, "Actual", "Predicted")


@query("kmeans4", "cluster:i n:i")
def _(t):
    scaled = stage(learning.zscore(indicator_frame(t), _COLS))
    return learning.cluster_sizes(learning.kmeans(scaled, _COLS, 4)[1])


@query("kmeans4_profile", "variable:s " + " ".join(f"{i}:5" for i in range(1, 5)))
def _(t):
    frame = stage(indicator_frame(t))
    labels = learning.kmeans(learning.zscore(frame, _COLS), _COLS, 4)[1].select("hh_id", "cluster")
    return learning.cluster_profile(frame.join(labels, "hh_id"), [_B, *_COLS], range(1, 5), [_B])


@query("silhouette_by_k", "k:i silhouette:6")
def _(t):
    return learning.silhouettes(indicator_frame(t), _COLS)


@query("elbow_by_k", "k:i within_ss:4")
def _(t):
    return learning.elbow(indicator_frame(t), _COLS)


# K-means from given centres, pass by pass: the SQL spells the same passes out
_STEP_COLS = ("hh_size", "province", "log_income")
_STEP_STARTS = [(1.0, 1.0, 6.0), (6.5, 7.25, 9.0), (3.0, 4.125, 8.0), (9.0, 2.0, 7.0)]
_STEP_PASSES = 6


def _step_rows(t):
    return stage(clusters.complete(t.hh.filter("income > 0").withColumn("log_income", F.ln("income")), _STEP_COLS))


def _steps_sql() -> str:
    starts = ", ".join(
        f"({k}, {i}, {', '.join(f'{v}e0' for v in centre)})" for k in (2, 3, 4) for i, centre in enumerate(_STEP_STARTS[:k], 1)
    )
    names = ", ".join(_STEP_COLS)
    gap = " + ".join(f"(x.{c} - m.{c}) * (x.{c} - m.{c})" for c in _STEP_COLS)
    means = ", ".join(f"coalesce(avg(a.{c}), any_value(m.{c})) AS {c}" for c in _STEP_COLS)
    parts = [
        "x AS (SELECT hh_id, hh_size::DOUBLE AS hh_size, province::DOUBLE AS province, ln(income) AS log_income FROM hh"
        " WHERE income > 0 AND hh_size IS NOT NULL AND province IS NOT NULL)",
        f"m0 AS (SELECT * FROM (VALUES {starts}) v(k, cluster, {names}))",
    ]
    for i in range(_STEP_PASSES):
        parts.append(
            f"a{i} AS (SELECT * FROM (SELECT m.k, m.cluster, x.*, {gap} AS gap,"
            f" row_number() OVER (PARTITION BY m.k, x.hh_id ORDER BY {gap}, m.cluster) AS place FROM x CROSS JOIN m{i} m) p WHERE place = 1)"
        )
        parts.append(
            f"m{i + 1} AS (SELECT m.k, m.cluster, {means} FROM m{i} m LEFT JOIN a{i} a ON a.k = m.k AND a.cluster = m.cluster GROUP BY m.k, m.cluster)"
        )
    last = _STEP_PASSES - 1
    sizes = f"SELECT k, cluster, count(*) AS n, sum(gap) AS within_ss FROM a{last} GROUP BY k, cluster"
    return (
        f"WITH {', '.join(parts)} SELECT m.k, m.cluster, coalesce(s.n, 0) AS n, coalesce(s.within_ss, 0e0) AS within_ss,"
        f" {', '.join(f'm.{c}' for c in _STEP_COLS)} FROM m{last} m LEFT JOIN ({sizes}) s ON s.k = m.k AND s.cluster = m.cluster"
    )


@query("kmeans_steps", "k:i cluster:i n:i within_ss:4 hh_size:6 province:6 log_income:6", _steps_sql())
def _(t):
    starts = {k: np.array(_STEP_STARTS[:k]) for k in (2, 3, 4)}
    fits = clusters.lloyd(_step_rows(t), _STEP_COLS, starts, passes=_STEP_PASSES, tol=-1.0)
    return clusters.cluster_table(t.spark, fits, _STEP_COLS)


_NUM = ("hh_size", "income", "province")
register(
    "elbow_k1",
    "k:i within_ss:0",
    lambda t: learning.total_sum_of_squares(t.hh, _NUM),
    f"SELECT 1 AS k, (count(*) - 1) * ({' + '.join(f'var_samp({c})' for c in _NUM)}) AS within_ss FROM hh",
)
register(
    "zscore",
    "hh_id:i hh_size:8 income:8 province:8 constant:8",
    lambda t: learning.zscore(t.hh.withColumn("constant", F.lit(5.0)), [*_NUM, "constant"]),
    "SELECT hh_id, "
    + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in _NUM)
    + ", 0e0 AS constant FROM hh",
)
_CENTRES = [(1.0, 1.0), (3.0, 2.0), (5.0, 4.0)]
_DIST = [f"((hh_size - {a}) * (hh_size - {a}) + (ethnicity_hhh - {b}) * (ethnicity_hhh - {b}))" for a, b in _CENTRES]
_ASSIGN = "SELECT *, CASE " + " ".join(
    f"WHEN {d} = least({', '.join(_DIST)}) THEN {i}" for i, d in enumerate(_DIST, 1)
) + " END AS cluster FROM hh"


def _assigned(t):
    return t.hh.withColumn("cluster", learning.nearest_centre(["hh_size", "ethnicity_hhh"], _CENTRES))


# labellings: by fixed centres, and by size alone
_SILHOUETTE = f"""WITH p AS (SELECT hh_id, hh_size::DOUBLE AS a, ethnicity_hhh::DOUBLE AS b, cluster, CASE WHEN hh_size > 3 THEN 2 ELSE 1 END AS halves
    FROM ({_ASSIGN}) z WHERE hh_size IS NOT NULL AND ethnicity_hhh IS NOT NULL),
  l AS (SELECT 1 AS k, hh_id, a, b, cluster FROM p UNION ALL SELECT 2, hh_id, a, b, halves FROM p),
  sums AS (SELECT x.k, x.hh_id, x.cluster AS own, y.cluster, sum(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS d, count(*) AS n
    FROM l x JOIN l y ON x.k = y.k GROUP BY 1, 2, 3, 4),
  w AS (SELECT k, hh_id, max(CASE WHEN own = cluster THEN n END) AS n, max(CASE WHEN own = cluster AND n > 1 THEN d / (n - 1) END) AS near,
    min(CASE WHEN own <> cluster THEN d / n END) AS other FROM sums GROUP BY 1, 2)
  SELECT k, avg(CASE WHEN n = 1 OR other IS NULL OR near = other THEN 0e0 ELSE (other - near) / greatest(other, near) END) AS silhouette FROM w GROUP BY 1"""


@query("silhouette_fixed_labels", "k:i silhouette:6", _SILHOUETTE)
def _(t):
    rows = _assigned(t).na.drop("any", subset=["hh_size", "ethnicity_hhh"])
    halves = F.when(F.col("hh_size") > 3, 2).otherwise(1)
    x = F.array(*[F.col(c).cast("double") for c in ("hh_size", "ethnicity_hhh")])
    points = rows.select(x.alias("x"), F.array(F.col("cluster").cast("int"), halves).alias("labels"))
    return clusters.silhouette(points, 2).withColumnRenamed("model", "k")


register("assign_fixed_centres", "hh_id:i cluster:i", _assigned, f"SELECT hh_id, cluster FROM ({_ASSIGN}) a")
_PROFILED = ("hh_size", "income", "ethnicity_hhh")


def _profile_sql(scaled: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, "
        + ", ".join(
            f"avg({c}) FILTER (cluster = {i}){' * 100' if c == scaled else ''} AS \"{i}\"" for i in range(1, 4)
        )
        + f" FROM ({_ASSIGN}) a"
        for c in _PROFILED
    )


_P3 = "variable:s " + " ".join(f"{i}:5" for i in range(1, 4))
register("cluster_sizes", "cluster:i n:i", lambda t: learning.cluster_sizes(_assigned(t)),
         f"SELECT cluster, count(*) AS n FROM ({_ASSIGN}) a GROUP BY 1")
register("cluster_profile", _P3,
         lambda t: learning.cluster_profile(_assigned(t), _PROFILED, range(1, 4), ["ethnicity_hhh"]),
         _profile_sql("ethnicity_hhh"))
register("distinctive_variables", _P3,
         lambda t: learning.distinctive(learning.cluster_profile(_assigned(t), _PROFILED, range(1, 4)), 4.0),
         f'SELECT * FROM ({_profile_sql("")}) p WHERE greatest("1", "2", "3") > 4')
