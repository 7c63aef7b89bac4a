"""Weighted statistics, data quality, spending, carbon and the mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join
from levyscape.operators import quality, ranking, splits
from levyscape.operators import weighted as wq
from levyscape.plans import carbon, distribution, households, mart, spending
from levyscape.sources.staging import stage
from workload.bindings import CATEGORIES, COUNTRY, FUELS
from workload.oracle import BOX, bins_sql, box_sql, quantile_sql
from workload.registry import query, register

# --- weighted statistics -------------------------------------------------------------
_Q = "SELECT * FROM quirky"
_PROBS, _NAMES = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0], ["q00", "q05", "q50", "q95", "q99", "q100"]
_QSPEC = " ".join(f"{n}:6" for n in _NAMES)
_ODD = "CASE l_linenumber WHEN 4 THEN -w WHEN 5 THEN double('Infinity') WHEN 6 THEN double('NaN') WHEN 7 THEN NULL ELSE w END"

register(
    "weighted_quantile_grouped",
    f"l_returnflag:s l_linestatus:s {_QSPEC}",
    lambda t: wq.weighted_quantile(t.quirky, "x", "w", _PROBS, ["l_returnflag", "l_linestatus"]),
    quantile_sql(_Q, "x", "w", _PROBS, _NAMES, ["l_returnflag", "l_linestatus"]),
)
register(
    "weighted_quantile_many_groups",
    "l_orderkey:i q50:6 q95:6",
    lambda t: wq.weighted_quantile(t.quirky, "x", "w", [0.5, 0.95], ["l_orderkey"]),
    quantile_sql(_Q, "x", "w", [0.5, 0.95], ["q50", "q95"], ["l_orderkey"]),
)
register(
    "weighted_quantile_global",
    _QSPEC,
    lambda t: wq.weighted_quantile(t.quirky, "x", "w", _PROBS),
    quantile_sql(_Q, "x", "w", _PROBS, _NAMES),
)
register(
    "weighted_quantile_point_masses",
    f"l_linestatus:s {_QSPEC}",
    lambda t: wq.weighted_quantile(t.quirky, "q", "w", _PROBS, ["l_linestatus"]),
    quantile_sql(_Q, "q", "w", _PROBS, _NAMES, ["l_linestatus"]),
)
register(
    "weighted_mean_by_group",
    "l_returnflag:s mean:6",
    lambda t: wq.weighted_mean(t.quirky, "x", "w", ["l_returnflag"]),
    "SELECT l_returnflag, sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) AS mean FROM quirky GROUP BY 1",
)
_BOXSPEC = " ".join(f"{n}:6" for n in [*BOX[1], "mean"])
register(
    "weighted_box_by_group",
    f"l_returnflag:s {_BOXSPEC}",
    lambda t: wq.weighted_box(t.quirky, "x", "w", ["l_returnflag"]),
    box_sql(_Q, "x", "w", ["l_returnflag"]),
)
register(
    "weighted_quantile_survey_weights",
    f"l_returnflag:s {_QSPEC}",
    lambda t: wq.weighted_quantile(t.tenths.repartition(3), "x", "w", _PROBS, ["l_returnflag"]),
    quantile_sql("SELECT * FROM tenths", "x", "w", _PROBS, _NAMES, ["l_returnflag"]),
)
register(
    "weighted_quantile_tiny_weights",
    f"l_returnflag:s l_linestatus:s {_QSPEC} mean:6",
    lambda t: wq.weighted_stats(
        t.quirky.withColumn("w", F.col("w") * 4e-10), "x", "w", _PROBS, _NAMES, ["l_returnflag", "l_linestatus"], mean="mean"
    ),
    quantile_sql("SELECT * REPLACE (w * 4e-10 AS w) FROM quirky", "x", "w", _PROBS, _NAMES, ["l_returnflag", "l_linestatus"], "mean", places=24),
)
register(
    "weighted_quantile_large_weights",
    f"l_returnflag:s {_QSPEC}",
    lambda t: wq.weighted_quantile(t.quirky.withColumn("w", F.col("w") * 1e9), "x", "w", _PROBS, ["l_returnflag"]),
    quantile_sql("SELECT * REPLACE (w * 1e9 AS w) FROM quirky", "x", "w", _PROBS, _NAMES, ["l_returnflag"]),
)
register(
    "weighted_mean_odd_weights",
    "l_returnflag:s mean:6 median:6",
    # negative, infinite and NaN weights count for neither
    lambda t: t.quirky.withColumn("w", F.expr(_ODD)).transform(
        lambda df: wq.weighted_mean(df, "x", "w", ["l_returnflag"]).join(wq.weighted_quantile(df, "x", "w", [0.5], ["l_returnflag"], ["median"]), "l_returnflag")
    ),
    f"""WITH odd AS (SELECT * REPLACE (CASE WHEN l_linenumber < 4 THEN w END AS w) FROM quirky)
    SELECT l_returnflag, mean, median FROM (SELECT l_returnflag, sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) AS mean FROM odd GROUP BY 1)
      JOIN ({quantile_sql("SELECT * FROM odd", "x", "w", [0.5], ["median"], ["l_returnflag"])}) USING (l_returnflag)""",
)
register(
    "weighted_box_with_nan",
    f"l_returnflag:s l_linestatus:s {_BOXSPEC}",
    lambda t: wq.weighted_box(t.shares_of_nothing, "x", "w", ["l_returnflag", "l_linestatus"]),
    box_sql("SELECT * FROM shares_of_nothing", "x", "w", ["l_returnflag", "l_linestatus"]),
)
register(
    "weighted_mean_with_nan",
    "l_returnflag:s mean:6",
    lambda t: wq.weighted_mean(t.shares_of_nothing, "x", "w", ["l_returnflag"]),
    "SELECT l_returnflag, sum(w * x) / sum(w) AS mean FROM shares_of_nothing WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1",
)
register(
    "ranked_with_nulls",
    "l_orderkey:i l_linenumber:i rn:i",
    lambda t: ranking.ranked(t.ranks, "x", "tie"),
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY x NULLS FIRST, tie NULLS FIRST) AS rn FROM ranks""",
)
register(
    "surrogate_ids_text",
    "item_code:s id:i",
    lambda t: ranking.surrogate_index(t.lines, "item_code", "id"),
    """SELECT item_code, row_number() OVER (ORDER BY item_code NULLS FIRST) AS id FROM (SELECT DISTINCT item_code FROM lines)""",
)
register(
    "hash_split_text",
    "item_code:s train:b",
    lambda t: splits.hash_split(t.codes.select("item_code"), "item_code"),
    """SELECT item_code, CAST('0x' || substr(md5(item_code), 1, 8) AS BIGINT) % 1000 < 750 AS train FROM codes""",
)
for _k in (2, 3, 5, 10):
    register(
        f"weighted_bins_{_k}",
        f"hh_id:i bin_{_k}:i",
        lambda t, k=_k: wq.weighted_bins(t.hh, "income", "hh_weights", [k]),
        bins_sql("SELECT * FROM hh", "income", "hh_weights", [_k], "bin_", "hh_id"),
    )
register(
    "weighted_bins_collapsed",
    "l_orderkey:i l_linenumber:i q:4 bin_5:i bin_10:i",
    lambda t: wq.weighted_bins(
        t.quirky.withColumn("q", F.greatest(F.col("q"), F.lit(30.0))), "q", "w", [5, 10]
    ),
    bins_sql("SELECT l_orderkey, l_linenumber, greatest(q, 30e0) AS q, w FROM quirky", "q", "w", [5, 10], "bin_",
             "l_orderkey, l_linenumber, q"),
)
_FLAGS = quantile_sql(_Q, "x", "w", [0.95, 0.99], ["o95", "o99"], ["l_returnflag"])
register(
    "flag_outliers",
    "l_orderkey:i l_linenumber:i outlier_95:4 outlier_99:4 flag_outlier_95:i flag_outlier_99:i",
    lambda t: wq.flag_outliers(t.quirky, "x", "w", ["l_returnflag"]),
    f"""SELECT q.l_orderkey, q.l_linenumber, f.o95 AS outlier_95, f.o99 AS outlier_99,
          CAST(q.x >= f.o95 AS INT) AS flag_outlier_95, CAST(q.x >= f.o99 AS INT) AS flag_outlier_99
        FROM quirky q LEFT JOIN ({_FLAGS}) f ON q.l_returnflag = f.l_returnflag""",
)
_MED = quantile_sql(_Q, "x", "w", [0.99, 0.5], ["cap", "mid"], ["l_returnflag"])
register(
    "replace_outliers",
    "l_orderkey:i l_linenumber:i x:4",
    lambda t: wq.replace_outliers(t.quirky, "x", "w", ["l_returnflag"]),
    f"""SELECT q.l_orderkey, q.l_linenumber, CASE WHEN q.x >= f.cap THEN f.mid ELSE q.x END AS x
        FROM quirky q LEFT JOIN ({_MED}) f ON q.l_returnflag = f.l_returnflag""",
)

# --- data quality ----------------------------------------------------------------------
register(
    "dq_coverage",
    "n_left:i n_right:i only_left:i only_right:i",
    lambda t: quality.key_coverage(t.hh, t.assets, "hh_id"),
    """SELECT (SELECT count(DISTINCT hh_id) FROM hh) AS n_left, (SELECT count(DISTINCT hh_id) FROM assets) AS n_right,
       (SELECT count(*) FROM (SELECT hh_id FROM hh EXCEPT SELECT hh_id FROM assets)) AS only_left,
       (SELECT count(*) FROM (SELECT hh_id FROM assets EXCEPT SELECT hh_id FROM hh)) AS only_right""",
)
_ATTR = ["hh_size", "province", "urban_1", "gender_hhh", "electricitymains"]
register(
    "dq_dup_rows",
    "hh_id:i number:i",
    lambda t: quality.duplicate_rows(t.hh.select("hh_id", *_ATTR), "hh_id"),
    f"SELECT hh_id, number FROM (SELECT hh_id, count(*) OVER (PARTITION BY {', '.join(_ATTR)}) AS number FROM hh) WHERE number > 1",
)
register(
    "dq_dup_baskets",
    "hh_id:i number:i",
    lambda t: quality.duplicate_baskets(t.baskets, "hh_id", "item_code", "expenditures_year"),
    """SELECT hh_id, number FROM (SELECT hh_id, count(*) OVER (PARTITION BY basket) AS number FROM
         (SELECT hh_id, list({'i': item_code, 'v': expenditures_year} ORDER BY item_code, expenditures_year) AS basket
          FROM baskets GROUP BY hh_id)) WHERE number > 1""",
)
register(
    "dq_shared_values",
    "hh_id:i",
    lambda t: quality.shared_values(t.priced, "hh_id", "item_code", "expenditures_year"),
    """SELECT hh_id FROM (SELECT hh_id, CASE WHEN count(*) OVER (PARTITION BY item_code, expenditures_year) > 1 THEN 1 ELSE 0 END AS f
       FROM priced WHERE expenditures_year IS NOT NULL AND expenditures_year <> 0) GROUP BY hh_id HAVING avg(f) = 1""",
)
register(
    "dq_dup_totals",
    "hh_id:i hh_expenditures:2 number:i",
    lambda t: quality.duplicate_totals(t.priced, "hh_id", "expenditures_year"),
    """SELECT * FROM (SELECT hh_id, s AS hh_expenditures, count(*) OVER (PARTITION BY s) AS number FROM
       (SELECT hh_id, sum(expenditures_year) AS s FROM priced WHERE expenditures_year <> 0 GROUP BY hh_id)) WHERE number > 1""",
)
register(
    "dq_negative",
    "hh_id:i hh_expenditures:2",
    lambda t: quality.negative_totals(t.priced, "hh_id", "expenditures_year"),
    "SELECT hh_id, sum(expenditures_year) AS hh_expenditures FROM priced WHERE expenditures_year <> 0 GROUP BY hh_id HAVING sum(expenditures_year) < 0",
)
register(
    "dq_drill_down",
    "hh_id:i item_code:s expenditures_year:2",
    lambda t: quality.drill_down(
        t.priced, quality.negative_totals(t.priced, "hh_id", "expenditures_year"), "hh_id"
    ),
    """SELECT * FROM priced WHERE hh_id IN
       (SELECT hh_id FROM priced WHERE expenditures_year <> 0 GROUP BY hh_id HAVING sum(expenditures_year) < 0)""",
)
register(
    "dq_dup_lines",
    "hh_id:i item_code:s expenditures_year:4 number:i",
    lambda t: quality.duplicate_lines(t.lines, ["hh_id", "item_code"]),
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY hh_id, item_code) AS number FROM lines) WHERE number > 1",
)
register(
    "dq_unmatched",
    "item_code:s",
    lambda t: quality.unmatched_codes(t.lines, t.categories, "item_code"),
    "SELECT DISTINCT item_code FROM lines WHERE item_code NOT IN (SELECT item_code FROM categories)",
)
register(
    "dq_ambiguous",
    "n:i p_type:s",
    lambda t: quality.ambiguous_codes(t.brands.select("p_type"), "p_type"),
    "SELECT p_type, count(*) AS n FROM brands GROUP BY p_type HAVING count(*) <> 1",
)
register(
    "dq_two_sided",
    "item_code:s category:s fuel:s",
    lambda t: quality.two_sided_coverage(
        t.categories.filter("category = 'Energy'"), t.fuels, "item_code", "category", "fuel"
    ),
    """SELECT coalesce(c.item_code, f.item_code) AS item_code, c.category, f.fuel
       FROM (SELECT * FROM categories WHERE category = 'Energy') c FULL JOIN fuel_pairs f ON c.item_code = f.item_code
       WHERE c.category IS NULL OR f.fuel IS NULL""",
)

# --- households and spending ---------------------------------------------------------
_FRAME = ["hh_size", "province", "urban_1", "electricitycon", "education_hhh", "own_stove", "own_vehicle", "gender_hhh"]
register(
    "household_frame",
    " ".join(["hh_id:i", *[f"{c}:i" for c in _FRAME], "hh_weights:2", "adult:i", "child:i", "adulteq:4"]),
    lambda t: households.household_frame(t.house, t.persons, t.assets, with_composition=True),
    f"""SELECT f.hh_id, {", ".join(f"f.{c}" for c in _FRAME)}, f.hh_weights, c.adult, c.child,
          c.adult * 5e-1 + 5e-1 + c.child * 3e-1 AS adulteq
        FROM frame f LEFT JOIN (SELECT hh_id, count(*) FILTER (age >= 18) AS adult, count(*) FILTER (age < 18) AS child
                                FROM persons GROUP BY hh_id) c USING (hh_id)""",
)
register(
    "composition",
    "hh_id:i adult:i child:i",
    lambda t: households.composition(t.persons),
    "SELECT hh_id, count(*) FILTER (age >= 18) AS adult, count(*) FILTER (age < 18) AS child FROM persons GROUP BY hh_id",
)
register(
    "adult_equivalents",
    "hh_id:i adulteq:4",
    lambda t: households.adult_equivalents(households.composition(t.persons)),
    "SELECT hh_id, count(*) FILTER (age >= 18) * 5e-1 + 5e-1 + count(*) FILTER (age < 18) * 3e-1 AS adulteq FROM persons GROUP BY hh_id",
)
register(
    "household_heads",
    "hh_id:i education_hhh:i",
    lambda t: households.heads(t.persons, ["education_hhh"]),
    "SELECT * FROM heads",
)
register("item_spending", "hh_id:i item_code:s expenditures_year:4", lambda t: t.lines, "SELECT * FROM lines")
register(
    "winsorise_items",
    "hh_id:i item_code:s expenditures:4",
    lambda t: t.cleaned,
    "SELECT hh_id, item_code, expenditures FROM cleaned",
)
_TOT = "SELECT hh_id, sum(expenditures) AS total_expenditures, max(hh_weights) AS hh_weights FROM cleaned GROUP BY hh_id"
register(
    "total_outliers",
    "hh_id:i total_expenditures:7 outlier_95:7 outlier_99:7",
    lambda t: spending.total_outliers(t.cleaned),
    f"""SELECT s.hh_id, s.total_expenditures, o.outlier_95, o.outlier_99 FROM ({_TOT}) s,
        ({quantile_sql(_TOT, "total_expenditures", "hh_weights", [0.95, 0.99], ["outlier_95", "outlier_99"])}) o
        WHERE s.total_expenditures >= o.outlier_99""",
)
register("concordance_long", "GTAP:s item_code:s", lambda t: t.sector_map, "SELECT * FROM sector_map")
register("sector_spending", "hh_id:i item_code:s GTAP:s expenditures:4",
         lambda t: spending.sector_spending(t.cleaned, t.sector_map),
         "SELECT hh_id, item_code, GTAP, expenditures FROM secexp")
_SHARES = " ".join(f"share_{c}:6" for c in CATEGORIES)
register("category_shares", f"hh_id:i {_SHARES}",
         lambda t: spending.category_shares(t.cleaned, t.categories, CATEGORIES), "SELECT * FROM shares")
_FUELS = " ".join(f"exp_LCU_{f}:7" for f in FUELS)
register("fuel_spending", f"hh_id:i {_FUELS}",
         lambda t: spending.fuel_spending(t.cleaned, t.fuels, FUELS), "SELECT * FROM fuel_sums")
register(
    "expenditure_bins",
    "hh_id:i hh_expenditures:7 hh_expenditures_pc:8 Income_Group_2:i Income_Group_3:i Income_Group_5:i Income_Group_10:i",
    lambda t: spending.expenditure_bins(spending.sector_spending(t.cleaned, t.sector_map), t.hh),
    "SELECT * FROM bins",
)
register(
    "to_reference_currency",
    "hh_id:i GTAP:s expenditures_USD_2014:3 hh_expenditures_USD_2014:3",
    lambda t: spending.to_reference_currency(
        spending.sector_spending(t.cleaned, t.sector_map), t.fx, COUNTRY
    ),
    "SELECT p.hh_id, p.GTAP, p.expenditures_USD_2014, u.hh_expenditures_USD_2014 FROM per_sector p JOIN usd_totals u USING (hh_id)",
)
register("household_totals_lcu", "hh_id:i hh_expenditures_LCU:7",
         lambda t: spending.totals_lcu(spending.sector_spending(t.cleaned, t.sector_map)),
         "SELECT hh_id, hh_expenditures AS hh_expenditures_LCU FROM usd_totals")
register(
    "fuel_mart",
    f"hh_id:i {_FUELS} hh_expenditures_LCU:7",
    lambda t: mart.fuel_mart(
        spending.fuel_spending(t.cleaned, t.fuels, FUELS),
        spending.totals_lcu(spending.sector_spending(t.cleaned, t.sector_map)),
    ),
    "SELECT f.*, u.hh_expenditures AS hh_expenditures_LCU FROM fuel_sums f LEFT JOIN usd_totals u USING (hh_id)",
)
_CPI = {
    "cpi_long": """SELECT Country, CAST(substr(k, 2) AS INT) AS y, TRY_CAST(v AS DOUBLE) / 100 AS r
        FROM (UNPIVOT cpi_sheet ON y1995, y1996, y1997, y1998, y1999, y2000, y2001 INTO NAME k VALUE v)""",
    "factors": """SELECT b.Country, b.y AS base_year, CASE WHEN count(r.y) <> count(r.r) THEN NULL
          WHEN b.y > 1998 THEN 1 / exp(coalesce(sum(ln(1 + r.r)), 0)) ELSE exp(coalesce(sum(ln(1 + r.r)), 0)) END AS factor
        FROM cpi_long b LEFT JOIN cpi_long r ON r.Country = b.Country AND r.y > least(b.y, 1998) AND r.y <= greatest(b.y, 1998)
        GROUP BY b.Country, b.y""",
}
register("price_factors", "Country:s base_year:i factor:9",
         lambda t: spending.price_factors(t.cpi, 1998), "SELECT * FROM factors",
         {**_CPI, "factors": _CPI["factors"] + " -- cpi_sheet\n"})


@query(
    "price_adjust",
    "Country:s base_year:i adjusted:0",
    """SELECT n.n_name AS Country, year(o.o_orderdate) AS base_year, sum(o.o_totalprice * f.factor) AS adjusted
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN factors f ON f.Country = n.n_name AND f.base_year = year(o.o_orderdate)
       GROUP BY 1, 2""",
    {**_CPI, "factors": _CPI["factors"] + " -- cpi_sheet\n"},
)
def _(t):
    factors = spending.price_factors(t.cpi, 1998)  # an unknown factor leaves the amount unknown
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("Country")
    )
    priced = t.orders.select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("base_year"))
    return (
        priced.join(place, "o_custkey")
        .groupBy("Country", "base_year")
        .agg(F.sum("o_totalprice").alias("s"))
        .join(factors, ["Country", "base_year"], "left")
        .select("Country", "base_year", (F.col("s") * F.col("factor")).alias("adjusted"))
    )


# --- carbon and the mart ---------------------------------------------------------------
_T = ("global", "national", "electricity", "transport")
register(
    "carbon_intensity",
    "GTAP:s " + " ".join(f"CO2_t_per_dollar_{n}:9" for n in _T),
    lambda t: carbon.carbon_intensity(t.sectors, t.emissions),
    f"SELECT GTAP, {', '.join(f'i_{n} AS CO2_t_per_dollar_{n}' for n in _T)} FROM intensity",
)


def _footprint(t):
    usd = spending.to_reference_currency(
        spending.sector_spending(t.cleaned, t.sector_map), t.fx, COUNTRY
    )
    return carbon.carbon_footprint(usd, carbon.carbon_intensity(t.sectors, t.emissions))


_TONNES = " ".join(f"CO2_t_{n}:4" for n in _T)
_COST = " ".join(f"exp_CO2_{n}:3 burden_CO2_{n}:6" for n in _T)
register("footprint", f"hh_id:i hh_expenditures_USD_2014:3 {_TONNES}", _footprint, "SELECT * FROM fp")
register("incidence", f"hh_id:i {_TONNES} {_COST}", lambda t: carbon.incidence(_footprint(t)), "SELECT * FROM inc")
register(
    "high_footprint_items",
    "hh_id:i item_code:s expenditures:4",
    lambda t: carbon.high_footprint_detail(
        _footprint(t), 700.0, t.cleaned.select("hh_id", "item_code", "expenditures")
    )[0],
    "SELECT hh_id, item_code, expenditures FROM cleaned WHERE hh_id IN (SELECT hh_id FROM fp WHERE CO2_t_national > 700)",
)
_MART = f"hh_id:i hh_expenditures_USD_2014:3 {_TONNES} {_COST} Income_Group_5:i Income_Group_10:i {_SHARES} {_FUELS} hh_size:i hh_weights:2 province:i education_hhh:i own_stove:i"
register("final_mart", _MART, lambda t: mart.build_mart(t.survey, on_unmatched="drop"), "SELECT * FROM mart")
# a second survey: several lines on one item are one purchase, prices are carried over the years
_B_SURVEY = {
    **_CPI,
    "factors": _CPI["factors"].replace("1998", "2001") + " -- cpi_sheet\n",
    "lines": "SELECT i.hh_id, c.item_code, sum(i.expenditures_year) AS expenditures_year FROM items i JOIN codes c USING (coicop) "
    "WHERE i.expenditures_year IS NOT NULL AND i.hh_id IS NOT NULL AND c.item_code IS NOT NULL GROUP BY 1, 2",
    "rate": f"SELECT TRY_CAST(exchange_rate AS DOUBLE) * (SELECT factor FROM factors WHERE Country = '{COUNTRY}' AND base_year = 1996) AS r "
    f"FROM fx WHERE Country = '{COUNTRY}'",
}
register(
    "final_mart_b",
    _MART.replace("2014", "2001"),
    lambda t: mart.build_mart(t.survey_b, on_unmatched="drop"),
    "SELECT *, hh_expenditures_USD_2014 AS hh_expenditures_USD_2001 FROM mart",
    _B_SURVEY,
)
register(
    "gate_reports",
    "gate:s item_code:s",
    lambda t: mart.gate_reports(t.survey, t.lines),
    """WITH used AS (SELECT DISTINCT item_code FROM lines)
       SELECT 'no sector' AS gate, item_code FROM used WHERE item_code NOT IN (SELECT item_code FROM sector_map)
       UNION ALL SELECT 'no category', item_code FROM used WHERE item_code NOT IN (SELECT item_code FROM categories)
       UNION ALL SELECT 'two sectors or categories', item_code FROM
         (SELECT item_code FROM sector_map FULL JOIN categories USING (item_code)) GROUP BY item_code HAVING count(*) > 1""",
)


@query("final_mart_assembled", _MART, "SELECT * FROM mart")
def _(t):
    cleaned = t.cleaned
    sectors = stage(spending.sector_spending(cleaned, t.sector_map))
    usd = spending.to_reference_currency(sectors, t.fx, COUNTRY)
    footprint = carbon.carbon_footprint(usd, carbon.carbon_intensity(t.sectors, t.emissions))
    parts = mart.assemble(
        carbon.incidence(footprint),
        spending.expenditure_bins(sectors, t.hh),
        spending.category_shares(cleaned, t.categories, CATEGORIES),
        spending.fuel_spending(cleaned, t.fuels, FUELS),
    )
    return mart.final_mart(parts, households.household_frame(t.hh, t.persons, t.assets))


@query(
    "incidence_by_quintile",
    "Income_Group_5:i mean:6",
    "SELECT Income_Group_5, sum(hh_weights * burden_CO2_national) / sum(hh_weights) AS mean FROM mart GROUP BY 1",
)
def _(t):
    return distribution.mean_by(mart.build_mart(t.survey, on_unmatched="drop"), "burden_CO2_national", ["Income_Group_5"])


@query(
    "unmatched_items_stay_out",
    "hh_id:i n:i",
    "SELECT hh_id, count(*) AS n FROM cleaned WHERE item_code NOT IN (SELECT item_code FROM categories) GROUP BY hh_id",
)
def _(t):
    return natural_join(t.cleaned, t.categories, "left_anti", ["item_code"]).groupBy("hh_id").agg(
        F.count(F.lit(1)).alias("n")
    )
