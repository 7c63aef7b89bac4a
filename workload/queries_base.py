"""Sources, projections, filters, joins, aggregates, windows, reshaping, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from levyscape.functions import codebook, nulls, scalars
from levyscape.functions.survey_codes import EDUCATION, EDUCATION_LEVELS, MODEL_SPECS
from levyscape.operators import describe, quality, ranking, reshape, splits
from levyscape.sources import readers, staging, writers
from workload.registry import query, register


def _scratch(t, name: str) -> str:
    """A new folder in the shared location the session names."""
    return f"{staging.shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------
@query("scan_named_columns", "hh_id:i coicop:s expenditures_year:4", "SELECT * FROM items")
def _(t):
    return t.items


@query(
    "delimited_roundtrip",
    "Number:i GTAP:s Explanation:s",
    "SELECT Number, GTAP, Explanation FROM sectors",
)
def _(t):
    path = _scratch(t, "sectors")
    writers.write_csv(t.sectors, path, sep=";")
    return readers.read_delimited(t.spark, path, readers.SECTOR_LIST)


@query("csv_roundtrip", "hh_id:i income:2 province:i", "SELECT hh_id, income, province FROM hh")
def _(t):
    path = _scratch(t, "households")
    writers.write_csv(t.hh.select("hh_id", "income", "province"), path)
    return readers.read_csv(t.spark, path, "hh_id bigint, income double, province int")


@query(
    "headerless_roundtrip",
    "fuel:s item_code:s",
    "SELECT fuel, item_code FROM fuel_pairs",
)
def _(t):
    path = _scratch(t, "fuels")
    writers.write_csv(t.fuel_pairs, path, header=False)
    return readers.read_headerless(t.spark, path, 2).toDF("fuel", "item_code")


@query(
    "country_partition",
    "c_custkey:i c_acctbal:2",
    "SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_0'",
)
def _(t):
    path = _scratch(t, "by-country")
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    writers.write_by_country(named.select("c_custkey", "c_acctbal", F.col("n_name").alias("country")), path)
    return readers.read_country(t.spark, path, "NATION_0")


@query("drop_row_index", "hh_size:i hh_weights:2", "SELECT hh_size, hh_weights FROM hh")
def _(t):
    return readers.drop_row_index(t.hh.select("hh_id", "hh_size", "hh_weights"))


# --- projections -------------------------------------------------------------------
@query(
    "rename_and_reorder",
    "gender_hhh:i ethnicity_hhh:i household:i",
    "SELECT hh_id AS household, gender_hhh, ethnicity_hhh FROM hh",
)
def _(t):
    few = t.hh.select("gender_hhh", "hh_id", "ethnicity_hhh").withColumnsRenamed({"hh_id": "household"})
    return reshape.move_last(few, "gender_hhh", "ethnicity_hhh")


@query(
    "select_by_prefix",
    "heatingsourcewater:i heatingsourcespace:i",
    "SELECT heatingsourcewater, heatingsourcespace FROM hh",
)
def _(t):
    return t.hh.select(*reshape.with_prefix(t.hh, "heating"))


@query(
    "drop_by_prefix",
    "hh_id:i hh_size:i hh_weights:2 province:i urban_1:i cookingsource:i lightingsource:i income:4 consumption:4",
    "SELECT hh_id, hh_size, hh_weights, province, urban_1, cookingsource, lightingsource, income, consumption FROM hh",
)
def _(t):
    left = reshape.drop_prefix(reshape.drop_prefix(reshape.drop_prefix(t.hh, "electricity"), "heating"), "gender")
    return left.drop("ethnicity_hhh")


@query(
    "range_apply_growth",
    "Country:s Year_y1995:6 Year_y1999:6 Year_y2001:6",
    """SELECT Country, 1 + TRY_CAST(y1995 AS DOUBLE) / 100 AS Year_y1995,
       1 + TRY_CAST(y1999 AS DOUBLE) / 100 AS Year_y1999, 1 + TRY_CAST(y2001 AS DOUBLE) / 100 AS Year_y2001
       FROM cpi_sheet""",
)
def _(t):
    years = readers.columns_between(t.cpi_sheet, "y1995", "y2001")
    grown = reshape.apply_to(t.cpi_sheet, years, lambda c: 1 + scalars.to_number(c) / 100)
    return reshape.add_prefix(grown, years, "Year_")


@query(
    "constant_label",
    "hh_id:i category:s",
    "SELECT hh_id, 'burden_CO2_national' AS category FROM hh",
)
def _(t):
    return t.hh.select("hh_id", F.lit("burden_CO2_national").alias("category"))


@query("first_rows", "c_custkey:i", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 6")
def _(t):
    return t.customer.select("c_custkey").orderBy("c_custkey").limit(6)


# --- filters -----------------------------------------------------------------------
@query(
    "positive_lines",
    "hh_id:i coicop:s expenditures_year:4",
    "SELECT * FROM items WHERE expenditures_year IS NOT NULL AND expenditures_year > 0",
)
def _(t):
    return t.items.filter(F.col("expenditures_year").isNotNull() & (F.col("expenditures_year") > 0))


@query(
    "exclude_special_codes",
    "hh_id:i cookingsource:i",
    "SELECT hh_id, cookingsource FROM hh WHERE cookingsource NOT IN (99, 11)",
)
def _(t):
    return t.hh.select("hh_id", "cookingsource").filter(~F.col("cookingsource").isin(99, 11))


@query("drop_incomplete_rows", "item_code:s category:s", "SELECT * FROM categories")
def _(t):
    return t.category_sheet.na.drop("any")


@query(
    "exclude_labels",
    "item_code:s category:s",
    "SELECT * FROM categories WHERE category NOT IN ('deleted', 'in-kind', 'self-produced')",
)
def _(t):
    c = F.col("category")
    return t.category_sheet.filter(c.isNotNull() & ~c.isin("deleted", "in-kind", "self-produced"))


@query(
    "membership_filter",
    "hh_id:i hh_size:i",
    "SELECT hh_id, hh_size FROM hh WHERE hh_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def _(t):
    big = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("hh_id"))
    return quality.drill_down(t.hh, big, "hh_id").select("hh_id", "hh_size")


@query(
    "drop_flagged_households",
    "hh_id:i hh_size:i",
    "SELECT hh_id, hh_size FROM hh WHERE hh_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def _(t):
    big = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("hh_id"))
    return quality.drop_flagged(t.hh, big, "hh_id").select("hh_id", "hh_size")


@query(
    "complete_cases",
    "hh_id:i electricitymains:i cookingsource:i",
    """SELECT hh_id, electricitymains, cookingsource FROM hh
       WHERE electricitymains IS NOT NULL AND cookingsource IS NOT NULL""",
)
def _(t):
    cols = ["electricitymains", "cookingsource"]
    return t.hh.select("hh_id", *cols).na.drop("any", subset=cols)


# --- joins -------------------------------------------------------------------------
_NULLED = """SELECT o_orderkey, nullif(o_custkey % 7, 3) AS k FROM orders"""
_LABELS = """SELECT nullif(r_regionkey + 1, 3) AS k, r_name FROM region"""


@query(
    "null_safe_left_join",
    "o_orderkey:i k:i r_name:s",
    f"SELECT a.o_orderkey, a.k, b.r_name FROM ({_NULLED}) a LEFT JOIN ({_LABELS}) b ON a.k IS NOT DISTINCT FROM b.k",
)
def _(t):
    a = t.orders.selectExpr("o_orderkey", "nullif(o_custkey % 7, 3) AS k")
    b = t.region.selectExpr("nullif(r_regionkey + 1, 3) AS k", "r_name")
    return nulls.natural_join(a, b, "left")


@query(
    "left_join_named_keys",
    "Number:i GTAP:s CO2_Mt:4",
    "SELECT s.Number, s.GTAP, e.CO2_Mt FROM sectors s LEFT JOIN (SELECT * FROM emissions WHERE GTAP <> 5) e ON s.Number = e.GTAP",
)
def _(t):
    e = t.emissions.filter("GTAP <> 5").withColumnRenamed("GTAP", "Number")
    return nulls.natural_join(t.sectors, e, "left", ["Number"])


@query(
    "full_outer_members",
    "hh_id:i education_hhh:i own_stove:i own_vehicle:i",
    "SELECT * FROM members",
)
def _(t):
    from levyscape.plans.households import heads

    return nulls.natural_join(heads(t.persons, ["education_hhh"]), t.assets, "full")


@query(
    "unmatched_rows",
    "hh_id:i coicop:s",
    "SELECT hh_id, coicop FROM items WHERE coicop NOT IN (SELECT coicop FROM codes)",
)
def _(t):
    return nulls.natural_join(t.items, t.codes, "left_anti", ["coicop"], null_safe=False)


@query(
    "scalar_broadcast",
    "hh_id:i income_usd:4",
    "SELECT hh_id, income * (SELECT r FROM rate) AS income_usd FROM hh",
)
def _(t):
    from levyscape.plans.spending import exchange_rate

    return t.hh.select("hh_id", (F.col("income") * exchange_rate(t.fx, "NATION_0")).alias("income_usd"))


# --- aggregates --------------------------------------------------------------------
@query(
    "strict_sum_nulls",
    "l_returnflag:s l_linestatus:s strict:2 skip:2 strict_mean:6 mean:6",
    """SELECT l_returnflag, l_linestatus, CASE WHEN count(x) = count(*) THEN sum(x) END AS strict,
         sum(x) AS skip, CASE WHEN count(x) = count(*) THEN avg(x) END AS strict_mean, avg(x) AS mean
       FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' AND l_orderkey % 53 = 0 THEN NULL
             ELSE l_extendedprice END AS x FROM lineitem) GROUP BY l_returnflag, l_linestatus""",
)
def _(t):
    x = t.lineitem.withColumn(
        "x",
        F.when((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 53 == 0), None).otherwise(
            F.col("l_extendedprice")
        ),
    )
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        nulls.strict_sum("x").alias("strict"),
        nulls.strict_sum("x", "skip").alias("skip"),
        nulls.strict_mean("x").alias("strict_mean"),
        nulls.strict_mean("x", "skip").alias("mean"),
    )


@query(
    "grouped_sum",
    "hh_id:i item_code:s expenditures_year:5",
    "SELECT hh_id, item_code, sum(expenditures_year) AS expenditures_year FROM lines WHERE expenditures_year <> 0 GROUP BY ALL",
)
def _(t):
    lines = t.lines.filter(F.col("expenditures_year") != 0)
    return lines.groupBy("hh_id", "item_code").agg(nulls.strict_sum("expenditures_year").alias("expenditures_year"))


_SUMMED = ("CO2_Mt", "CO2_Mt_within", "CO2_Mt_Electricity", "CO2_Mt_Transport")


@query(
    "many_column_sums",
    " ".join(["parity:i", *[f"{c}:4" for c in _SUMMED]]),
    f"SELECT GTAP % 2 AS parity, {', '.join(f'sum({c}) AS {c}' for c in _SUMMED)} FROM emissions GROUP BY 1",
)
def _(t):
    cols = readers.columns_between(t.emissions, "CO2_Mt", "CO2_Mt_Transport")
    return t.emissions.groupBy((F.col("GTAP") % 2).alias("parity")).agg(
        *[nulls.strict_sum(c).alias(c) for c in cols]
    )


@query(
    "collapse_lines",
    "hh_id:i item_code:s expenditures_year:5",
    "SELECT hh_id, item_code, sum(expenditures_year) AS expenditures_year FROM lines WHERE expenditures_year IS NOT NULL GROUP BY ALL",
)
def _(t):
    return quality.collapse_lines(t.lines, ["hh_id", "item_code"], "expenditures_year")


@query(
    "rows_per_group",
    "province:i n:i",
    "SELECT province, count(*) AS n FROM hh GROUP BY province",
)
def _(t):
    return t.hh.groupBy("province").agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_households",
    "n:i",
    "SELECT count(DISTINCT hh_id) AS n FROM items",
)
def _(t):
    return t.items.agg(F.countDistinct("hh_id").alias("n"))


@query(
    "first_row_per_key",
    "hh_id:i hh_size:i province:i",
    """SELECT hh_id, hh_size, province FROM (SELECT *, row_number() OVER (PARTITION BY hh_id ORDER BY hh_size) AS rn
       FROM house) WHERE rn = 1""",
)
def _(t):
    return reshape.first_per_key(t.house, "hh_id", ["hh_id", "hh_size"])


@query("infinite_guard", "infinite:b", "SELECT coalesce(bool_or(x = 'inf'::DOUBLE), false) AS infinite FROM (SELECT CASE WHEN l_quantity = 1 THEN 'inf'::DOUBLE ELSE l_quantity END AS x FROM lineitem)")
def _(t):
    x = t.lineitem.select(nulls.ratio(F.lit(1.0), F.col("l_quantity") - 1).alias("x"))
    return quality.has_infinite(x, ["x"])


@query(
    "column_variances",
    "l_quantity:4 l_discount:8 l_tax:8",
    "SELECT var_samp(l_quantity) AS l_quantity, var_samp(l_discount) AS l_discount, var_samp(l_tax) AS l_tax FROM lineitem",
)
def _(t):
    return describe.variances(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query(
    "value_frequencies",
    "column_name:s value:s count:i percentage:6",
    """SELECT column_name, value, count(*) AS count, 100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY column_name) AS percentage
       FROM (SELECT 'province' AS column_name, CAST(province AS VARCHAR) AS value FROM hh
             UNION ALL SELECT 'electricitymains', CAST(electricitymains AS VARCHAR) FROM hh
             UNION ALL SELECT 'cookingsource', CAST(cookingsource AS VARCHAR) FROM hh) GROUP BY column_name, value""",
)
def _(t):
    return describe.value_frequencies(t.hh, ["province", "electricitymains", "cookingsource"])


# --- group values on rows ----------------------------------------------------------
@query(
    "group_size_on_rows",
    "hh_id:i number:i",
    "SELECT hh_id, count(*) OVER (PARTITION BY province, urban_1) AS number FROM hh",
)
def _(t):
    return reshape.group_size(t.hh, ["province", "urban_1"])


@query(
    "group_total_on_rows",
    "l_orderkey:i l_extendedprice:2 total:2",
    "SELECT l_orderkey, l_extendedprice, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS total FROM lineitem",
)
def _(t):
    return reshape.with_totals(t.lineitem, ["l_orderkey"], {"total": nulls.strict_sum("l_extendedprice")})


@query(
    "share_of_group_total",
    "l_orderkey:i l_extendedprice:2 share:6",
    "SELECT l_orderkey, l_extendedprice, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share FROM lineitem",
)
def _(t):
    return reshape.share_of(t.lineitem.select("l_orderkey", "l_extendedprice"), "l_extendedprice", ["l_orderkey"])


@query(
    "flagged_share_on_rows",
    "hh_id:i flagged:6",
    "SELECT hh_id, avg(CASE WHEN electricitycon = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY province) AS flagged FROM hh",
)
def _(t):
    flag = t.hh.withColumn("f", scalars.if_else(F.col("electricitycon") == 2, 1, 0))
    return reshape.flag_share(flag, "f", ["province"], "flagged")


@query(
    "equal_count_buckets",
    "c_custkey:i decile:i",
    "SELECT c_custkey, ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS decile FROM customer",
)
def _(t):
    return ranking.ntile(t.customer, "c_acctbal", 10, "c_custkey", "decile")


@query(
    "equal_count_buckets_ties",
    "l_orderkey:i l_linenumber:i q:i id:i decile:i",
    """SELECT *, ntile(10) OVER (ORDER BY q, id) AS decile FROM
       (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) // 20 AS q,
          l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id FROM lineitem)""",
)
def _(t):
    return ranking.ntile(
        t.lineitem.selectExpr(
            "l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) DIV 20 AS q",
            "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id",
        ),
        "q", 10, "id", "decile",
    )


@query(
    "ntile_text",
    "c_name:s decile:i",
    "SELECT c_name, ntile(10) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_name) AS decile FROM customer",
)
def _(t):
    return ranking.ntile(t.customer, "c_nationkey", 10, "c_name", "decile", ["c_mktsegment"])


@query(
    "row_index_text",
    "c_name:s index:i",
    "SELECT c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS index FROM customer",
)
def _(t):
    return reshape.row_index(t.customer, ["c_mktsegment"], "c_name")


@query(
    "row_index_in_group",
    "c_custkey:i index:i",
    "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS index FROM customer",
)
def _(t):
    return reshape.row_index(t.customer, ["c_nationkey"], "c_custkey")


@query(
    "surrogate_ids",
    "hh_id:i coicop:s expenditures_year:4",
    """SELECT k.rn AS hh_id, i.coicop, i.expenditures_year FROM items i JOIN
       (SELECT hh_id, row_number() OVER (ORDER BY hh_id) AS rn FROM (SELECT DISTINCT hh_id FROM house)) k USING (hh_id)""",
)
def _(t):
    from levyscape.plans.spending import surrogate_ids

    return surrogate_ids(t.house, t.items)[1]


# --- reshaping ---------------------------------------------------------------------
@query(
    "wide_to_long",
    "hh_id:i name:s code:i",
    """SELECT hh_id, 'cookingsource' AS name, cookingsource AS code FROM hh
       UNION ALL SELECT hh_id, 'lightingsource', lightingsource FROM hh""",
)
def _(t):
    return reshape.to_long(t.hh, ["hh_id"], ["cookingsource", "lightingsource"], "name", "code")


@query(
    "long_to_wide",
    "c_custkey:i O:2 F:2 P:2",
    """SELECT o_custkey AS c_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS O,
         sum(o_totalprice) FILTER (o_orderstatus = 'F') AS F, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS P
       FROM orders GROUP BY 1""",
)
def _(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return reshape.pivot_fill(orders, ["c_custkey"], "o_orderstatus", "o_totalprice", ["O", "F", "P"])


@query(
    "long_to_wide_filled",
    "o_custkey:i n_O:2 n_F:2 n_P:2",
    """SELECT o_custkey, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS n_O,
         coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS n_F,
         coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS n_P FROM orders GROUP BY 1""",
)
def _(t):
    return reshape.pivot_fill(
        t.orders, ["o_custkey"], "o_orderstatus", "o_totalprice", ["O", "F", "P"], "n_", 0.0
    )


@query(
    "transpose_summary",
    "variable:s 1:6 2:6",
    """SELECT 'hh_size' AS variable, avg(hh_size) FILTER (gender_hhh = 1) AS "1", avg(hh_size) FILTER (gender_hhh = 2) AS "2" FROM hh
       UNION ALL SELECT 'income', avg(income) FILTER (gender_hhh = 1), avg(income) FILTER (gender_hhh = 2) FROM hh""",
)
def _(t):
    means = t.hh.groupBy("gender_hhh").agg(F.avg("hh_size").alias("hh_size"), F.avg("income").alias("income"))
    return reshape.transpose_summary(means, "gender_hhh", [1, 2])


@query(
    "union_of_results",
    "hh_id:i source:s",
    "SELECT hh_id, 'house' AS source FROM hh UNION ALL SELECT hh_id, 'assets' FROM assets",
)
def _(t):
    a = t.hh.select("hh_id", F.lit("house").alias("source"))
    return a.unionByName(t.assets.select("hh_id", F.lit("assets").alias("source")))


@query(
    "set_difference_size",
    "n:i",
    "SELECT count(*) AS n FROM (SELECT hh_id FROM hh EXCEPT SELECT hh_id FROM assets)",
)
def _(t):
    return t.hh.select("hh_id").join(t.assets.select("hh_id"), "hh_id", "left_anti").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "order_by_level",
    "urban_1:s urban_1_ord:i n:i",
    """SELECT urban_1, urban_1_ord, count(*) AS n FROM (SELECT
         CASE urban_1 WHEN 1 THEN 'Urban formal' WHEN 2 THEN 'Urban informal' WHEN 4 THEN 'Traditional area' WHEN 5 THEN 'Rural formal' END AS urban_1,
         CASE urban_1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 END AS urban_1_ord FROM hh) GROUP BY ALL ORDER BY urban_1_ord""",
)
def _(t):
    coded = codebook.recode(t.hh, [s for s in MODEL_SPECS if s.column == "urban_1"], ordinals=True)
    return coded.groupBy("urban_1", "urban_1_ord").agg(F.count(F.lit(1)).alias("n")).orderBy("urban_1_ord")


# --- scalars -----------------------------------------------------------------------
@query(
    "two_way_choice",
    "hh_id:i mains:s",
    """SELECT hh_id, CASE WHEN electricitymains IS NULL THEN NULL WHEN electricitymains = 1 THEN 'yes' ELSE 'no' END AS mains FROM hh""",
)
def _(t):
    return t.hh.select("hh_id", scalars.if_else(F.col("electricitymains") == 1, "yes", "no").alias("mains"))


@query(
    "log_and_arithmetic",
    "o_orderkey:i log_price:8 squared:4 flipped:2 percent:9",
    """SELECT o_orderkey, ln(o_totalprice) AS log_price, (o_totalprice / 3e2) * (o_totalprice / 3e2) AS squared,
         -o_totalprice AS flipped, o_totalprice / 3e5 * 100 AS percent FROM orders""",
)
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.ln(p).alias("log_price"),
        ((p / 300) * (p / 300)).alias("squared"),
        (-p).alias("flipped"),
        (p / 300000 * 100).alias("percent"),
    )


@query(
    "text_to_number",
    "Country:s rate:8",
    "SELECT Country, TRY_CAST(exchange_rate AS DOUBLE) AS rate FROM fx",
)
def _(t):
    return t.fx.select("Country", scalars.to_number("exchange_rate").alias("rate"))


@query(
    "regex_sequence",
    "p_partkey:i caption:s",
    """SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name, '^small ', 'Small: '), '^red ', 'Red: '), 'ring', 'Ring', 'g') AS caption FROM part""",
)
def _(t):
    pairs = [("^small ", "Small: "), ("^red ", "Red: "), ("ring", "Ring")]
    return t.part.select("p_partkey", scalars.replace_all("p_name", pairs).alias("caption"))


@query(
    "prefix_ranks",
    "p_partkey:i rank:i",
    "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN 1 WHEN starts_with(p_name, 'blue') THEN 2 WHEN starts_with(p_name, 'small') THEN 3 ELSE 4 END AS rank FROM part",
)
def _(t):
    return t.part.select("p_partkey", scalars.prefix_rank("p_name", ["red", "blue", "small"]).alias("rank"))


@query(
    "formatted_message",
    "check:s n:i detail:s",
    """SELECT 'duplicates' AS check, count(*) AS n, count(*) || ' households report the same total expenditures.' AS detail
       FROM (SELECT count(*) OVER (PARTITION BY s) AS c FROM (SELECT sum(expenditures_year) AS s FROM priced WHERE expenditures_year <> 0 GROUP BY hh_id)) WHERE c > 1""",
)
def _(t):
    report = quality.duplicate_totals(t.priced, "hh_id", "expenditures_year")
    return quality.report_row(report, "duplicates", "%d households report the same total expenditures.")


@query(
    "significance_stars",
    "l_orderkey:i l_linenumber:i p:4 signif:s",
    """SELECT l_orderkey, l_linenumber, l_discount / 2 AS p, CASE WHEN l_discount / 2 <= 0.001 THEN '***'
       WHEN l_discount / 2 <= 0.01 THEN '**' WHEN l_discount / 2 <= 0.05 THEN '*' ELSE '' END AS signif FROM lineitem""",
)
def _(t):
    p = t.lineitem.withColumn("p", F.col("l_discount") / 2)
    return p.withColumn("signif", scalars.stars("p"))


@query(
    "code_to_label_default",
    "hh_id:i education:s education_ord:i",
    """SELECT hh_id, education, list_position(['Upper Secondary Education', 'No Schooling', 'Pre-primary Education',
         'Primary Education', 'Lower Secondary Education', 'Post-secondary Non-tertiary Education',
         'Short-cycle Tertiary Education', 'Bachelors or Equivalent', 'Masters or Equivalent', 'Other'], education) AS education_ord
       FROM (SELECT hh_id, CASE WHEN e IS NULL THEN NULL WHEN e = 1 THEN 'Pre-primary Education' WHEN e BETWEEN 2 AND 5 THEN 'Primary Education'
         WHEN e BETWEEN 6 AND 8 THEN 'Lower Secondary Education' WHEN e BETWEEN 9 AND 14 THEN 'Upper Secondary Education'
         WHEN e BETWEEN 15 AND 24 THEN 'Post-secondary Non-tertiary Education' WHEN e IN (25, 26) THEN 'Short-cycle Tertiary Education'
         WHEN e BETWEEN 27 AND 29 THEN 'Bachelors or Equivalent' WHEN e = 30 THEN 'Masters or Equivalent'
         WHEN e = 98 THEN 'No Schooling' ELSE 'Other' END AS education FROM (SELECT hh_id, education_hhh AS e FROM persons))""",
)
def _(t):
    label = codebook.label_of("education_hhh", EDUCATION, "Other")
    return t.persons.select(
        "hh_id", label.alias("education"), codebook.ordinal(label, EDUCATION_LEVELS).alias("education_ord")
    )


@query(
    "hash_split",
    "c_custkey:i train:b",
    "SELECT c_custkey, ((c_custkey % 1000003) * 2654435761 % 4294967296) % 1000 < 750 AS train FROM customer",
)
def _(t):
    return splits.hash_split(t.customer, "c_custkey")


@query(
    "stratified_split",
    "c_custkey:i train:b",
    """SELECT c_custkey, row_number() OVER (PARTITION BY s ORDER BY (c_custkey % 1000003) * 2654435761 % 4294967296, c_custkey)
         <= ceil(count(*) OVER (PARTITION BY s) * 7e-1) AS train
       FROM (SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS s FROM customer)""",
)
def _(t):
    return splits.stratified_split(t.customer, "c_acctbal", "c_custkey")


@query(
    "stratified_split_text",
    "c_name:s train:b",
    """SELECT c_name, row_number() OVER (PARTITION BY s ORDER BY CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT), c_name)
         <= ceil(count(*) OVER (PARTITION BY s) * 7e-1) AS train
       FROM (SELECT c_name, ntile(5) OVER (ORDER BY c_nationkey, c_name) AS s FROM customer)""",
)
def _(t):
    return splits.stratified_split(t.customer, "c_nationkey", "c_name")


register(
    "histogram",
    "bin:i n:i",
    lambda t: describe.histogram(t.orders, "o_totalprice", 20),
    """SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n
       FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
_FIVE = """quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3,
  min(o_totalprice) AS lowest, max(o_totalprice) AS highest"""
register(
    "box_stats",
    "lowest:4 q1:4 median:4 q3:4 highest:4 n_outliers:i",
    lambda t: describe.box_stats(t.orders, "o_totalprice"),
    f"""SELECT s.*, (SELECT count(*) FROM orders WHERE o_totalprice < q1 - 15e-1 * (q3 - q1) OR o_totalprice > q3 + 15e-1 * (q3 - q1)) AS n_outliers
        FROM (SELECT {_FIVE} FROM orders) s""",
)
register(
    "summary6",
    "lowest:4 q1:4 median:4 q3:4 highest:4 mean:4 n_missing:i",
    lambda t: describe.summary6(
        t.orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))),
        "o_totalprice",
    ),
    f"""SELECT {_FIVE}, avg(o_totalprice) AS mean, count(*) - count(o_totalprice) AS n_missing
        FROM (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)""",
)
