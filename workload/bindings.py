"""Survey-shaped inputs bound to the star-schema tables.

Each binding is one SQL text that Spark and the checking database both read, so
both sides start from the same rows. Coded attributes mix the key with different
primes, so they are not functions of one another.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscape.plans.households import item_spending
from levyscape.plans.mart import Survey, build_mart
from levyscape.plans.spending import clean_spending, load_concordance, load_sector_map, price_factor
from levyscape.sources.readers import read_table
from levyscape.sources.staging import stage

COUNTRY = "NATION_0"
CATEGORIES = ("Food", "Goods", "Services", "Energy")
FUELS = ("electricity", "gas", "paraffin", "petrol", "coal")
YEARS = range(1995, 2002)


def _mix(prime: int, modulus: int, n: int) -> str:
    return f"(c_custkey * {prime} % {modulus}) % {n}"


_LABEL = (
    "CASE n WHEN 7 THEN 'gas' WHEN 8 THEN 'gdt' WHEN 24 THEN 'other' WHEN 25 THEN 'deleted' "
    "ELSE 's' || CAST(n AS STRING) END"
)
_TYPES = ("ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO")

SQL = {
    "hh": f"""
        SELECT c_custkey AS hh_id,
          CAST(1 + c_custkey % 6 AS INT) AS hh_size,
          (1 + c_custkey % 7) * 3.725e1 AS hh_weights,
          CAST(1 + {_mix(7919, 1009, 2)} AS INT) AS gender_hhh,
          CAST(1 + {_mix(104729, 1013, 4)} AS INT) AS ethnicity_hhh,
          CAST(1 + {_mix(1299709, 1019, 9)} AS INT) AS province,
          CASE {_mix(15485863, 1021, 4)} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END AS urban_1,
          CASE {_mix(31, 1031, 12)} WHEN 0 THEN 9 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS electricitycon,
          CASE {_mix(37, 1033, 5)} WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN NULL ELSE 1 END AS electricitymains,
          CAST(1 + {_mix(41, 1039, 9)} AS INT) AS electricitysource,
          CASE {_mix(43, 1049, 4)} WHEN 0 THEN 1 WHEN 3 THEN 9 ELSE 2 END AS electricityfree,
          CAST(CASE WHEN c_custkey % 101 = 0 THEN NULL WHEN {_mix(47, 1051, 12)} = 11 THEN 99
               ELSE 1 + {_mix(47, 1051, 12)} END AS INT) AS cookingsource,
          CAST(CASE WHEN {_mix(53, 1061, 12)} = 11 THEN 99 ELSE 1 + {_mix(53, 1061, 12)} END AS INT) AS lightingsource,
          CAST(CASE WHEN {_mix(59, 1063, 12)} = 11 THEN 99 ELSE 1 + {_mix(59, 1063, 12)} END AS INT) AS heatingsourcewater,
          CAST(CASE WHEN {_mix(61, 1069, 12)} = 11 THEN 99 ELSE 1 + {_mix(61, 1069, 12)} END AS INT) AS heatingsourcespace,
          c_acctbal AS income, c_acctbal * 5e-1 AS consumption
        FROM {{customer}}""",
    # the same households with some delivered twice
    "house": """
        SELECT * FROM {hh} UNION ALL
        SELECT hh_id, hh_size + 1 AS hh_size, hh_weights, gender_hhh, ethnicity_hhh, province, urban_1,
          electricitycon, electricitymains, electricitysource, electricityfree, cookingsource,
          lightingsource, heatingsourcewater, heatingsourcespace, income, consumption
        FROM {hh} WHERE hh_id % 50 = 0""",
    "persons": """
        SELECT o.o_custkey AS hh_id, o.o_orderkey AS perno,
          CAST(nullif(o.o_orderkey % 90, 89) AS INT) AS age,
          CAST(CASE WHEN o.o_orderkey = f.head THEN 1 WHEN o.o_orderkey % 13 = 0 THEN NULL
               ELSE 2 + o.o_orderkey % 5 END AS INT) AS relationhhh,
          CAST(CASE (o.o_orderkey * 31 % 1009) % 33 WHEN 0 THEN 98 WHEN 32 THEN NULL
               ELSE (o.o_orderkey * 31 % 1009) % 33 END AS INT) AS education_hhh
        FROM {orders} o
        JOIN (SELECT o_custkey, min(o_orderkey) AS head FROM {orders} GROUP BY o_custkey) f
          ON o.o_custkey = f.o_custkey""",
    "assets": f"""
        SELECT c_custkey AS hh_id,
          CASE {_mix(67, 1087, 5)} WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 1 END AS own_stove,
          CASE {_mix(71, 1091, 5)} WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 1 END AS own_vehicle
        FROM {{customer}} WHERE c_acctbal > -5e2
        UNION ALL SELECT -1 - s_suppkey AS hh_id, 1 AS own_stove, 3 AS own_vehicle FROM {{supplier}}""",
    "brands": """
        SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INT) AS n, p_type,
          p_brand || '/' || p_type AS coicop,
          replace(p_brand, 'Brand#', 'b') || '-' || lower(p_type) AS item_code
        FROM {part}""",
    "items": """
        SELECT o.o_custkey AS hh_id, p.p_brand || '/' || p.p_type AS coicop,
          CASE WHEN l.l_orderkey % 211 = 0 THEN NULL WHEN l.l_orderkey % 223 = 0 THEN 0e0
               WHEN l.l_orderkey % 227 = 0 THEN -l.l_extendedprice
               ELSE l.l_extendedprice * (1 - l.l_discount) END AS expenditures_year
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "codes": """
        SELECT coicop, item_code, p_type AS label FROM {brands} WHERE NOT (n = 3 AND p_type = 'PROMO')""",
    "sector_sheet": f"""
        SELECT {_LABEL} AS GTAP, 'sector ' || CAST(n AS STRING) AS Explanation,
          {", ".join(f"max(CASE WHEN p_type = '{t}' THEN item_code END) AS c{i}" for i, t in enumerate(_TYPES, 1))}
        FROM {{brands}} GROUP BY n""",
    "category_sheet": """
        SELECT item_code, CASE WHEN n = 5 AND p_type = 'LARGE' THEN NULL ELSE
          CASE p_type WHEN 'ECONOMY' THEN 'Food' WHEN 'SMALL' THEN 'Goods' WHEN 'STANDARD' THEN 'Services'
            WHEN 'MEDIUM' THEN 'Energy' WHEN 'LARGE' THEN 'self-produced' ELSE 'deleted' END END AS category
        FROM {brands}""",
    "fuel_pairs": """
        SELECT CASE n % 5 WHEN 0 THEN 'electricity' WHEN 1 THEN 'gas' WHEN 2 THEN 'paraffin'
          WHEN 3 THEN 'petrol' ELSE 'coal' END AS fuel, item_code
        FROM {brands} WHERE p_type = 'MEDIUM' AND n <> 13
        UNION ALL SELECT 'coal' AS fuel, item_code FROM {brands} WHERE p_type = 'SMALL' AND n = 2""",
    "sectors": f"""
        SELECT DISTINCT n AS Number, {_LABEL} AS GTAP, 'sector; ' || CAST(n AS STRING) AS Explanation FROM {{brands}}""",
    "emissions": """
        SELECT DISTINCT n AS GTAP, n * 7e-1 AS CO2_Mt, n * 5e-1 AS CO2_Mt_within, n * 3e-1 AS CO2_Mt_Electricity,
          n * 1e-1 AS CO2_Mt_Transport, 1e3 + n * 1e1 AS Total_HH_Consumption_MUSD FROM {brands}""",
    "fx": """
        SELECT n_name AS Country, CASE WHEN n_nationkey = 3 THEN 'n/a'
          ELSE '0.09' || CAST(21647 + n_nationkey AS STRING) END AS exchange_rate FROM {nation}""",
    "cpi_sheet": f"""
        SELECT n_name AS Country, {", ".join(
            f"CASE WHEN n_nationkey = 7 AND {y} = 1999 THEN '-' "
            f"ELSE CAST(3 + (n_nationkey + {y}) % 7 AS STRING) || '.5' END AS y{y}" for y in YEARS
        )} FROM {{nation}}""",
    # many small "households" (one per order) for the duplicate reports
    "baskets": """
        SELECT l.l_orderkey AS hh_id, p.p_type AS item_code, sum(l.l_quantity) AS expenditures_year
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey, p.p_type""",
    "priced": """
        SELECT l_orderkey AS hh_id, CAST(l_partkey % 400 AS STRING) AS item_code,
          CASE WHEN l_orderkey % 97 = 0 THEN -l_quantity ELSE l_quantity END AS expenditures_year
        FROM {lineitem}""",
    # item lines with quirks in the weights, for the quantile operators
    "quirky": """
        SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
          CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_extendedprice END AS x, l_quantity AS q,
          CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 0e0
               ELSE (l_suppkey % 10) * 1.25e0 END AS w
        FROM {lineitem}""",
    # weights in tenths, whose sums as doubles depend on their order
    "tenths": """
        SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS x, (1 + l_suppkey % 7) * 1e-1 AS w FROM {lineitem}""",
    # shares of nothing
    "shares_of_nothing": """
        SELECT l_orderkey, l_returnflag, l_linestatus, (1 + l_suppkey % 7) * 1e-1 AS w,
          CASE WHEN l_orderkey % 59 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 61 = 0 THEN NULL ELSE l_discount END AS x
        FROM {lineitem}""",
    "ranks": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_quantity END AS x,
          nullif(l_orderkey * 10 + l_linenumber, 11) AS tie FROM {lineitem}""",
}
# Declared, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}
RAW = tuple(SCHEMAS)


class Tables:
    """Lazy access to the raw tables and the bindings of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RAW and name not in SQL:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in RAW:
            return read_table(self.spark, f"{self.sf_dir}/{name}.parquet", SCHEMAS[name])
        text = SQL[name]
        needed = [n for n in (*RAW, *SQL) if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: getattr(self, n) for n in needed})

    @cached_property
    def items(self) -> DataFrame:
        """The rows of ``SQL["items"]``: a line carries its amount through the joins, not what it is made of."""
        amount = re.search(r"CASE.*END AS expenditures_year", SQL["items"], re.DOTALL)[0]
        priced = self.lineitem.alias("l").select("l_orderkey", "l_partkey", F.expr(amount))
        bought = priced.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        coded = self.part.select("p_partkey", F.expr("p_brand || '/' || p_type").alias("coicop"))
        return bought.join(coded, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("o_custkey").alias("hh_id"), "coicop", "expenditures_year"
        )

    @property
    def cpi(self) -> DataFrame:
        return self.cpi_sheet.withColumnsRenamed({f"y{y}": str(y) for y in YEARS})

    @property
    def sector_map(self) -> DataFrame:
        return load_sector_map(self.sector_sheet)

    @property
    def categories(self) -> DataFrame:
        return self.category_sheet.na.drop("any")

    @property
    def fuels(self) -> DataFrame:
        return self.fuel_pairs

    @property
    def lines(self) -> DataFrame:
        return item_spending(self.items, self.codes)

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean_spending(self.lines, self.hh)

    @property
    def survey(self) -> Survey:
        return Survey(
            house=self.hh,
            persons=self.persons,
            assets=self.assets,
            items=self.items,
            item_codes=self.codes,
            sector_map=self.sector_map,
            categories=self.categories,
            fuels=self.fuels,
            sectors=self.sectors,
            emissions=self.emissions,
            fx=self.fx,
            country=COUNTRY,
            kept_categories=CATEGORIES,
            kept_fuels=FUELS,
        )

    @property
    def survey_b(self) -> Survey:
        """The same tables as a survey of other prices: lines collapsed, prices carried from 1996 to 2001."""
        factor = price_factor(self.cpi, COUNTRY, 1996, 2001)
        return replace(self.survey, collapse=True, price_factor=factor, year=2001)

    @property
    def mart(self) -> DataFrame:
        """The final mart, written once per session and data directory, then read.

        Tables, models and clusterings all start from this one written table;
        ``forget_marts`` makes the next query compute it again.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _MARTS:
            _MARTS[key] = stage(build_mart(self.survey, on_unmatched="drop"))
        return _MARTS[key]


_MARTS: dict[tuple[str, str], DataFrame] = {}


def forget_marts() -> None:
    _MARTS.clear()


__all__ = ["COUNTRY", "CATEGORIES", "FUELS", "RAW", "SQL", "Tables", "YEARS", "forget_marts", "load_concordance"]
