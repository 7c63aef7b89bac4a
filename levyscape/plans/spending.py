"""From item lines to spending per household, sector, category and fuel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join, ratio, strict_sum
from levyscape.functions.scalars import to_number
from levyscape.operators.ranking import surrogate_index
from levyscape.operators.reshape import (
    pivot_fill,
    surrogate_join,
    to_long,
    with_totals,
)
from levyscape.operators.weighted import flag_outliers, replace_outliers, weighted_bins
from levyscape.sources.staging import stage

# Labels the concordances use.
MERGED_SECTORS = ("gas", "gdt")
MERGED_LABEL = "gasgdt"
DELETED = "deleted"
NON_MARKET = ("deleted", "in-kind", "self-produced")


def merge_gas(c: str | Column) -> Column:
    """Gas extraction and gas distribution count as one sector."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*MERGED_SECTORS), F.lit(MERGED_LABEL)).otherwise(c)


def weighted_lines(exp: DataFrame, hh: DataFrame) -> DataFrame:
    """Positive lines with their household's weight."""
    positive = exp.filter(F.col("expenditures_year").isNotNull() & (F.col("expenditures_year") > 0))
    return natural_join(positive, hh.select("hh_id", "hh_weights"), "left", ["hh_id"], null_safe=False)


def clean_spending(exp: DataFrame, hh: DataFrame, prob: float = 0.99) -> DataFrame:
    """Lines at or above their item's weighted quantile get the item's weighted median.

    The weighted lines are staged because the quantile reads them more than once.
    """
    lines = stage(weighted_lines(exp, hh).select("hh_id", "item_code", "expenditures_year", "hh_weights"))
    cleaned = replace_outliers(
        lines, "expenditures_year", "hh_weights", ["item_code"], prob, "expenditures"
    )
    return cleaned.select("hh_id", "item_code", "expenditures", "hh_weights")


def total_outliers(cleaned: DataFrame) -> DataFrame:
    """Households whose total is at or above the weighted 99 % quantile (reported, not removed)."""
    totals = stage(
        cleaned.groupBy("hh_id").agg(
            F.sum("expenditures").alias("total_expenditures"),
            F.max("hh_weights").alias("hh_weights"),
        )
    )
    flagged = flag_outliers(totals, "total_expenditures", "hh_weights")
    return flagged.filter(F.col("flag_outlier_99") == 1)


def load_concordance(wide: DataFrame, label: str, drop: Sequence[str] = ()) -> DataFrame:
    """Wide sheet (label, code, code, ...) to (label, item_code) pairs."""
    sheet = wide.drop(*drop)
    codes = [c for c in sheet.columns if c != label]
    long = to_long(sheet, [label], codes, "_column", "item_code").drop("_column")
    return long.filter(F.col("item_code").isNotNull())


def load_sector_map(wide: DataFrame) -> DataFrame:
    return load_concordance(wide, "GTAP", ["Explanation"]).withColumn("GTAP", merge_gas("GTAP"))


def surrogate_ids(hh: DataFrame, exp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the households 1..n in id order and use the numbers in both tables."""
    keys = surrogate_index(hh, "hh_id", "hh_id_new")
    return surrogate_join(hh, keys, "hh_id", "hh_id_new"), surrogate_join(
        exp, keys, "hh_id", "hh_id_new"
    )


def sector_spending(exp: DataFrame, sectors: DataFrame) -> DataFrame:
    """Attach the sector; deleted and unmatched items go."""
    return natural_join(exp, sectors, "left", ["item_code"]).filter(F.col("GTAP") != DELETED)


def household_spending(sector_exp: DataFrame, hh: DataFrame) -> DataFrame:
    """Total and per-head spending of each household with its weight."""
    totals = sector_exp.groupBy("hh_id").agg(strict_sum("expenditures").alias("hh_expenditures"))
    basic = hh.select("hh_id", "hh_size", "hh_weights")
    return natural_join(totals, basic, "left", ["hh_id"], null_safe=False).select(
        "hh_id",
        "hh_expenditures",
        ratio("hh_expenditures", "hh_size").alias("hh_expenditures_pc"),
        "hh_weights",
    )


def expenditure_bins(sector_exp: DataFrame, hh: DataFrame, ks: Sequence[int] = (2, 3, 5, 10)) -> DataFrame:
    """Weighted expenditure groups of the households by per-head spending."""
    totals = stage(household_spending(sector_exp, hh))
    binned = weighted_bins(totals, "hh_expenditures_pc", "hh_weights", ks, "Income_Group_")
    return binned.drop("hh_weights")


def category_shares(
    exp: DataFrame,
    categories: DataFrame,
    keep: Sequence[str],
    exclude: Sequence[str] = NON_MARKET,
) -> DataFrame:
    """Share of each kept category in the household's market spending, 0 where absent."""
    tagged = natural_join(exp, categories, "left", ["item_code"]).filter(
        F.col("category").isNotNull() & ~F.col("category").isin(*exclude)
    )
    per_category = tagged.groupBy("hh_id", "category").agg(strict_sum("expenditures").alias("_e"))
    total = per_category.groupBy("hh_id").agg(
        strict_sum("_e").alias("_total"),
        *[F.sum(F.when(F.col("category") == c, F.col("_e"))).alias(f"_{c}") for c in keep],
        *[F.max(F.when(F.col("category") == c, 1)).alias(f"_has_{c}") for c in keep],
    )
    return total.select(
        "hh_id",
        *[
            F.when(F.col(f"_has_{c}").isNull(), 0.0)
            .otherwise(ratio(f"_{c}", "_total"))
            .alias(f"share_{c}")
            for c in keep
        ],
    )


def fuel_spending(exp: DataFrame, fuels: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Spending per fuel in local currency, null where the household buys none."""
    tagged = natural_join(exp, fuels, "left", ["item_code"]).filter(F.col("fuel").isNotNull())
    per_fuel = tagged.groupBy("hh_id", "fuel").agg(strict_sum("expenditures").alias("_e"))
    return pivot_fill(per_fuel, ["hh_id"], "fuel", "_e", keep, "exp_LCU_")


def exchange_rate(fx: DataFrame, country: str) -> Column:
    """The country's rate as a scalar; no row is fetched to the driver."""
    return (
        fx.filter(F.col("Country") == country).select(to_number("exchange_rate")).scalar()
    )


def to_reference_currency(
    sector_exp: DataFrame, fx: DataFrame, country: str, year: int = 2014, factor: Column | None = None
) -> DataFrame:
    """Spending per household and sector, converted, with the household's total."""
    rate = exchange_rate(fx, country)
    per_sector = sector_exp.groupBy("hh_id", "GTAP").agg(strict_sum("expenditures").alias("expenditures"))
    amount = F.col("expenditures") * rate if factor is None else F.col("expenditures") * factor * rate
    converted = per_sector.withColumn(f"expenditures_USD_{year}", amount)
    return with_totals(
        converted, ["hh_id"], {f"hh_expenditures_USD_{year}": strict_sum(f"expenditures_USD_{year}")}
    )


def totals_lcu(sector_exp: DataFrame) -> DataFrame:
    return sector_exp.groupBy("hh_id").agg(strict_sum("expenditures").alias("hh_expenditures_LCU"))


def cpi_long(cpi: DataFrame) -> DataFrame:
    """Year columns to (Country, year, rate); text that is no number is null."""
    years = [c for c in cpi.columns if c.isdigit()]
    long = to_long(cpi, ["Country"], years, "year", "pct")
    return long.select("Country", F.col("year").cast("int").alias("year"), (to_number("pct") / 100).alias("rate"))


def price_factors(cpi: DataFrame, target_year: int) -> DataFrame:
    """(Country, base_year, factor) that carries prices of every base year to the target year.

    Rates of the years between are compounded, as differences of one running log
    level per country; a later base year is deflated; a missing rate on the way
    makes the factor null.
    """
    rate, year = F.col("rate"), F.col("year")
    country = Window.partitionBy("Country")  # one row per year
    so_far = country.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    until_target = year <= target_year
    first, last = F.min("year").over(country), F.max("year").over(country)
    covered = (F.lit(target_year) >= first - 1) & (F.lit(target_year) <= last)
    level = cpi_long(cpi).select(
        "Country",
        year.alias("base_year"),
        F.coalesce(F.sum(F.ln(1 + rate)).over(so_far), F.lit(0.0)).alias("_log"),
        F.count_if(rate.isNull()).over(so_far).alias("_gaps"),
        F.coalesce(F.sum(F.when(until_target, F.ln(1 + rate))).over(country), F.lit(0.0)).alias("_log_t"),
        F.count_if(until_target & rate.isNull()).over(country).alias("_gaps_t"),
        covered.alias("_covered"),
    )
    return level.select(
        "Country",
        "base_year",
        F.when(
            F.col("_covered") & (F.col("_gaps") == F.col("_gaps_t")), F.exp(F.col("_log_t") - F.col("_log"))
        ).alias("factor"),
    )


def price_factor(cpi: DataFrame, country: str, base_year: int, target_year: int) -> Column:
    """One factor as a scalar."""
    one = price_factors(cpi.filter(F.col("Country") == country), target_year)
    return one.filter(F.col("base_year") == base_year).select("factor").scalar()
