"""The household mart: incidence, bins, shares, fuels and household attributes.

``assemble`` joins the separately computed parts. ``build_mart`` computes the
same table from one pass over the cleaned lines: sector, intensity, category and
fuel are attributes of the item, so all household sums come out of a single
aggregation on ``hh_id`` with one shuffle of partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join, ratio
from levyscape.operators.quality import CheckFailed, ambiguous_codes, any_infinite, collapse_lines, require, unmatched_codes
from levyscape.operators.reshape import first_per_key
from levyscape.operators.weighted import weighted_bins
from levyscape.plans.carbon import CARRIERS, OUTSIDE, PRICE, carbon_intensity, incidence
from levyscape.plans.households import household_frame, item_spending
from levyscape.plans.spending import DELETED, NON_MARKET, clean_spending, exchange_rate
from levyscape.sources.staging import stage, stage_observing


# Names of the gates.
NO_SECTOR, NO_CATEGORY, TWICE = "no sector", "no category", "two sectors or categories"


@dataclass(frozen=True)
class Survey:
    """The landed tables of one survey."""

    house: DataFrame
    persons: DataFrame
    assets: DataFrame
    items: DataFrame
    item_codes: DataFrame
    sector_map: DataFrame  # item_code, GTAP
    categories: DataFrame  # item_code, category
    fuels: DataFrame  # fuel, item_code
    sectors: DataFrame  # Number, GTAP, Explanation
    emissions: DataFrame
    fx: DataFrame
    country: str
    kept_categories: Sequence[str]
    kept_fuels: Sequence[str]
    year: int = 2014
    price_factor: Column | None = None  # carries the survey's prices to that year
    collapse: bool = False  # several lines of a household on one item are one purchase


def assemble(
    incidence_: DataFrame, bins: DataFrame, shares: DataFrame, fuels: DataFrame
) -> DataFrame:
    """Left joins on the household."""
    out = incidence_
    for part in (bins, shares, fuels):
        out = natural_join(out, part, "left", ["hh_id"], null_safe=False)
    return out


def final_mart(assembled: DataFrame, hh: DataFrame) -> DataFrame:
    return natural_join(assembled, hh, "left", ["hh_id"], null_safe=False)


def fuel_mart(fuels: DataFrame, totals: DataFrame) -> DataFrame:
    return natural_join(fuels, totals, "left", ["hh_id"], null_safe=False)


def item_attributes(survey: Survey) -> DataFrame:
    """One row per item: sector, intensities, category and the fuels it belongs to; what a line counts for as flags."""
    sector = natural_join(
        survey.sector_map, carbon_intensity(survey.sectors, survey.emissions), "left", ["GTAP"]
    )
    fuels = survey.fuels.groupBy("item_code").agg(F.collect_set("fuel").alias("fuels"))
    both = natural_join(sector, survey.categories, "full", ["item_code"])
    counted = F.col("GTAP").isNotNull() & (F.col("GTAP") != DELETED)
    emitting = counted & (F.col("GTAP") != OUTSIDE)
    market = F.col("category").isNotNull() & ~F.col("category").isin(*NON_MARKET)
    flags = {"_counted": counted, "_emits": emitting, "_market_item": market}
    flags |= {f"_is_{c}": market & (F.col("category") == c) for c in survey.kept_categories}
    flags |= {f"_burns_{f}": F.array_contains("fuels", f) for f in survey.kept_fuels}
    return stage(natural_join(both, fuels, "full", ["item_code"]).withColumns(flags))


def household_sums(cleaned: DataFrame, items: DataFrame, survey: Survey, rate: Column) -> DataFrame:
    """All per-household sums in one aggregation."""
    x, emitting = F.col("expenditures"), F.col("_emits")
    sums = [
        F.count_if(emitting).alias("_emitting"),
        F.sum(F.when(F.col("_counted"), x)).alias("hh_expenditures"),
        F.sum(F.when(F.col("_market_item"), x)).alias("_market"),
    ]
    for name in CARRIERS:
        intensity = F.col(f"CO2_t_per_dollar_{name}")
        sums.append(
            F.when(
                F.count_if(emitting & intensity.isNull()) == 0, F.sum(F.when(emitting, x * intensity))
            ).alias(f"_t_{name}")
        )
    sums += [
        F.sum(F.when(F.col(f"_is_{c}"), x)).alias(f"_cat_{c}")
        for c in survey.kept_categories
    ]
    sums += [
        F.sum(F.when(F.col(f"_burns_{f}"), x)).alias(f"exp_LCU_{f}")
        for f in survey.kept_fuels
    ]
    lines = natural_join(cleaned, items, "left", ["item_code"], null_safe=False)
    total = f"hh_expenditures_USD_{survey.year}"
    return (
        lines.groupBy("hh_id")
        .agg(*sums)
        .select(
            "hh_id",
            "_emitting",
            (F.col("hh_expenditures") * rate).alias(total),
            *[(F.col(f"_t_{name}") * rate).alias(f"CO2_t_{name}") for name in CARRIERS],
            "hh_expenditures",
            *[
                F.when(
                    F.col("_market").isNotNull(),
                    F.coalesce(ratio(f"_cat_{c}", "_market"), F.lit(0.0)),
                ).alias(f"share_{c}")
                for c in survey.kept_categories
            ],
            *[f"exp_LCU_{f}" for f in survey.kept_fuels],
        )
    )


def survey_lines(survey: Survey) -> DataFrame:
    """Item lines as the survey delivers them, or one per household and item."""
    lines = item_spending(survey.items, survey.item_codes)
    return collapse_lines(lines, ["hh_id", "item_code"], "expenditures_year") if survey.collapse else lines


def gate_reports(survey: Survey, lines: DataFrame) -> DataFrame:
    """(gate, item_code): items in use without a sector or a category, and items with two of either."""
    attributes = natural_join(survey.sector_map, survey.categories, "full", ["item_code"])
    reports = {
        NO_SECTOR: unmatched_codes(lines, survey.sector_map.select("item_code").distinct(), "item_code"),
        NO_CATEGORY: unmatched_codes(lines, survey.categories.select("item_code").distinct(), "item_code"),
        TWICE: ambiguous_codes(attributes, "item_code").select("item_code"),
    }
    out = None
    for gate, report in reports.items():
        part = report.select(F.lit(gate).alias("gate"), "item_code")
        out = part if out is None else out.unionByName(part)
    return out


def build_mart(
    survey: Survey,
    price: float = PRICE,
    ks: Sequence[int] = (2, 3, 5, 10),
    check: bool = True,
    on_unmatched: str = "stop",
) -> DataFrame:
    """The final mart, staged: every later table reads it several times.

    An item with two sectors or categories stops the build, and so do an item in use
    without a sector or a category (unless ``on_unmatched="drop"``, which leaves its
    spending out of the totals) and infinite tonnes.
    """
    if on_unmatched not in ("stop", "drop"):
        raise ValueError(on_unmatched)
    attributes = item_attributes(survey)
    lines = survey_lines(survey)
    if check:
        bad = gate_reports(survey, lines)
        require(bad if on_unmatched == "stop" else bad.filter(F.col("gate") == TWICE), "item")
    house = first_per_key(survey.house, "hh_id", ["hh_id"])
    hh = household_frame(house, survey.persons, survey.assets)
    cleaned = clean_spending(lines, house)
    rate = exchange_rate(survey.fx, survey.country)
    if survey.price_factor is not None:
        rate = rate * survey.price_factor
    sums = household_sums(cleaned, attributes, survey, rate)
    basic = natural_join(sums, hh, "left", ["hh_id"], null_safe=False).withColumn(
        "hh_expenditures_pc", ratio("hh_expenditures", "hh_size")
    )
    # Bins cover every household with counted spending, emitting or not.
    infinite = any_infinite([f"CO2_t_{name}" for name in CARRIERS])
    staged, seen = stage_observing(basic.filter(F.col("hh_expenditures").isNotNull()), infinite=infinite)
    if check and seen.get("infinite"):
        raise CheckFailed("infinite tonnes: check the intensities")
    binned = weighted_bins(staged, "hh_expenditures_pc", "hh_weights", ks, "Income_Group_")
    return incidence(binned.filter(F.col("_emitting") > 0), price, survey.year).drop("_emitting")
