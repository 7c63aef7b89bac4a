"""Household, person and item tables in analysis shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.functions.nulls import natural_join
from levyscape.operators.reshape import first_per_key, move_last


def composition(persons: DataFrame, key: str = "hh_id") -> DataFrame:
    """Adults (18 and over) and children; an unknown age is neither."""
    return persons.groupBy(key).agg(
        F.count_if(F.col("age") >= 18).alias("adult"), F.count_if(F.col("age") < 18).alias("child")
    )


def adult_equivalents(members: DataFrame) -> DataFrame:
    """First adult 1, further adults 0.5, children 0.3."""
    return members.withColumn("adulteq", F.col("adult") * 0.5 + 0.5 + F.col("child") * 0.3)


def heads(persons: DataFrame, columns: Sequence[str], key: str = "hh_id") -> DataFrame:
    """Attributes of the household head; members of unknown relation are left out."""
    return persons.filter(F.col("relationhhh") <= 1).select(key, *columns)


def household_frame(
    house: DataFrame,
    persons: DataFrame,
    assets: DataFrame,
    key: str = "hh_id",
    with_composition: bool = False,
) -> DataFrame:
    """Households, the head's education and the assets, fully outer joined.

    The key is never missing, so plain equality is used: every join then has the
    same partitioning and each input is shuffled once.
    """
    unique = first_per_key(house, key, [key])
    members = natural_join(heads(persons, ["education_hhh"], key), assets, "full", [key], null_safe=False)
    if with_composition:
        members = natural_join(adult_equivalents(composition(persons, key)), members, "full", [key], null_safe=False)
    frame = natural_join(unique, members, "full", [key], null_safe=False)
    return move_last(frame, "gender_hhh", "ethnicity_hhh")


def item_spending(items: DataFrame, codes: DataFrame) -> DataFrame:
    """Replace the classification code by the item code; unlisted codes are left out."""
    return natural_join(items, codes, "inner", ["coicop"], null_safe=False).drop("coicop", "label")
