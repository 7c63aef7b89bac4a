"""Energy sources of households, made comparable between surveys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscape.functions.codebook import CategorySpec, label_of, ordinal, recode, recoded, within
from levyscape.functions.nulls import natural_join
from levyscape.functions.scalars import first_match
from levyscape.functions.survey_codes import (
    ELECTRICITY_LEVELS,
    MIX_SPECS,
    MODEL_SPECS,
    PROVINCE,
    PROVINCE_LEVELS,
    TRANSFER_FACTORS,
    TRANSFER_MAINS_LEVELS,
)
from levyscape.operators.reshape import share_of, surrogate_join
from levyscape.operators.ranking import surrogate_index


def electricity_source() -> Column:
    """No access before mains before solar before anything else; nothing known is null."""
    source = F.col("electricitysource")
    return first_match(
        [
            (F.col("electricitycon") == 2, "No Access"),
            (F.col("electricitymains") == 1, "Mains"),
            (source == 4, "Solar Energy"),
            (source.isin(1, 2, 3, 5, 6) | (source > 6), "Other"),
        ]
    )


def with_electricity_source(df: DataFrame) -> DataFrame:
    return df.withColumn("electricitysource", within(electricity_source(), ELECTRICITY_LEVELS))


def mix_label(spec: CategorySpec) -> Column:
    """Label of one energy attribute; a mains connection settles the electricity source."""
    label = recoded(spec)
    if spec.column == "electricitysource":
        return F.when(F.col("electricitymains") == 1, F.lit("Mains")).otherwise(label)
    return label


def mix_rows(df: DataFrame, survey: str, attribute: str) -> DataFrame:
    """Rows that count for the attribute: special codes (and missing values) are left out."""
    spec = MIX_SPECS[survey][attribute]
    if spec.drop_unlisted:
        return df.filter(mix_label(spec).isNotNull())
    if spec.drop:
        return df.filter(~F.col(attribute).isin(*spec.drop))
    return df


def energy_mix(df: DataFrame, survey: str, attribute: str, by: Sequence[str]) -> DataFrame:
    """Share of each source within the group. An unlisted code is a source of its own (null)."""
    spec = MIX_SPECS[survey][attribute]
    counts = (
        mix_rows(df, survey, attribute)
        .groupBy(*by, mix_label(spec).alias(attribute))
        .agg(F.count(F.lit(1)).alias("amount"))
    )
    return share_of(counts, "amount", by, "perc").select(*by, attribute, "perc")


def province_label() -> Column:
    return within(label_of(F.col("province").cast("int"), PROVINCE), PROVINCE_LEVELS)


def harmonise(df: DataFrame, survey: str, ordinals: bool = False) -> DataFrame:
    """Province and the six energy attributes under one set of labels for survey A or C."""
    specs = MIX_SPECS[survey]
    labels = {"province": province_label(), **{a: mix_label(s) for a, s in specs.items()}}
    out = df.withColumns(labels).withColumn("survey", F.lit(survey))
    if ordinals:
        out = out.withColumns({f"{a}_ord": ordinal(a, s.levels) for a, s in specs.items()})
    return out


def transfer_factors(df: DataFrame, survey: str) -> DataFrame:
    """The factors that surveys A and B share, under one set of labels.

    B does not ask for mains: its connection to electricity stands for it.
    """
    mains = F.col({"A": "electricitymains", "B": "electricitycon"}[survey])
    yes, no = TRANSFER_MAINS_LEVELS
    out = df.withColumn("electricitymains", F.when(mains == 1, yes).when(mains > 1, no))
    return recode(out, [s for s in MODEL_SPECS if s.column in TRANSFER_FACTORS])


def renumber(df: DataFrame, key: str = "hh_id") -> DataFrame:
    """Replace household ids by 1..n."""
    keys = surrogate_index(df, key, "hh_id_new")
    return surrogate_join(df, keys, key, "hh_id_new")
