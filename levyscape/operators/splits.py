"""Train/test splits that do not depend on how the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from levyscape.operators.ranking import ntile, ranked

# Multiplicative hash on the key (kept below 2**63 for any key).
_FOLD, _MULTIPLIER, _RANGE = 1_000_003, 2_654_435_761, 4_294_967_296


def key_hash(df: DataFrame, key: str) -> Column:
    """Number below 2**32 for a key: by multiplication for whole numbers, from a digest for all else."""
    if isinstance(df.schema[key].dataType, IntegralType):
        return (F.col(key) % _FOLD) * F.lit(_MULTIPLIER) % F.lit(_RANGE)
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, share: float = 0.75, out: str = "train") -> DataFrame:
    """True for about ``share`` of the keys."""
    return df.withColumn(out, key_hash(df, key) % 1000 < int(share * 1000))


def stratified_split(
    df: DataFrame, y: str, key: str, share: float = 0.7, strata: int = 5, out: str = "train"
) -> DataFrame:
    """``share`` of every outcome stratum, rounded up, in hash order."""
    tiled = ntile(df.filter(F.col(y).isNotNull()), y, strata, key, "_stratum").withColumn(
        "_hash", key_hash(df, key)
    )
    placed = ranked(tiled, "_hash", key, ["_stratum"], "_rn", "_n")
    return placed.withColumn(out, F.col("_rn") <= F.ceil(F.col("_n") * share)).drop(
        "_hash", "_rn", "_n", "_stratum"
    )
