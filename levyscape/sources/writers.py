"""Sinks. Tables are written by the executors, never gathered first, and carry no row index."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, quote='"', escape='"')


def write_by_country(df: DataFrame, path: str, country: str = "country") -> None:
    """One output folder per country; folders of countries that df does not hold stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(country).parquet(path)
