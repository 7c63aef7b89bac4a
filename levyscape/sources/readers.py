"""Readers for the landed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTOR_LIST = T.StructType(
    [
        T.StructField("Number", T.IntegerType()),
        T.StructField("GTAP", T.StringType()),
        T.StructField("Explanation", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Columnar table; column pruning and filters reach the scan."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";"
) -> DataFrame:
    """Header row, trimmed fields, quoted fields may hold the separator; CRLF is fine."""
    return spark.read.schema(schema).csv(
        path,
        sep=sep,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, sep=",")


def read_headerless(spark: SparkSession, path: str, n_columns: int, sep: str = ",") -> DataFrame:
    """Text columns X1..Xn."""
    schema = T.StructType([T.StructField(f"X{i}", T.StringType()) for i in range(1, n_columns + 1)])
    return spark.read.schema(schema).csv(path, sep=sep, header=False)


def read_country(
    spark: SparkSession, path: str, country: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One country of a table partitioned by ``country``: the filter prunes partitions."""
    return read_table(spark, path, schema).filter(F.col("country") == country).drop("country")


def drop_row_index(df: DataFrame) -> DataFrame:
    """Remove the leading row-index column some exporters write."""
    return df.drop(df.columns[0])


def columns_between(df: DataFrame, first: str, last: str) -> Sequence[str]:
    """Names from ``first`` to ``last`` inclusive, in table order."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]
