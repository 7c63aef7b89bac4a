"""Registration: one column spec drives the final cast and rounding on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.bindings import Tables
from workload.oracle import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def parse(spec: str) -> list[tuple[str, str]]:
    """"name:kind ..." with kind i (integer), s (text), b (boolean) or decimals to round to."""
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def tidy(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in parse(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def tidy_sql(body: str, spec: str, extra: dict[str, str] | None = None) -> str:
    out = []
    for name, kind in parse(spec):
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "s":
            c = f"CAST({c} AS VARCHAR)"
        elif kind == "b":
            c = f"CAST({c} AS BOOLEAN)"
        else:
            c = f"round(CAST({c} AS DOUBLE), {kind}) + 0e0"
        out.append(f'{c} AS "{name}"')
    return oracle(f"SELECT {', '.join(out)} FROM ({body}) AS result", extra)


def register(
    name: str,
    spec: str,
    fn: Callable[[Tables], DataFrame],
    body: str | None = None,
    extra: dict[str, str] | None = None,
) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, sf_dir: tidy(fn(Tables(spark, sf_dir)), spec)
    if body is not None:
        ORACLES[name] = tidy_sql(body, spec, extra)


def query(name: str, spec: str, body: str | None = None, extra: dict[str, str] | None = None):
    def wrap(fn):
        register(name, spec, fn, body, extra)
        return fn

    return wrap
