"""Code books: survey codes to labels, ordered categories and indicator columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CategorySpec:
    """How one coded column becomes an ordered category; ``levels[0]`` is the baseline.

    A code without a label gives ``default`` (null if none). Codes in ``drop``
    remove the row where a plan counts the attribute, as does an unlisted code
    when ``drop_unlisted`` is set.
    """

    column: str
    labels: Mapping[int, str]
    levels: tuple[str, ...]
    default: str | None = None
    drop: tuple[int, ...] = field(default=())
    drop_unlisted: bool = False


def label_of(code: str | Column, labels: Mapping, default: str | None = None) -> Column:
    """Code to label. A missing code stays missing even where there is a default."""
    code = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(x) for item in labels.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), code)
    if default is not None:
        found = F.coalesce(found, F.lit(default))
    return F.when(code.isNotNull(), found)


def within(label: Column, levels: Sequence[str]) -> Column:
    """Keep a label that is one of the levels; anything else is null."""
    return F.when(label.isin(*levels), label)


def ordinal(label: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of the label among the levels, null outside."""
    label = F.col(label) if isinstance(label, str) else label
    return label_of(label, {name: i for i, name in enumerate(levels, 1)}).cast("int")


def recoded(spec: CategorySpec, code: Column | None = None) -> Column:
    code = F.col(spec.column).cast("int") if code is None else code
    return within(label_of(code, spec.labels, spec.default), spec.levels)


def recode(df: DataFrame, specs: Sequence[CategorySpec], ordinals: bool = False) -> DataFrame:
    """Replace coded columns by their labels; optionally add ``<column>_ord``."""
    out = df.withColumns({s.column: recoded(s) for s in specs})
    if ordinals:
        out = out.withColumns({f"{s.column}_ord": ordinal(s.column, s.levels) for s in specs})
    return out


def one_hot(df: DataFrame, indicators: Mapping[str, tuple[str, Sequence]], keep: Sequence[str]) -> DataFrame:
    """0/1 columns: 1 where the column has one of the codes, null where it is missing."""
    return df.select(
        *keep,
        *[
            F.when(F.col(c).isNotNull(), F.col(c).isin(*codes).cast("double")).alias(name)
            for name, (c, codes) in indicators.items()
        ],
    )


def spread(groups: Mapping[str, Sequence[int]]) -> dict[int, str]:
    """{label: codes} to {code: label}."""
    return {code: label for label, codes in groups.items() for code in codes}
