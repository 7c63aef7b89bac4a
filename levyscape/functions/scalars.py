"""Scalar expressions used across the plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 97.5 % point of the standard normal, and the star cut-offs.
Z_975 = 1.959963984540054
STAR_CUTS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice; an unknown condition stays unknown."""
    return F.when(cond, yes).when(~cond, no)


def first_match(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """Ordered multi-branch choice; no branch gives ``default`` (null)."""
    out = F
    for cond, value in branches:
        out = out.when(cond, value)
    return out.otherwise(default)


def stars(p: str | Column) -> Column:
    """Significance stars for a p-value."""
    p = _col(p)
    return first_match([(p.isNull(), None)] + [(p <= cut, mark) for cut, mark in STAR_CUTS], "")


def replace_all(c: str | Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply regex replacements one after the other."""
    out = _col(c)
    for pattern, text in pairs:
        out = F.regexp_replace(out, pattern, text)
    return out


def prefix_rank(c: str | Column, prefixes: Sequence[str]) -> Column:
    """1-based position of the first listed prefix the text starts with, else n+1."""
    c = _col(c)
    return first_match(
        [(c.startswith(p), i) for i, p in enumerate(prefixes, 1)], len(prefixes) + 1
    ).cast("int")


def to_number(c: str | Column) -> Column:
    """Text to number; unreadable text is null."""
    return _col(c).try_cast("double")


def is_infinite(c: str | Column) -> Column:
    return F.abs(_col(c)) == F.lit(float("inf"))


def confidence_bounds(estimate: str | Column, error: str | Column) -> tuple[Column, Column]:
    """Lower and upper 95 % bound."""
    e, s = _col(estimate), _col(error)
    return e - Z_975 * s, e + Z_975 * s


def sign_label(c: str | Column) -> Column:
    return if_else(_col(c) < 0, "Negative", "Positive")
