"""Design matrices with a first-level baseline, and states folded over their rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A column is an alias of earlier ones if what they leave of its length is at most this share.
ALIAS_TOLERANCE = 1e-7


@dataclass(frozen=True)
class Factor:
    """A categorical predictor; the first level that occurs is the baseline."""

    column: str
    levels: tuple[str, ...]


@dataclass(frozen=True)
class ModelSpec:
    numeric: tuple[str, ...] = ()
    factors: tuple[Factor, ...] = ()

    @property
    def predictors(self) -> list[str]:
        return [*self.numeric, *[f.column for f in self.factors]]

    def without(self, *columns: str) -> ModelSpec:
        return ModelSpec(
            tuple(c for c in self.numeric if c not in columns),
            tuple(f for f in self.factors if f.column not in columns),
        )


@dataclass(frozen=True)
class Term:
    """One design column: a numeric predictor, or an indicator for ``level``."""

    name: str
    column: str
    level: str | None = None

    def expr(self) -> Column:
        if self.level is None:
            return F.col(self.column).cast("double")
        return (F.col(self.column) == F.lit(self.level)).cast("double")


def all_terms(spec: ModelSpec) -> list[Term]:
    """Every numeric column and every level of every factor."""
    terms = [Term(c, c) for c in spec.numeric]
    for f in spec.factors:
        terms += [Term(f"{f.column}{level}", f.column, level) for level in f.levels]
    return terms


def complete_cases(df: DataFrame, spec: ModelSpec, *others: str) -> DataFrame:
    """Rows without a missing (or, for a factor, unlisted) predictor or outcome."""
    out = df.na.drop("any", subset=[*spec.predictors, *others])
    for f in spec.factors:
        out = out.filter(F.col(f.column).isin(*f.levels))
    return out


def reduced(df: DataFrame, columns: Sequence[Column], add, merge) -> np.ndarray | None:
    """One state (a vector) for all rows of the listed columns, None without rows.

    A task folds its blocks ``X`` with ``add(state or None, X)`` and emits one packed row;
    these rows are shuffled and merged with ``merge(state, state)``, in as many tasks as
    their bytes ask for. The driver merges one state per such task.
    """
    k = len(columns)

    def fold(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                state = add(state, x)
        if state is not None:
            yield packed(TaskContext.get().partitionId(), state)

    def join(batches):
        state = None
        for batch in batches:
            for other in batch.column(1):
                other = np.frombuffer(other.as_py())
                state = other if state is None else merge(state, other)
        if state is not None:
            yield packed(0, state)

    def packed(task, state):
        return pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int32()), pa.array([state.astype(float).tobytes()], pa.binary())], names=["task", "state"]
        )

    schema = "task int, state binary"
    parts = df.select(F.array(*columns).alias("x")).mapInArrow(fold, schema)
    states = [np.frombuffer(r.state) for r in parts.repartition("task").mapInArrow(join, schema).collect()]
    return functools.reduce(merge, states) if states else None


def summed_matrix(df: DataFrame, columns: Sequence[Column], partial, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of ``partial(X)`` for blocks ``X`` of the listed columns."""

    def add(state, x):
        part = partial(x).ravel()
        return part if state is None else state + part

    total = reduced(df, columns, add, lambda a, b: a + b)
    return np.zeros(shape) if total is None else total.reshape(shape)


def triangle(x: np.ndarray) -> np.ndarray:
    """Triangular factor of ``x``, square also where ``x`` has fewer rows than columns."""
    r = np.linalg.qr(x, mode="r")
    return np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))])


def tall_factor(df: DataFrame, columns: Sequence[Column]) -> tuple[int, np.ndarray]:
    """(rows, R) of the QR factors of the listed columns.

    Every task keeps a triangle and factors it anew with each block beneath it, and
    triangles are merged the same way, so that no cross product squares the condition.
    """
    k = len(columns)

    def stacked(n, r, below):
        return np.concatenate(([n], triangle(np.vstack([r, below])).ravel()))

    def add(state, x):
        n, r = (0, np.zeros((0, k))) if state is None else (state[0], state[1:].reshape(k, k))
        return stacked(n + len(x), r, x)

    def merge(a, b):
        return stacked(a[0] + b[0], a[1:].reshape(k, k), b[1:].reshape(k, k))

    state = reduced(df, columns, add, merge)
    return (0, np.zeros((k, k))) if state is None else (int(state[0]), state[1:].reshape(k, k))


def independent(r: np.ndarray, terms: Sequence[Term]) -> tuple[list[int], list[int]]:
    """Places (kept, aliased) in a factor of (intercept, terms, ...); the intercept is not listed.

    Unused levels vanish, the first used level is the baseline, and a column that is a
    combination of earlier ones is set aside.
    """
    size = np.linalg.norm(r, axis=0)
    basis = np.zeros((len(r), 0))
    kept, aliased, baseline = [], [], set()
    for at, t in enumerate([None, *terms]):
        if t is not None and t.level is not None:
            if size[at] == 0:
                continue
            if t.column not in baseline:
                baseline.add(t.column)
                continue
        rest = r[:, at]
        for _ in range(2):  # the second projection removes what rounding left of the first
            rest = rest - basis @ (basis.T @ rest)
        length = np.linalg.norm(rest)
        if length > ALIAS_TOLERANCE * size[at]:
            basis = np.column_stack([basis, rest / length])
            kept.append(at)
        else:
            aliased.append(at)
    return [at for at in kept if at], [at for at in aliased if at]


def usable_terms(df: DataFrame, spec: ModelSpec) -> tuple[list[Term], list[Term]]:
    """(kept, aliased) terms of the specification on these rows."""
    terms = all_terms(spec)
    _, r = tall_factor(df, design_columns(terms))
    return tuple([terms[at - 1] for at in places] for places in independent(r, terms))


def design_columns(terms: Sequence[Term]) -> list[Column]:
    """Intercept and terms."""
    return [F.lit(1.0), *[t.expr() for t in terms]]
