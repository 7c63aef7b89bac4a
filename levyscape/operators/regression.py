"""Least squares, logit and average marginal effects.

Spark folds the rows into triangular factors and sums; the driver sees coefficients and
k x k matrices only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from levyscape.functions.nulls import strict_mean
from levyscape.functions.scalars import (
    confidence_bounds,
    prefix_rank,
    replace_all,
    sign_label,
    stars,
)
from levyscape.functions.survey_codes import CAPTION_ORDER, TERM_CAPTIONS
from levyscape.operators.design import (
    ModelSpec,
    Term,
    all_terms,
    complete_cases,
    design_columns,
    independent,
    reduced,
    summed_matrix,
    tall_factor,
    triangle,
)
from levyscape.operators.ranking import ntile
from levyscape.operators.reshape import pivot_fill

INTERCEPT = "(Intercept)"
COEF_SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double"


@dataclass(frozen=True)
class FittedModel:
    kind: str  # "ols" or "logit"
    y: str
    spec: ModelSpec
    terms: list[Term]
    aliased: list[Term]
    coefficients: list[float]  # intercept first
    errors: list[float | None]
    statistics: list[float | None]
    p_values: list[float | None]
    fit: dict = field(default_factory=dict)
    growing: list[str] = field(default_factory=list)  # terms that separate the outcomes

    def table(self, spark: SparkSession) -> DataFrame:
        """Coefficient table, intercept first; aliased terms have no estimate."""
        names = [INTERCEPT, *[t.name for t in self.terms]]
        rows = list(zip(names, self.coefficients, self.errors, self.statistics, self.p_values, strict=True))
        rows += [(t.name, None, None, None, None) for t in self.aliased]
        return spark.createDataFrame(rows, COEF_SCHEMA)

    def link(self) -> Column:
        """Linear predictor; a row with a missing predictor gets null."""
        out = F.lit(self.coefficients[0])
        for beta, term in zip(self.coefficients[1:], self.terms, strict=True):
            out = out + F.lit(beta) * term.expr()
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Score rows with a plain expression, so scoring stays in generated code."""
        value = self.link()
        if self.kind == "logit":
            value = 1 / (1 + F.exp(-value))
        for f in self.spec.factors:
            value = F.when(F.col(f.column).isin(*f.levels), value)
        return df.withColumn(out, value)


def _positive(values: np.ndarray) -> list[float | None]:
    return [float(v) if v > 0 else None for v in values]


def _ratios(above: Sequence[float], below: Sequence[float | None]) -> list[float | None]:
    return [a / b if b else None for a, b in zip(above, below, strict=True)]


def ols(df: DataFrame, y: str, spec: ModelSpec) -> FittedModel:
    """Ordinary least squares on the complete rows, from one QR pass over them."""
    rows = complete_cases(df.select(y, *spec.predictors), spec, y)
    terms = all_terms(spec)
    n, r = tall_factor(rows, [*design_columns(terms), F.col(y).cast("double")])
    if n == 0:
        raise ValueError("no complete row")
    kept, aliased = independent(r[:, :-1], terms)
    k = len(kept) + 1
    solved = triangle(r[:, [0, *kept, -1]])
    inverse = np.linalg.inv(solved[:k, :k])
    beta = (inverse @ solved[:k, k]).tolist()
    rss, tss = solved[k, k] ** 2, triangle(r[:, [0, -1]])[1, 1] ** 2
    dof = n - k
    errors = _positive(np.sqrt((inverse**2).sum(axis=1) * rss / dof)) if dof > 0 else [None] * k
    t = _ratios(beta, errors)
    r2 = 1 - rss / tss if tss > 0 else None
    return FittedModel(
        "ols",
        y,
        spec,
        [terms[at - 1] for at in kept],
        [terms[at - 1] for at in aliased],
        beta,
        errors,
        t,
        [None if v is None else student_p(v, dof) for v in t],
        {
            "r2": r2,
            "r2adj": 1 - (1 - r2) * (n - 1) / dof if r2 is not None and dof > 0 else None,
            "rmse": math.sqrt(rss / n),
            "n": n,
        },
    )


def logit(df: DataFrame, y: str, spec: ModelSpec, max_iter: int = 50) -> FittedModel:
    """Logistic regression on the complete rows, see ``logits``."""
    return logits(df, {y: (y, F.lit(True))}, spec, max_iter)[y]


# a step that would lower the deviance by less than this share of it is the last
NEWTON_TOLERANCE = 1e-12
# a direction along which no row loses more than this share of what the best row gains separates the outcomes
SEPARATION_TOLERANCE = 1e-6
MAX_HALVINGS = 30
MIN_WEIGHT = 1e-16


@dataclass
class _Newton:
    """One model between two passes; vectors are laid out as (intercept, all terms)."""

    beta: np.ndarray
    step: np.ndarray
    before: np.ndarray
    deviance: float = math.inf
    halvings: int = 0
    passes: int = 0
    status: str = "open"
    kept: list[int] | None = None
    aliased: list[int] | None = None
    n: float = 0.0
    hits: float = 0.0
    covariance: np.ndarray | None = None

    def advance(self, state: np.ndarray, terms: Sequence[Term]) -> None:
        """Take in what a pass found at ``beta`` and choose the next ``beta``."""
        size = len(self.beta) + 1
        self.n, self.hits, deviance, worst, best = state[:5]
        r = state[5:].reshape(size, size)
        self.passes += 1
        if not deviance <= self.deviance * (1 + 1e-9) + 1e-9 and self.halvings < MAX_HALVINGS:
            self.halvings += 1
            self.step = self.step / 2
            self.beta = self.before + self.step
            return
        self.deviance, self.halvings = deviance, 0
        if self.kept is None:
            self.kept, self.aliased = independent(r[:, :-1], terms)
        at = [0, *self.kept]
        solved = triangle(r[:, [*at, -1]])[: len(at)]
        inverse = np.linalg.pinv(solved[:, :-1])
        self.covariance = inverse @ inverse.T
        if best > 0 and worst >= -SEPARATION_TOLERANCE * best:
            self.status = "separated"
            return
        gain = float(solved[:, -1] @ solved[:, -1])
        self.before, self.step = self.beta, np.zeros(size - 1)
        self.step[at] = inverse @ solved[:, -1]
        self.beta = self.beta + self.step
        if gain <= NEWTON_TOLERANCE * (deviance + 0.1):
            self.status = "converged"


def logits(
    df: DataFrame, models: Mapping[str, tuple[str, Column]], spec: ModelSpec, max_iter: int = 50
) -> dict[str, FittedModel]:
    """Logistic regressions of one specification, each name with its outcome and its rows.

    All models take their Newton steps in the same passes: a pass gives, for every model
    still open, its deviance and the QR factor of its weighted design with the weighted
    residuals. Each model stops by itself: ``converged``; ``separated``, when its last step
    moves every row towards its outcome, so that the estimates grow without end (``growing``
    names the terms that do); or neither after ``max_iter`` passes.
    """
    terms = all_terms(spec)
    k = len(terms) + 1
    names = [f"_y{i}" for i in range(len(models))]
    outcomes = [
        F.when(rows & F.col(y).isNotNull(), F.col(y).cast("double")).otherwise(-1.0).alias(name)
        for name, (y, rows) in zip(names, models.values(), strict=True)
    ]
    rows = complete_cases(df, spec).select(*dict.fromkeys(spec.predictors), *outcomes)
    rows = rows.filter(F.greatest(F.lit(-1.0), *names) >= 0).persist(StorageLevel.MEMORY_AND_DISK)
    fits = {name: _Newton(np.zeros(k), np.zeros(k), np.zeros(k)) for name in models}
    try:
        for _ in range(max_iter):
            open_ = [name for name, fit in fits.items() if fit.status == "open"]
            if not open_:
                break
            labels = [F.col(names[list(models).index(name)]) for name in open_]
            add, merge = _newton_pass(k, [(fits[m].beta, fits[m].step) for m in open_])
            state = reduced(rows, [*design_columns(terms), *labels], add, merge)
            found = np.zeros((len(open_), 1)) if state is None else state.reshape(len(open_), -1)
            for name, mine in zip(open_, found, strict=True):
                if mine[0] == 0:
                    raise ValueError(f"no complete row for {name}")
                fits[name].advance(mine, terms)
    finally:
        rows.unpersist()
    return {name: _fitted(models[name][0], spec, terms, fit) for name, fit in fits.items()}


def _newton_pass(k: int, models: Sequence[tuple[np.ndarray, np.ndarray]]):
    """(add, merge) for rows (design of k columns, one outcome per model; -1: not its row).

    A model's state: rows, hits, deviance, least and largest gain of a row by the last
    step, factor of (weighted design, weighted residual).
    """
    width = 5 + (k + 1) ** 2

    def joined(a, b):
        out = a.copy()
        out[:, :3] += b[:, :3]
        out[:, 3], out[:, 4] = np.minimum(a[:, 3], b[:, 3]), np.maximum(a[:, 4], b[:, 4])
        for i in range(len(models)):
            if a[i, 0] and b[i, 0]:
                out[i, 5:] = triangle(np.vstack([a[i, 5:].reshape(-1, k + 1), b[i, 5:].reshape(-1, k + 1)])).ravel()
            elif b[i, 0]:
                out[i, 5:] = b[i, 5:]
        return out

    def add(state, block):
        new = np.zeros((len(models), width))
        new[:, 3], new[:, 4] = np.inf, -np.inf
        for i, (beta, step) in enumerate(models):
            mine = block[:, k + i] >= 0
            if not mine.any():
                continue
            x, y = block[mine, :k], block[mine, k + i]
            side, eta = 2 * y - 1, x @ beta
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            root = np.sqrt(np.maximum(p * (1 - p), MIN_WEIGHT))
            gains = side * (x @ step)
            new[i, :5] = len(x), y.sum(), 2 * np.logaddexp(0, -side * eta).sum(), gains.min(), gains.max()
            new[i, 5:] = triangle(np.column_stack([x * root[:, None], (y - p) / root])).ravel()
        return (new if state is None else joined(state.reshape(new.shape), new)).ravel()

    def merge(a, b):
        return joined(a.reshape(len(models), width), b.reshape(len(models), width)).ravel()

    return add, merge


def _fitted(y: str, spec: ModelSpec, terms: Sequence[Term], fit: _Newton) -> FittedModel:
    at = [0, *fit.kept]
    beta = fit.beta[at].tolist()
    errors = _positive(np.sqrt(np.maximum(np.diag(fit.covariance), 0)))
    z = _ratios(beta, errors)
    n, hits = fit.n, fit.hits
    null = -2 * sum(m * math.log(m / n) for m in (hits, n - hits) if m > 0)
    moves = np.abs(fit.step)
    growing = [terms[i - 1].name for i in fit.kept if moves[i] > 1e-3 * moves.max()]
    return FittedModel(
        "logit",
        y,
        spec,
        [terms[i - 1] for i in fit.kept],
        [terms[i - 1] for i in fit.aliased],
        beta,
        errors,
        z,
        [None if v is None else normal_p(v) for v in z],
        {
            "deviance": fit.deviance,
            "null_deviance": null,
            "pseudo_r2": 1 - fit.deviance / null if null else None,
            "aic": fit.deviance + 2 * len(at),
            "iterations": fit.passes,
            "converged": fit.status == "converged",
            "separated": fit.status == "separated",
            "n": int(n),
        },
        growing if fit.status == "separated" else [],
    )


def normal_p(z: float) -> float:
    """Two-sided normal tail probability."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, dof: float) -> float:
    """Two-sided tail probability of Student's t: the incomplete beta function of dof/2 and 1/2."""
    if dof > 1e7:  # the normal one, to all digits that the logarithms below would keep
        return normal_p(t)
    a, b, x, rest = dof / 2, 0.5, dof / (dof + t * t), t * t / (dof + t * t)
    if x <= 0 or rest <= 0:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, rest) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards until it settles."""
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / (1 + term * d), 1 + term / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def fit_table(models: Mapping[str, FittedModel], spark: SparkSession) -> DataFrame:
    """Fit statistics of several models as (model, statistic, value) rows."""
    rows = [
        (name, stat, float(value))
        for name, m in models.items()
        for stat, value in m.fit.items()
        if value is not None
    ]
    return spark.createDataFrame(rows, "model string, statistic string, value double")


def star_table(coefficients: DataFrame) -> DataFrame:
    """Name, estimate, error and stars of every term."""
    return coefficients.select(
        F.col("term").alias("variable_name"),
        F.col("estimate").alias("intercept"),
        F.col("std_error").alias("standard_error"),
        stars("p_value").alias("signif"),
    )


CONVERGED = "(converged)"


def compare_models(models: Mapping[str, FittedModel], spark: SparkSession) -> DataFrame:
    """Estimates side by side: one row per term, one column per model.

    A last row tells which fits converged (1) and which did not (0), as those of
    separated data: their estimates are no more than the last iteration's.
    """
    rows = [(CONVERGED, float(m.fit.get("converged", True)), name) for name, m in models.items()]
    stacked = spark.createDataFrame(rows, "term string, estimate double, model string")
    for name, m in models.items():
        part = m.table(spark).select("term", "estimate", F.lit(name).alias("model"))
        stacked = stacked.unionByName(part)
    return pivot_fill(stacked, ["term"], "model", "estimate", list(models), agg=F.max)


def top_decile_flag(
    df: DataFrame, y: str, tie: str = "hh_id", by: Sequence[str] = (), out: str = "burden_decile"
) -> DataFrame:
    """True for the tenth of rows with the highest ``y``, overall or within ``by``."""
    tiled = ntile(df, y, 10, tie, "_t", by)
    return tiled.withColumn(out, F.col("_t") == 10).drop("_t")


def average_marginal_effects(model: FittedModel, df: DataFrame, contrast: str = "observed") -> DataFrame:
    """Mean effect of every term on the predicted probability, with delta-method errors.

    Numeric: mean derivative. Indicator: mean difference between the indicator
    set to 1 and to 0, the other indicators of its factor as observed, or all 0
    with ``contrast="clean"``. One pass gives effects, gradients and information.
    """
    if contrast not in ("observed", "clean"):
        raise ValueError(contrast)
    rows = complete_cases(df.select(model.y, *model.spec.predictors), model.spec, model.y)
    beta = np.asarray(model.coefficients)
    k = len(beta)
    dummy = np.array([t.level is not None for t in model.terms])
    factor = [t.column if t.level is not None else None for t in model.terms]
    siblings = [
        [j + 1 for j, f in enumerate(factor) if f is not None and f == factor[i]]
        if contrast == "clean" and factor[i]
        else [i + 1]
        for i in range(k - 1)
    ]

    def work(x):
        eta = x @ beta
        p = 1 / (1 + np.exp(-eta))
        dens = p * (1 - p)
        out = np.zeros((2 * k, k + 1))
        out[:k, :k] = x.T @ (x * dens[:, None])  # information
        slope = (dens * (1 - 2 * p)) @ x  # sum f'(eta) x
        out[k, 0], out[k, k] = len(x), dens.sum()
        for i in range(k - 1):
            at, row = i + 1, k + 1 + i
            if not dummy[i]:
                out[row, :k] = slope * beta[at]
                out[row, at] += dens.sum()
                out[row, k] = dens.sum() * beta[at]
                continue
            group = siblings[i]
            base = eta - x[:, group] @ beta[group]
            p1, p0 = 1 / (1 + np.exp(-(base + beta[at]))), 1 / (1 + np.exp(-base))
            f1, f0 = p1 * (1 - p1), p0 * (1 - p0)
            grad = (f1 - f0) @ x
            grad[group] = 0.0
            grad[at] = f1.sum()
            out[row, :k] = grad
            out[row, k] = (p1 - p0).sum()
        return out

    total = summed_matrix(rows, design_columns(model.terms), work, (2 * k, k + 1))
    n = total[k, 0]
    cov = np.linalg.pinv(total[:k, :k], hermitian=True)
    table = []
    for i, t in enumerate(model.terms):
        row = total[k + 1 + i]
        grad, effect = row[:k] / n, float(row[k] / n)
        error = float(np.sqrt(max(grad @ cov @ grad, 0.0)))
        table.append((t.name, effect, error, normal_p(effect / error) if error > 0 else None))
    effects = df.sparkSession.createDataFrame(
        table, "factor string, AME double, std_error double, p double"
    )
    lower, upper = confidence_bounds("AME", "std_error")
    return effects.withColumns({"lower": lower, "upper": upper, "effect": sign_label("AME")})


def caption_terms(
    effects: DataFrame, exclude: Sequence[str] = (), term: str = "factor", value: str = "AME"
) -> DataFrame:
    """Readable captions, ordered by caption group and then by effect.

    ``exclude`` names terms (not captions) to leave out; ``position`` is the
    display order, counted over the handful of terms of one model.
    """
    kept = effects.filter(~F.col(term).isin(*exclude)) if exclude else effects
    captioned = kept.withColumn("caption", replace_all(term, TERM_CAPTIONS))
    ranked_ = captioned.withColumn("prefix_order", prefix_rank("caption", CAPTION_ORDER))
    return ranked_.orderBy("prefix_order", value)


def simple_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Straight line through (x, y): equation and fit."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def prediction_errors(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """MSE, MAE and RMSE; a missing prediction makes them unknown."""
    gap = F.col(y) - F.col(prediction)
    mse = strict_mean(gap * gap)
    return df.agg(mse.alias("mse"), strict_mean(F.abs(gap)).alias("mae"), F.sqrt(mse).alias("rmse"))


def transfer_quality(model: FittedModel, df: DataFrame) -> DataFrame:
    """How a model fitted elsewhere does on ``df``.

    ``r2_refit`` is the fit of the same specification estimated anew on ``df``;
    ``r2_predictive`` compares the transferred predictions with the outcomes.
    """
    rows = complete_cases(df, model.spec, model.y)
    refit = ols(rows, model.y, model.spec).fit["r2"]
    scored = model.predict(rows)
    gap = F.col(model.y) - F.col("prediction")
    return scored.agg(
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.lit(refit).alias("r2_refit"),
        (1 - F.sum(gap * gap) / (F.var_pop(model.y) * F.count(F.lit(1)))).alias("r2_predictive"),
    )
