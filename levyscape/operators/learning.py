"""Random forest, standardisation and k-means on indicator columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscape.functions.scalars import replace_all
from levyscape.functions.survey_codes import INDICATOR_PREFIXES, INDICATOR_WORDS
from levyscape.operators import clusters, forests
from levyscape.operators.reshape import transpose_summary
from levyscape.sources.staging import stage


# The deepest tree that is grown: trees end by their smallest leaf, not by their depth.
MAX_DEPTH = 30


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Complete rows with their feature vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(
        df.na.drop("any", subset=list(columns))
    )


def _coded(df: DataFrame, columns: Sequence[str], **others: str) -> DataFrame:
    """Complete rows: the other columns by their new names, then x0, x1, ..."""
    rows = df.na.drop("any", subset=list(columns))
    return rows.select(*[F.col(c).alias(n) for n, c in others.items()], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def _training(df: DataFrame, y: str, columns: Sequence[str]) -> tuple[forests.Code, DataFrame]:
    rows = _coded(df, columns, y=y).withColumn("y", F.col("y").cast("double"))
    code = forests.code_of(rows, [f"x{i}" for i in range(len(columns))])
    return code, forests.packed_rows(rows, code, ["y"], df.sparkSession.sparkContext.defaultParallelism)


def forest(
    df: DataFrame, y: str, columns: Sequence[str], mtry: int, trees: int = 500, depth: int = MAX_DEPTH, seed: int = 1
) -> forests.Forest:
    """Regression forest trying ``mtry`` columns at each split."""
    code, rows = _training(df, y, columns)
    return forests.grow(rows, code, forests.plan([(mtry, -1)], trees, 0, seed), depth)


@dataclass(frozen=True)
class Search:
    """Tried values of ``mtry``, their RMSE averaged over the folds, and the forest of the best on all rows."""

    mtry: list[int]
    rmse: list[float]
    best: forests.Forest


def forest_cv(
    df: DataFrame,
    y: str,
    columns: Sequence[str],
    mtry: Sequence[int] = range(1, 11),
    folds: int = 10,
    trees: int = 500,
    depth: int = MAX_DEPTH,
    seed: int = 1,
) -> Search:
    """Cross-validated choice of ``mtry`` by RMSE; the forests of all values and folds share their passes."""
    code, rows = _training(df, y, columns)
    models = [(m, fold) for m in mtry for fold in range(folds)]
    fits = forests.grow(rows, code, forests.plan(models, trees, folds, seed), depth)
    errors = fits.predict(rows).join(rows.select("id", "y"), "id").groupBy("model").agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("rmse"))
    found: dict[int, list[float]] = {}
    for r in sorted(errors.collect()):
        found.setdefault(models[r.model][0], []).append(r.rmse)
    tried = [m for m in mtry if m in found]
    rmse = [sum(found[m]) / len(found[m]) for m in tried]
    best = tried[rmse.index(min(rmse))]
    return Search(tried, rmse, forests.grow(rows, code, forests.plan([(best, -1)], trees, 0, seed), depth))


def cv_table(model: Search, spark: SparkSession) -> DataFrame:
    """RMSE of every tried ``mtry``."""
    return spark.createDataFrame(list(zip(model.mtry, model.rmse, strict=True)), "mtry int, rmse double")


def importance(model: forests.Forest, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importance rescaled so that the least useful column is 0 and the most useful 100."""
    values = model.importances()
    low, high = min(values), max(values)
    span = (high - low) or 1.0
    rows = [(c, (v - low) / span * 100) for c, v in zip(columns, values, strict=True)]
    table = spark.createDataFrame(rows, "variable string, overall double")
    words = [(f"_{word}$", f"_{text}") for word, text in INDICATOR_WORDS.items()]
    return table.withColumn("caption", replace_all("variable", [*words, *INDICATOR_PREFIXES]))


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardised columns; a constant column becomes 0. Moments come from one aggregate row."""
    moments = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    )
    names = [*[f"m_{c}" for c in columns], *[f"s_{c}" for c in columns]]
    scaled = {
        c: F.when(F.col(f"_m.s_{c}") == 0, F.when(F.col(c).isNotNull(), 0.0)).otherwise(
            (F.col(c) - F.col(f"_m.m_{c}")) / F.col(f"_m.s_{c}")
        )
        for c in columns
    }
    return df.withColumn("_m", moments.select(F.struct(*names)).scalar()).withColumns(scaled).drop("_m")


def kmeans(
    df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 2, max_iter: int = 20
) -> tuple[KMeansModel, DataFrame]:
    """Model and the rows with their ``cluster`` (1..k)."""
    rows = assembled(df, columns)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(rows)
    out = model.transform(rows).withColumn("cluster", F.col("prediction") + 1)
    return model, out.drop("features", "prediction")


def nearest_centre(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """1-based nearest of fixed centres by squared distance; the first wins a tie."""
    distances = [
        sum((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(columns, centre, strict=True))
        for centre in centres
    ]
    best = F.least(*distances)
    out = F
    for i, d in enumerate(distances, 1):
        out = out.when(d == best, i)
    return out.otherwise(None)


def silhouettes(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = 2) -> DataFrame:
    """Mean silhouette per k by Euclidean distance; fits and distances are shared by all k."""
    rows = stage(clusters.complete(df, columns))
    fits = clusters.lloyd(rows, columns, clusters.starting_centres(rows, columns, ks, seed))
    names = sorted(fits)
    if not names:
        return df.sparkSession.createDataFrame([], "k int, silhouette double")
    widths = clusters.silhouette(clusters.with_labels(rows, columns, [fits[k] for k in names]), len(names))
    return widths.select(F.element_at(F.array(*map(F.lit, names)), F.col("model")).alias("k"), "silhouette")


def total_sum_of_squares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Within-cluster sum of squares of a single cluster: (n-1) times the variances."""
    both = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(c).alias(c) for c in columns])
    return both.select(
        F.lit(1).alias("k"), ((F.col("n") - 1) * sum(F.col(c) for c in columns)).alias("within_ss")
    )


def elbow(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 16), seed: int = 2) -> DataFrame:
    """Within-cluster sum of squares for k = 1 and every k asked for; the fits share their passes."""
    rows = stage(clusters.complete(df, columns))
    fits = clusters.lloyd(rows, columns, clusters.starting_centres(rows, columns, ks, seed))
    table = [(k, float(fit.within.sum())) for k, fit in sorted(fits.items())]
    more = df.sparkSession.createDataFrame(table, "k int, within_ss double")
    return total_sum_of_squares(rows, columns).unionByName(more)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_profile(
    df: DataFrame, columns: Sequence[str], clusters: Sequence[int], percent: Sequence[str] = ()
) -> DataFrame:
    """Mean of every column per cluster, transposed: ``variable, 1..k``."""
    means = df.na.drop("any", subset=list(columns)).groupBy("cluster").agg(
        *[(F.avg(c) * (100 if c in percent else 1)).alias(c) for c in columns]
    )
    return transpose_summary(means, "cluster", clusters)


def distinctive(profile: DataFrame, cut: float = 0.5) -> DataFrame:
    """Variables whose mean exceeds ``cut`` in at least one cluster."""
    values = [F.col(f"`{c}`") for c in profile.columns if c != "variable"]
    return profile.filter(F.greatest(*values) > cut if len(values) > 1 else values[0] > cut)


def predict_with_truth(model: forests.Forest, df: DataFrame, columns: Sequence[str], y: str, key: str) -> DataFrame:
    """Prediction next to the actual outcome."""
    partitions = df.sparkSession.sparkContext.defaultParallelism
    rows = forests.packed_rows(_coded(df, columns, key=key, actual=y), model.code, ["key", "actual"], partitions)
    scored = rows.select("id", "key", "actual").join(model.predict(rows), "id")
    return scored.select(F.col("key").alias(key), F.col("prediction").alias("Predicted"), F.col("actual").alias("Actual"))
