"""K-means for several numbers of clusters in shared passes, and silhouettes by distance.

A row with a null in any of the columns takes no part. Of equally near centres the first
wins; a cluster that loses all rows keeps its centre; with fewer distinct rows than
clusters there are as many clusters as distinct rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.operators.design import summed_matrix
from levyscape.sources.staging import stage

# Distinct rows that starting centres are drawn from; the passes themselves run over all rows.
STARTS = 4096
# Points of a block of the silhouette (about); a task takes the distances of two blocks.
HELD = 1 << 16
# Points of a tile, which stays in the cache (SLICE: the longer side of those that tests try).
SLICE, TILE = 512, 256
# Points that travel together.
PACK = 1024
# Columns of whole numbers may have squares up to this sum: products of such rows are exact in single precision.
WHOLE = 1 << 21


@dataclass(frozen=True)
class Clusters:
    """Centres of one k with the rows nearest to each and their squared distances to it."""

    centres: np.ndarray
    sizes: np.ndarray
    within: np.ndarray


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any")


def starting_centres(rows: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 2, starts: int = STARTS) -> dict[int, np.ndarray]:
    """First centres of each k: distance-weighted draws from the `starts` distinct rows with the smallest hash.

    One sequence of draws serves every k, which takes its beginning.
    """
    order = F.xxhash64(F.lit(seed), *columns)
    # the hashes tell how far the sample reaches: only its rows are made distinct
    last = rows.select(order.alias("h")).distinct().orderBy("h").limit(starts).agg(F.max("h")).first()[0]
    reached = rows.select(*columns).filter(order <= F.lit(last))
    sample = reached.distinct().orderBy(order, *columns).limit(starts).collect()
    x = np.array([list(r) for r in sample], dtype=float).reshape(-1, len(columns))
    if not len(x):
        return {}
    rng = np.random.default_rng(seed)
    drawn = [int(rng.integers(len(x)))]
    gap = ((x - x[drawn[0]]) ** 2).sum(axis=1)
    while len(drawn) < max(ks) and gap.sum() > 0:
        drawn.append(int(rng.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, ((x - x[drawn[-1]]) ** 2).sum(axis=1))
    return {int(k): x[drawn[:k]] for k in ks}


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0-based nearest centre of each row and the squared distance to it.

    Inner products settle the rows with one centre clearly nearest, differences all others.
    """
    long_x, long_c = (x * x).sum(axis=1), (centres * centres).sum(axis=1)
    rough = long_c - 2 * (x @ centres.T)
    label = rough.argmin(axis=1)
    limit = rough[np.arange(len(x)), label] + 1e-10 * (long_x + long_c.max())
    clear = (rough <= limit[:, None]).sum(axis=1) == 1
    unclear = np.flatnonzero(~clear)
    if len(unclear):
        gaps = np.stack([((x[unclear] - c) ** 2).sum(axis=1) for c in centres], axis=1)
        label[unclear] = gaps.argmin(axis=1)
    return label, ((x - centres[label]) ** 2).sum(axis=1)


def lloyd(rows: DataFrame, columns: Sequence[str], starts: dict[int, np.ndarray], passes: int = 20, tol: float = 1e-4) -> dict[int, Clusters]:
    """Lloyd steps for every k at once: one pass over the rows serves all that still move.

    A task folds its rows into sums, counts and squared distances per (k, centre). A k is
    done once no centre moves by more than `tol`, or after `passes`. What is returned are
    the centres of its last pass, and sizes and squared distances measured from them.
    """
    p, moving, done = len(columns), dict(starts), {}
    for left in range(passes - 1, -1, -1):
        if not moving:
            break
        tables = list(moving.values())

        def partial(x, tables=tables):
            parts = []
            for centres in tables:
                label, gap = nearest(x, centres)
                member = (label == np.arange(len(centres))[:, None]).astype(float)
                parts.append(np.column_stack([member @ x, member.sum(axis=1), member @ gap]))
            return np.vstack(parts)

        sums = summed_matrix(rows, [F.col(c) for c in columns], partial, (sum(map(len, tables)), p + 2))
        at, after = 0, {}
        for k, centres in moving.items():
            part = sums[at : at + len(centres)]
            at += len(centres)
            n = part[:, p]
            means = np.where(n[:, None] > 0, part[:, :p] / np.maximum(n, 1)[:, None], centres)
            if left == 0 or np.sqrt(((means - centres) ** 2).sum(axis=1)).max() <= tol:
                done[k] = Clusters(centres, n.astype(int), part[:, p + 1])
            else:
                after[k] = means
        moving = after
    return done


def cluster_table(spark, fits: dict[int, Clusters], columns: Sequence[str]) -> DataFrame:
    """``k, cluster, n, within_ss`` and the centre, one row per cluster of every k."""
    rows = [
        (k, i, int(n), float(w), *map(float, c))
        for k, fit in sorted(fits.items())
        for i, (n, w, c) in enumerate(zip(fit.sizes, fit.within, fit.centres, strict=True), 1)
    ]
    centres = "".join(f", `{c}` double" for c in columns)
    return spark.createDataFrame(rows, f"k int, cluster int, n long, within_ss double{centres}")


def with_labels(rows: DataFrame, columns: Sequence[str], fits: Sequence[Clusters]) -> DataFrame:
    """``x, labels``: each row's values and its 1-based cluster in every fit."""
    tables, p = [f.centres for f in fits], len(columns)

    def label(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            labels = np.stack([nearest(x, c)[0] + 1 for c in tables], axis=1).astype(np.int32)
            ends = pa.array(np.arange(len(x) + 1) * len(tables), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(labels.ravel()))], names=["x", "labels"])

    return rows.select(F.array(*columns).alias("x")).mapInArrow(label, "x array<double>, labels array<int>")


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a from all of b.

    By inner products, but pairs so near that these would lose digits by differences.
    """
    long_a, long_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    wide_a = np.column_stack([-2 * a, long_a, np.ones(len(a))])
    wide_b = np.column_stack([b, np.ones(len(b)), long_b])
    out = wide_a @ wide_b.T
    if out.min() <= 1e-4 * (long_a.max() + long_b.max()):
        i, j = np.nonzero(out <= 1e-4 * (long_a[:, None] + long_b))
        out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a from all of b."""
    out = squares(a, b)
    return np.sqrt(out, out=out)


def _packed(whole: list[int], rest: list[int], small: bool, pack: int):
    """Points of a partition as a few rows of bytes each; the partition is their block."""

    def run(batches):
        kind, at = np.int8 if small else np.float32, 0
        for batch in batches:
            for low in range(0, batch.num_rows, pack):
                some = batch.slice(low, pack)
                n = some.num_rows
                x, labels = (some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("x", "labels"))
                parts = x[:, whole].astype(kind), x[:, rest], labels.astype(np.int32), some.column("weight").to_numpy().astype(float)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "at": pa.array([at], pa.int32()), "n": pa.array([n], pa.int32()),
                    **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("whole", "rest", "labels", "weight"), parts, strict=True)},
                })
                at += 1

    return run


class _Points:
    """Points of a pack: their wide rows for products, values, labels and weights, and sums by cluster."""

    def __init__(self, row: dict, kind, offsets: np.ndarray):
        self.row, n = row, row["n"]
        whole = np.frombuffer(row["whole"], kind).reshape(n, -1).astype(np.float32)
        long = (whole * whole).sum(axis=1)
        self.left = np.column_stack([-2 * whole, long, np.ones(n, np.float32)])
        self.right = np.column_stack([whole, np.ones(n, np.float32), long])
        self.rest = np.frombuffer(row["rest"], np.float64).reshape(n, -1)
        labels = np.frombuffer(row["labels"], np.int32).reshape(n, -1)
        weight = np.frombuffer(row["weight"], np.float64)
        self.sums = np.zeros((n, offsets[-1]))
        # per tile: its rows, their weights by combination of labels, and the clusters of each combination
        self.tiles = []
        for low in range(0, n, TILE):
            part = slice(low, min(low + TILE, n))
            kinds, of = np.unique(labels[part], axis=0, return_inverse=True)
            member = np.zeros((len(of), len(kinds)))
            member[np.arange(len(of)), of.ravel()] = weight[part]
            clusters = np.zeros((len(kinds), offsets[-1]))
            clusters[np.arange(len(kinds))[:, None], offsets[:-1] + kinds - 1] = 1
            self.tiles.append((part, member, clusters))


def _tile(a: _Points, i: slice, b: _Points, j: slice) -> np.ndarray:
    """Distances of two tiles: whole numbers by products, which are exact, a few other columns by differences."""
    out = (a.left[i] @ b.right[j].T).astype(np.float64)
    columns = a.rest.shape[1]
    if columns > 4:
        centre = a.rest[i].mean(axis=0)  # near the origin products keep more digits
        out += squares(a.rest[i] - centre, b.rest[j] - centre)
    else:
        for c in range(columns):
            gap = np.subtract.outer(a.rest[i, c], b.rest[j, c])
            gap *= gap
            out += gap
    return np.sqrt(out, out=out)


def _meet(a: _Points, b: _Points) -> None:
    """Adds to the sums of both what the distances between them give; a pack that meets itself has each once."""
    for i, (rows, member, clusters) in enumerate(a.tiles):
        for j, (others, their_member, their_clusters) in enumerate(b.tiles):
            if a is b and j < i:
                continue
            gaps = _tile(a, rows, b, others)
            a.sums[rows] += gaps @ their_member @ their_clusters
            if a is not b or j > i:
                b.sums[others] += (member.T @ gaps).T @ clusters


def _pairs(most: Sequence[int], small: bool):
    """Task of the silhouette: per pair of blocks the packs of one (side 0), then those of the other (side 1)."""
    offsets, kind = np.concatenate(([0], np.cumsum(most))), np.int8 if small else np.float32

    def told(points):
        some = [p.row | {"sums": p.sums.tobytes()} for p in points]
        return pa.RecordBatch.from_pydict({
            **{c: pa.array([r[c] for r in some], pa.int32()) for c in ("part", "at", "n")},
            **{c: pa.array([r[c] for r in some], pa.binary()) for c in ("labels", "weight", "sums")},
        })

    def run(batches):
        block, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    for p in held:
                        yield told([p])
                    block, held = row["block"], []
                new = _Points(row, kind, offsets)
                # packs of one block meet each other only where the pair is the block with itself
                if row["side"] or row["alone"]:
                    for p in held:
                        _meet(p, new)
                if row["side"]:
                    yield told([new])
                    continue
                if row["alone"]:
                    _meet(new, new)
                held.append(new)
        for p in held:
            yield told([p])

    return run


def _finished(most: Sequence[int], sizes: np.ndarray):
    """Widths of the points of a pack from their sums by cluster."""
    offsets = np.concatenate(([0], np.cumsum(most)))

    def run(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        labels = np.frombuffer(t["labels"][0].as_py(), np.int32).reshape(n, -1)
        weight = np.frombuffer(t["weight"][0].as_py(), np.float64)
        whole = sum(np.frombuffer(b.as_py(), np.float64) for b in t["sums"]).reshape(n, -1)
        rows, out = np.arange(n), []
        for model, k in enumerate(most):
            part = slice(offsets[model], offsets[model] + k)
            sums, of, own = whole[:, part], sizes[part], labels[:, model] - 1
            within = sums[rows, own] / np.maximum(of[own] - 1, 1)
            means = np.where(of > 0, sums / np.maximum(of, 1), np.inf)
            means[rows, own] = np.inf
            other = means.min(axis=1)
            plain = (of[own] > 1) & np.isfinite(other) & (within != other)
            width = np.zeros(n)
            width[plain] = (other - within)[plain] / np.maximum(other, within)[plain]
            out.append((model + 1, float(width @ weight), float(weight.sum())))
        model, width, n = zip(*out, strict=True)
        return pa.table({"model": pa.array(model, pa.int32()), "width": pa.array(width, pa.float64()), "n": pa.array(n, pa.float64())})

    return run


def silhouette(points: DataFrame, models: int, held: int = HELD) -> DataFrame:
    """``model, silhouette``: mean silhouette width of each labelling by Euclidean distance.

    points: ``x`` (values) and ``labels`` (a 1-based cluster for each of the `models`
    labellings). Equal points with equal labels collapse to one with a weight. Points are dealt
    to blocks of about `held` at most, near labels together; a task takes each distance between
    two blocks once, for all labellings and for both points, and passes on sums per cluster;
    points travel once per block. A point alone in its cluster counts 0, and so do all if there
    is one cluster only.
    """
    spark = points.sparkSession
    counted = stage(points.groupBy("x", "labels").agg(F.count(F.lit(1)).alias("weight")))
    row = counted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"), *[F.max(F.col("labels")[j]).alias(f"m{j}") for j in range(models)]).first()
    if not row["n"]:
        return spark.createDataFrame([], "model int, silhouette double")
    most = [row[f"m{j}"] for j in range(models)]
    offsets = np.concatenate(([0], np.cumsum(most)))
    sizes = np.zeros(offsets[-1])
    for r in counted.select(F.posexplode("labels").alias("j", "label"), "weight").groupBy("j", "label").agg(F.sum("weight").alias("n")).collect():
        sizes[offsets[r.j] + r.label - 1] = r.n
    xs = [F.col("x")[i] for i in range(row["p"])]
    seen = counted.agg(F.array(*[F.max(F.abs(x)) for x in xs]).alias("high"), F.array(*[F.max(x != F.floor(x)) for x in xs]).alias("broken")).first()
    whole, left = [], WHOLE
    for i, (high, broken) in enumerate(zip(seen.high, seen.broken, strict=True)):
        if not broken and high**2 <= left:
            whole.append(i)
            left -= high**2
    rest = [i for i in range(row["p"]) if i not in whole]
    small = all(seen.high[i] < 128 for i in whole)

    # as many blocks as give every core a few pairs, if that leaves them large enough
    blocks = max(-(-row["n"] // held), min(-(-row["n"] // PACK), math.isqrt(6 * spark.sparkContext.defaultParallelism)))
    by_label = counted.repartitionByRange(blocks, "labels", "x").sortWithinPartitions("labels", "x")
    packs = stage(by_label.mapInArrow(_packed(whole, rest, small, PACK), "part int, at int, n int, whole binary, rest binary, labels binary, weight binary"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    low, high = F.least("part", "other").cast("long"), F.greatest("part", "other").cast("long")
    pair = F.floor(high * (high + 1) / 2) + low
    dealt = packs.select("*", other).withColumns({"block": pair, "side": (F.col("part") > F.col("other")).cast("int"), "alone": F.col("part") == F.col("other")})
    # ranges, as a hash of so few numbers puts several pairs into one task
    tasks = min(blocks * (blocks + 1) // 2, 1024)
    spread = dealt.drop("other").repartitionByRange(tasks, "block").sortWithinPartitions("block", "side", "at")
    sums = spread.mapInArrow(_pairs(most, small), "part int, at int, n int, labels binary, weight binary, sums binary")
    widths = sums.groupBy("part", "at").applyInArrow(_finished(most, sizes), "model int, width double, n double")
    return widths.groupBy("model").agg((F.sum("width") / F.sum("n")).alias("silhouette"))
