"""Shared k-means passes and silhouettes against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levyscape.operators import clusters, learning

COLS = ["a", "b"]


def blobs(n=240, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    at = np.array([[0, 0], [9, 1], [4, 12], [-8, 7]])[np.arange(n) % 4]
    return at + rng.normal(size=(n, 2)) + shift


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "hh_id bigint, a double, b double")


def plain_lloyd(x, centres, passes, tol):
    for i in range(passes):
        gaps = ((x[:, None] - centres[None]) ** 2).sum(2)
        label = gaps.argmin(1)
        means = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
        if i == passes - 1 or np.sqrt(((means - centres) ** 2).sum(1)).max() <= tol:
            return centres, label, gaps.min(1)
        centres = means


def plain_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    width = []
    for i in range(len(x)):
        own = label == label[i]
        others = [d[i, label == c].mean() for c in set(label) - {label[i]}]
        if own.sum() == 1 or not others:
            width.append(0.0)
            continue
        near, other = d[i, own].sum() / (own.sum() - 1), min(others)
        width.append(0.0 if near == other else (other - near) / max(near, other))
    return float(np.mean(width))


def test_all_k_equal_plain_passes(spark):
    x = blobs()
    rows = clusters.complete(frame(spark, x), COLS).repartition(5)
    starts = clusters.starting_centres(rows, COLS, range(1, 8))
    again = clusters.starting_centres(rows.repartition(3), COLS, range(1, 8))
    assert all((starts[k] == again[k]).all() and (starts[k] == starts[7][:k]).all() for k in starts)
    fits = clusters.lloyd(rows, COLS, starts, passes=12)
    for k, fit in fits.items():
        centres, label, gap = plain_lloyd(x, starts[k], 12, 1e-4)
        assert fit.centres == pytest.approx(centres)
        assert fit.sizes.tolist() == np.bincount(label, minlength=k).tolist()
        assert fit.within.sum() == pytest.approx(gap.sum())
    assert fits[4].within.sum() < fits[3].within.sum() / 3


def test_one_pass_serves_all_k(spark, monkeypatch):
    """As many passes over the rows as the slowest k needs, whatever the number of ks."""
    passes, plain = [], clusters.summed_matrix
    monkeypatch.setattr(clusters, "summed_matrix", lambda *a: passes.append(1) or plain(*a))
    rows = clusters.complete(frame(spark, blobs()), COLS)
    clusters.lloyd(rows, COLS, clusters.starting_centres(rows, COLS, range(2, 9)), passes=6)
    assert len(passes) <= 6


def test_lost_cluster_keeps_its_centre(spark):
    rows = clusters.complete(frame(spark, np.array([[0.0, 0.0], [1.0, 0.0]])), COLS)
    fit = clusters.lloyd(rows, COLS, {2: np.array([[0.0, 0.0], [99.0, 99.0]])}, passes=5)[2]
    assert fit.sizes.tolist() == [2, 0] and fit.centres.tolist() == [[0.5, 0.0], [99.0, 99.0]]


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_silhouette_equals_all_pairs(spark, shift):
    """Several blocks, repeated points, a point alone; digits hold far from the origin."""
    x = np.vstack([blobs(150, shift=shift), np.repeat(blobs(4, 5, shift), 20, axis=0), [[50 + shift, 50]]])
    rng = np.random.default_rng(2)
    labels = np.column_stack([np.r_[np.arange(230) % 4 + 1, 5], rng.integers(1, 4, 231), np.ones(231, int)])
    rows = [(list(map(float, a)), list(map(int, b))) for a, b in zip(x, labels)]
    points = spark.createDataFrame(rows, "x array<double>, labels array<int>")
    for held in (8192, 20):
        got = {r.model: r.silhouette for r in clusters.silhouette(points, 3, held=held).collect()}
        for model in (1, 2, 3):
            assert got[model] == pytest.approx(plain_silhouette(x, labels[:, model - 1]), abs=1e-7)


def test_silhouettes_and_elbow_over_k(spark):
    x = blobs(80)
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None, 1.0)], "hh_id bigint, a double, b double"))
    got = {r.k: r.silhouette for r in learning.silhouettes(df, COLS, range(2, 6)).collect()}
    rows = clusters.complete(df, COLS)
    fits = clusters.lloyd(rows, COLS, clusters.starting_centres(rows, COLS, range(2, 6)))
    for k, fit in fits.items():
        assert got[k] == pytest.approx(plain_silhouette(x, clusters.nearest(x, fit.centres)[0]), abs=1e-7)
    assert max(got, key=got.get) == 4
    within = {r.k: r.within_ss for r in learning.elbow(df, COLS, range(2, 6)).collect()}
    assert sorted(within) == [1, 2, 3, 4, 5] and within[4] == pytest.approx(fits[4].within.sum())
    assert within[1] == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_few_distinct_rows_and_empty_table(spark):
    same = frame(spark, np.ones((6, 2)))
    assert {r.k: r.silhouette for r in learning.silhouettes(same, COLS, (2, 3)).collect()} == {2: 0.0, 3: 0.0}
    assert [r.within_ss for r in learning.elbow(same, COLS, (2,)).filter("k = 2").collect()] == [0.0]
    none = same.filter(F.lit(False))
    assert learning.silhouettes(none, COLS, (2, 3)).count() == 0
    assert [r.k for r in learning.elbow(none, COLS, (2, 3)).collect()] == [1]
    assert not math.isnan(got := clusters.distances(np.ones((2, 2)), np.ones((1, 2))).sum()) and got == 0


def test_tile_of_distances_far_from_the_origin():
    """Equal and very near points keep their digits in a tile."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(clusters.TILE, 40)) + 1e3, rng.normal(size=(clusters.SLICE, 40)) + 1e3
    b[:3] = a[:3]
    b[3] = a[4] + 1e-9
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert np.abs(clusters.distances(a, b) - exact).max() < 1e-9
    assert (np.diag(clusters.distances(a, b))[:3] == 0).all()


def test_nearest_centre_is_that_of_plain_differences():
    """Ties go to the first centre, also far from the origin, where products are rough."""
    rng = np.random.default_rng(5)
    for shift in (0.0, 1e6):
        x = rng.integers(0, 4, size=(3000, 6)) + shift
        centres = np.vstack([x[:7], x[3], x[:5] + 0.5])
        gaps = ((x[:, None] - centres[None]) ** 2).sum(2)
        label, gap = clusters.nearest(x, centres)
        assert (label == gaps.argmin(1)).all() and (gap == gaps.min(1)).all()


def test_blocks_get_tasks_of_their_own(spark):
    """Many blocks: no task holds more than a few of them."""
    rng = np.random.default_rng(6)
    x, labels = rng.normal(size=(640, 2)), rng.integers(1, 3, 640)
    points = spark.createDataFrame([(list(map(float, a)), [int(b)]) for a, b in zip(x, labels)], "x array<double>, labels array<int>")
    got = clusters.silhouette(points, 1, held=10)
    assert "rangepartitioning(block" in got._jdf.queryExecution().executedPlan().toString()
    assert got.first().silhouette == pytest.approx(plain_silhouette(x, labels), abs=1e-7)


def test_starting_rows_are_the_first_distinct_ones_by_hash(spark):
    """Also if most rows repeat; only rows that the sample can reach are made distinct."""
    x = np.round(np.random.default_rng(7).normal(size=(400, 2)), 1)
    rows = clusters.complete(frame(spark, np.repeat(x, 3, axis=0)), COLS)
    order = F.xxhash64(F.lit(2), *COLS)
    plain = rows.distinct().orderBy(order, *COLS).limit(50)
    got, want = (clusters.starting_centres(r, COLS, (6,), starts=50)[6] for r in (rows, plain))
    assert (got == want).all()


@pytest.mark.parametrize("real", [0, 1, 6])
def test_silhouette_of_whole_and_other_columns_in_blocks_of_many_packs(spark, monkeypatch, real):
    """Blocks of several packs: every distance is taken once, for both points; whole numbers by exact products."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(-3, 4, (260, 5)), rng.normal(size=(260, real)) + 1e3])
    labels = np.column_stack([rng.integers(1, 4, 260), np.r_[rng.integers(1, 3, 259), 3]])
    rows = [(list(map(float, a)), list(map(int, b))) for a, b in zip(x, labels)]
    points = spark.createDataFrame([*rows, *rows[:40]], "x array<double>, labels array<int>")
    x, labels = np.vstack([x, x[:40]]), np.vstack([labels, labels[:40]])
    for pack in (clusters.PACK, 7):
        monkeypatch.setattr(clusters, "PACK", pack)
        got = {r.model: r.silhouette for r in clusters.silhouette(points, 2).collect()}
        for model in (1, 2):
            assert got[model] == pytest.approx(plain_silhouette(x, labels[:, model - 1]), abs=1e-9)


def test_points_travel_once_per_block_as_bytes(spark):
    """Between the blocks packs of points are moved, not one row for each point and block."""
    points = spark.createDataFrame([([float(i), i / 7], [i % 3 + 1]) for i in range(3000)], "x array<double>, labels array<int>")
    plan = clusters.silhouette(points, 1)._jdf.queryExecution().executedPlan().toString()
    assert "whole#" in plan and "x#" not in plan
