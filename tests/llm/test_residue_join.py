import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levyscape.llm import residue_join
from levyscape.llm.residue_join import PRIMES, balanced, primes_for, residues, scores, whole_vectors, window_of

SCHEMA = "vec_id long, label int, embedding array<double>, v string, rank string, dim string, positives string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def plain(rows, every=5, positives=5, negatives=3):
    ok = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        if max(map(abs, w), default=0) > math.isqrt((2**63 - 1024) // max(1, len(w))):
            continue
        ok[i] = min(ok.get(i, (label, w)), (label, w))
    out = []
    for a, (label, v) in ok.items():
        if a % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w)), c, other) for c, (other, w) in ok.items() if c != a and len(w) == len(v))
        for p, who, _ in [x for x in near if x[2] == label][:positives]:
            fit = [(n, c) for n, c, other in near if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, who, r, c, -p, -n) for r, (n, c) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(df, every=5, **more):
    return sorted(tuple(r) for r in residue_join.hard_negatives(whole_vectors(df), F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("anchors,block,group,tile", [(8192, 4096, 64, 512), (16, 30, 2, 5)])
def test_against_brute_force(spark, monkeypatch, anchors, block, group, tile):
    for name, value in (("ANCHORS", anchors), ("BLOCK", block), ("GROUP", group), ("TILE", tile)):
        monkeypatch.setattr(residue_join, name, value)
    rng = random.Random(5)
    same = [rng.randint(-8, 8) / 16 for _ in range(6)]
    rows = [(i, rng.randint(0, 3), [rng.randint(-64, 64) / 64 + rng.random() / 999 for _ in range(6)]) for i in range(260)]
    rows += [(i, 1 + i % 2, same) for i in range(300, 360)] + [(i, i % 3, [0.0] * 6) for i in range(360, 366)]
    rows += [(400, 1, None), (405, None, same), (410, 2, [1.0, None] + [0.0] * 4), (415, 2, [math.nan] * 6), (420, 0, [math.inf] + same[1:]), (None, 1, same)]
    rows += [(425, 1, [1.0, 2.0]), (426, 1, [0.5, 2.0]), (427, 2, [0.4, 2.0]), (430, 1, []), (431, 1, []), (432, 2, []), (435, 9, [5.0])]
    rows += [(5, 1, same), (5, 1, same), (10, 0, [9.0] * 6), (440, 1, [1e30] * 6), (-5, 1, [-x for x in same]), (445, 1, [1e6, -1e6, 0.0, 0.0, 0.0, 0.5])]
    want = plain(rows)
    assert len(want) > 300 and mined(table(spark, rows)) == want
    assert mined(table(spark, rows), positives=2, negatives=7) == plain(rows, positives=2, negatives=7)


def test_no_anchors_no_negatives_no_rows(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, 0, [1.0]), (2, 0, [1.0])])) == []
    assert mined(table(spark, [(0, 0, [1.0]), (5, 0, [1.0])])) == []


@pytest.mark.parametrize("dim,largest", [(1, 2**31), (64, 300), (64, 2**28), (3000, 700), (1500, 2**20)])
def test_scores_are_exact(dim, largest):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-largest, largest, (7, dim), endpoint=True), rng.integers(-largest, largest, (9, dim), endpoint=True)
    a[0], b[0], b[1] = largest, largest, -largest
    primes = primes_for(largest, dim)
    want = [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
    assert scores(residues(a, primes), residues(b, primes), primes).tolist() == want
    assert set(balanced(np.arange(-600, 600), 251).astype(int).tolist()) == set(range(-125, 126))


def test_primes_cover_every_score_that_fits():
    assert math.prod(PRIMES) > 2**65 and all(all(p % q for q in range(2, p)) for p in PRIMES)
    assert len(primes_for(160, 64)) == 3


def test_windows_without_overflow():
    for p in (0, 1, 7, 99, 100, 101, 12345, 2**63 - 1):
        low, high = window_of(np.array([p]), 50, 95)
        assert (int(low[0]), int(high[0])) == (-(-50 * p // 100), 95 * p // 100)
