import math
import random
import struct

import pytest

from levyscape.llm import block_join

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def plain(rows, k=20):
    ok = {}
    for i, v in rows:
        v = v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q, v in ok.items():
        if q % 20:
            continue
        scored = []
        for c, w in ok.items():
            if c != q and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                scored.append((-s, c))
        out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def near(df, k=20):
    return sorted(tuple(r) for r in block_join.nearest(df.filter("vec_id % 20 = 0"), df, k=k).collect())


@pytest.mark.parametrize("block,query_block", [(8192, 1024), (30, 3)])
def test_against_brute_force(spark, monkeypatch, block, query_block):
    monkeypatch.setattr(block_join, "BLOCK", block)
    monkeypatch.setattr(block_join, "QUERY_BLOCK", query_block)
    rng = random.Random(3)
    same = [float(rng.randint(-8, 8)) for _ in range(7)]
    rows = [(i, [rng.randint(-64, 64) / 8 for _ in range(7)]) for i in range(300)]
    rows += [(i, same) for i in range(300, 380)] + [(i, [1e-3 * x for x in same]) for i in range(380, 390)]
    rows += [(400, None), (401, []), (402, [0.0] * 7), (403, [1.0, None] + [0.0] * 5), (404, [float("nan")] * 7), (405, [float("inf")] + [1.0] * 6)]
    rows += [(420, [1.0, 2.0]), (421, [3.0, 1.0]), (440, [1.0, 2.0, 3.0]), (None, same), (460, [1e30] + [0.0] * 6), (461, [-1e30, 1e-30] + [0.0] * 5)]
    rows += [(320, same), (321, [9.0] * 7)]
    assert near(table(spark, rows)) == plain(rows)
    assert near(table(spark, rows), 3) == plain(rows, 3)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert near(table(spark, rows)) == plain(rows) and len(plain(rows)) == 4
    assert near(table(spark, rows[:1])) == [] and near(table(spark, [])) == []
