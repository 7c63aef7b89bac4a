import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levyscape.llm import minhash
from levyscape.llm.common import in_sieve, mix, sieve
from tests.llm.helpers import docs, lower, prose, rows, words


def sets(texts):
    out = []
    for text in texts:
        w = words(lower(text))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain(table):
    s = sets([r[1] for r in table])
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(s):
        for j in range(i):
            if a and 100 * len(a & s[j]) >= 85 * len(a | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(table):
        c = least.get(find(i)) if s[i] else r[0]
        out.append((r[0], len(s[i]), c, r[0] == c))
    return sorted(out, key=repr)


def edited(text, changes, rng):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


def test_awkward_rows(spark):
    a = prose(1, 60)
    table = [(5, a), (3, a.upper()), (3, a + " more"), (7, None), (8, ""), (9, " \t\n"), (10, "one two"), (11, "ONE  two"), (12, "one two three")]
    table += [(None, a), (None, None), (None, "solo of null id here now"), (20, "a b c d e"), (21, "a b c d e a b c d e"), (22, " ".join(["z"] * 40)), (23, "z z z z z"), (24, "é É ß w x"), (25, "é é ß w x")]
    table += [(5, a)] * 3 + [(-4, prose(2, 30))]
    assert rows(minhash.near_duplicates(docs(spark, table, ["n", "h1", "key", "node", "component_id"]))) == plain(table)


def test_empty_table(spark):
    assert rows(minhash.near_duplicates(docs(spark, []))) == []


@pytest.mark.parametrize("size,changes", [(250, 3), (40, 1), (12, 1)])
def test_chains_and_families_against_brute_force(spark, size, changes):
    """Copies of copies: many links, many pairs near the limit, buckets that a star alone would not finish."""
    rng = random.Random(size)
    table = []
    for family in range(6):
        base = prose(family, size)
        texts = [base]
        for _ in range(25):
            texts.append(edited(rng.choice(texts), rng.randint(0, changes), rng))
        texts += [edited(base, changes * 3, rng) for _ in range(10)]
        rng.shuffle(texts)
        table += [(len(table) + i, t) for i, t in enumerate(texts)]
    assert rows(minhash.near_duplicates(docs(spark, table))) == plain(table)


def test_slices_finish_what_stars_leave(spark):
    """All texts in one bucket: whatever its star misses is found by the slices."""
    rng = random.Random(4)
    base = prose(9, 120)
    texts = [edited(base, 6, rng) for _ in range(40)]
    texts += [edited(t, 1, rng) for t in texts[:15]] + [edited(texts[3], 2, rng)]
    table = list(enumerate(texts))
    names = []
    for i, t in table:
        data = np.frombuffer(t.encode(), np.uint8)
        h, at = minhash.shingle_sets(data, np.array([0, len(data)]))
        names.append((i, bytearray(h.tobytes()), len(h), minhash.odd_sketches(h, at)[0].tolist()))
    full = spark.createDataFrame([r[:2] for r in names], "node long, set binary")
    members = spark.createDataFrame([(1, i, n, odd, len(names), 0) for i, _, n, odd in names], "key long, node long, n long, odd array<long>, size long, centre long")
    roots = {r["a"]: r["root"] for r in minhash.linked(members, full).collect()}
    want = {r[0]: r[2] for r in plain(table)}
    assert {i: roots.get(i, i) for i in want} == want and len(set(want.values())) > 5


def test_odd_sketches_never_part_a_link(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in (3, 30, 300, 3000):
        for _ in range(40):
            pool = np.unique(rng.integers(0, 2**63, n + n // 5 + 1, dtype=np.uint64))
            cut = rng.integers(0, n // 5 + 1)
            x, y = pool[: len(pool) - cut], pool[cut:]
            (u, v) = (minhash.odd_sketches(z, np.array([0, len(z)]))[0].tolist() for z in (x, y))
            both = len(np.intersect1d(x, y))
            rows.append((len(x), len(y), u, v, 100 * both >= 85 * (len(x) + len(y) - both)))
    df = spark.createDataFrame(rows, "n long, m long, odd array<long>, its_odd array<long>, link boolean")
    got = df.groupBy("link").agg(F.count_if(minhash.may_link(85, 100)).alias("kept"), F.count("*").alias("n")).collect()
    got = {r["link"]: (r["kept"], r["n"]) for r in got}
    assert got[True][0] == got[True][1] and got[False][0] < got[False][1] / 2


def test_densified_bins_agree_like_the_sets():
    """Share of equal bins estimates the similarity, also where most bins are empty."""
    rng = np.random.default_rng(1)
    for size in (6, 40, 400):
        agree = []
        for _ in range(200):
            pool = np.unique(rng.integers(0, 2**63, size + size // 2, dtype=np.uint64) * np.uint64(2))
            x, y = np.sort(pool[:size]), np.sort(pool[len(pool) - size :])
            v = minhash.signatures(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
            assert (v != 0).all()
            agree.append((v[0] == v[1]).mean())
        alike = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(np.mean(agree) - alike) < 0.05
    alone = minhash.signatures(np.array([5], np.uint64), np.array([0, 1, 1]))
    assert (alone[0] == 5).all() and (alone[1] == 0).all()


def test_very_long_text(spark):
    long = prose(5, 90_000)
    table = [(1, long), (2, long + " end"), (3, "the " * 300_000)]
    got = rows(minhash.near_duplicates(docs(spark, table)))
    assert [r[2:] for r in got] == [(1, True), (1, False), (3, True)] and got[2][1] == 1 and got[1][1] - got[0][1] == 1


def test_sieve_holds_every_name(spark):
    names = mix(np.arange(5000, dtype=np.uint64), np.uint64(3))
    df = spark.createDataFrame([(int(x),) for x in names[:3000].view(np.int64)], "x long")
    bitmap = sieve(df, df["x"])
    assert in_sieve(bitmap, names[:3000]).all() and in_sieve(bitmap, names[3000:]).sum() < 5
    assert not sieve(df.limit(0), df["x"]).any()
