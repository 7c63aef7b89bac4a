import math
import random

import pytest
from pyspark.sql import functions as F

from levyscape.operators import describe
from levyscape.operators import weighted as w


def brute(rows, p):
    """Definition, spelled out: rows are (value, weight)."""
    rows = sorted((x, wt) for x, wt in rows if x is not None and wt is not None and wt > 0)
    n = sum(wt for _, wt in rows)
    h = 1 + (n - 1) * p
    low = max(math.floor(h), 1.0)
    high = min(low + 1, n)

    def at(rank):
        total = 0.0
        for i, (x, wt) in enumerate(rows):
            total += wt
            last_of_value = i + 1 == len(rows) or rows[i + 1][0] != x
            if last_of_value and total >= rank:
                return x
        return rows[-1][0]

    return at(low) + (h - math.floor(h)) * (at(high) - at(low))


PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]
NAMES = [f"p{i}" for i in range(len(PROBS))]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, w double")


def check(spark, rows, **kw):
    df = table(spark, rows)
    got = {r.g: [r[n] for n in NAMES] for r in w.weighted_stats(df, "x", "w", PROBS, NAMES, ["g"], **kw).collect()}
    for g in {r[0] for r in rows}:
        mine = [(x, wt) for h, x, wt in rows if h == g]
        usable = [1 for x, wt in mine if x is not None and wt]
        if not usable:
            assert g not in got
            continue
        assert got[g] == pytest.approx([brute(mine, p) for p in PROBS])


def test_edge_groups(spark):
    check(
        spark,
        [("one", 5.0, 3.0)]
        + [("ties", 2.0, 1.0)] * 4
        + [("light", float(i), 0.125) for i in range(4)]  # weights add up to less than 1
        + [("gaps", 1.0, None), ("gaps", 2.0, 0.0), ("gaps", None, 5.0), ("gaps", 7.0, 2.0)]
        + [("none", None, 1.0), ("none", 1.0, 0.0)]
        + [(None, 4.0, 2.0), (None, 8.0, 2.0)],
    )


@pytest.mark.parametrize("seed, rows_per_cell", [(1, 50_000), (2, 20), (3, 3)])
def test_matches_definition_with_a_hot_group_and_a_point_mass(spark, seed, rows_per_cell):
    rnd = random.Random(seed)
    rows = []
    for _ in range(1500):
        g = "hot" if rnd.random() < 0.4 else rnd.choice("abcdefg")
        x = 10.0 if rnd.random() < 0.33 else round(rnd.lognormvariate(2, 1), 2)
        rows.append((g, x if rnd.random() > 0.02 else None, rnd.randint(1, 40) * 0.25))
    check(spark, rows, rows_per_cell=rows_per_cell)


def test_does_not_depend_on_partitioning(spark):
    rnd = random.Random(4)
    df = table(spark, [("a", rnd.gauss(0, 9), rnd.randint(1, 9) * 0.5) for _ in range(400)])
    runs = [
        w.weighted_stats(d, "x", "w", PROBS, NAMES, (), rows_per_cell=10).collect()
        for d in (df.coalesce(1), df.repartition(7), df.repartitionByRange(5, "x"))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_monotone_and_inside_the_range(spark):
    rnd = random.Random(5)
    df = table(spark, [("a", rnd.gauss(0, 9), rnd.random()) for _ in range(300)])
    row = w.weighted_stats(df, "x", "w", PROBS, NAMES).first()
    values = [row[n] for n in NAMES]
    low, high = df.agg(F.min("x"), F.max("x")).first()
    assert values == sorted(values) and low <= values[0] and values[-1] <= high


def test_whole_weights_agree_with_the_builtin(spark):
    rnd = random.Random(6)
    df = table(spark, [("a", float(rnd.randint(0, 50)), float(rnd.randint(1, 6))) for _ in range(300)])
    row = w.weighted_stats(df, "x", "w", PROBS, NAMES).first()
    want = df.agg(F.expr(f"percentile(x, array({', '.join(map(str, PROBS))}), CAST(w AS BIGINT))").alias("v")).first().v
    assert [row[n] for n in NAMES] == pytest.approx(want)


def test_box_mean_and_plain_mean_agree(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.random(), rnd.choice([0.5, 2.0, None])) for _ in range(200)]
    df = table(spark, rows)
    box = {r.g: r["mean"] for r in w.weighted_box(df, "x", "w", ["g"]).collect()}
    mean = {r.g: r["mean"] for r in w.weighted_mean(df, "x", "w", ["g"]).collect()}
    assert box == pytest.approx(mean)


def test_bins_hold_equal_weight(spark):
    rnd = random.Random(8)
    df = table(spark, [("a", rnd.random(), rnd.randint(1, 4) * 0.5) for _ in range(2000)])
    out = w.weighted_bins(df, "x", "w", [2, 5, 10])
    for k in (2, 5, 10):
        sums = [r.s for r in out.groupBy(f"bin_{k}").agg(F.sum("w").alias("s")).orderBy(f"bin_{k}").collect()]
        assert len(sums) == k
        assert max(sums) - min(sums) < 8


def test_bins_of_a_constant_and_of_a_point_mass(spark):
    constant = table(spark, [("a", 3.0, 1.0)] * 20)
    assert {r.bin_5 for r in w.weighted_bins(constant, "x", "w", [5]).collect()} == {1}
    heavy = table(spark, [("a", 1.0, 1.0)] * 70 + [("a", float(i), 1.0) for i in range(2, 32)])
    codes = {r.x: r.bin_10 for r in w.weighted_bins(heavy, "x", "w", [10]).collect()}
    assert codes[1.0] == 1 and sorted(set(codes.values())) == list(range(1, len(set(codes.values())) + 1))


def test_missing_value_has_no_bin(spark):
    df = table(spark, [("a", None, 1.0), ("a", 1.0, 1.0), ("a", 2.0, 1.0)])
    assert {r.x: r.bin_2 for r in w.weighted_bins(df, "x", "w", [2]).collect()}[None] is None


def test_outliers_are_flagged_and_replaced_by_group(spark):
    rows = [(g, float(i), 1.0) for g in "ab" for i in range(1, 101)]
    df = table(spark, rows)
    flagged = w.flag_outliers(df, "x", "w", ["g"]).filter("flag_outlier_99 = 1")
    assert sorted((r.g, r.x) for r in flagged.collect()) == [("a", 100.0), ("b", 100.0)]
    out = w.replace_outliers(df, "x", "w", ["g"], out="y").filter("x <> y").collect()
    assert sorted((r.g, r.x, r.y) for r in out) == [("a", 100.0, 50.5), ("b", 100.0, 50.5)]


def test_descriptions(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    box = describe.box_stats(df, "x").first()
    assert (box.lowest, box.q1, box.median, box.q3, box.highest, box.n_outliers) == (1, 2, 3, 4, 100, 1)
    six = describe.summary6(df, "x").first()
    assert (six["mean"], six.n_missing) == (22.0, 1)
    bins = {r.bin: r.n for r in describe.histogram(df, "x", 3).collect()}
    assert bins == {0: 4, 2: 1}


def test_quantiles_do_not_depend_on_partitions_or_cells(spark):
    rows = spark.range(1000).select((F.col("id") * 1.5).alias("x"), F.lit(0.1).alias("w"), (F.col("id") % 3).alias("g"))
    seen = set()
    for parts in (1, 3, 7):
        for cell in (10, 200, 100_000):
            for by in ([], ["g"]):
                out = w.weighted_stats(rows.repartition(parts), "x", "w", [0.5, 0.9, 1 / 3], ["a", "b", "c"], by, rows_per_cell=cell)
                seen.add((len(by), tuple(sorted(tuple(r) for r in out.collect()))))
    assert len(seen) == 2


def test_nan_is_a_missing_value(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (float("nan"), 1.0), (None, 1.0)], "x double, w double")
    assert w.weighted_stats(df, "x", "w", [0.5], ["m"], mean="mean").first().asDict() == {"m": 1.5, "mean": 1.5}
    assert w.weighted_mean(df, "x", "w").first()[0] == 1.5


def test_weights_that_do_not_count_are_left_out_alike(spark):
    """One rule for quantiles, boxes and means: null, NaN, infinite, zero and negative weights."""
    rows = [(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (99.0, float("nan")), (98.0, -1.0), (97.0, 0.0), (96.0, None), (95.0, float("inf"))]
    df = spark.createDataFrame(rows, "x double, w double")
    want = spark.createDataFrame(rows[:3], "x double, w double")
    assert w.weighted_box(df, "x", "w").collect() == w.weighted_box(want, "x", "w").collect()
    assert w.weighted_mean(df, "x", "w").first()[0] == w.weighted_box(df, "x", "w").first()["mean"] == 2.25


@pytest.mark.parametrize("factor", [4e-10, 1e-30, 1.0, 1e9, 1e15])
def test_weights_of_any_magnitude(spark, factor):
    rows = [(g, float(i), (1 + i % 5) * factor) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    mean = {r.g: r["mean"] for r in w.weighted_box(df, "x", "w", ["g"]).collect()}
    plain = sum(x * v for g, x, v in rows if g == "a") / sum(v for g, _, v in rows if g == "a")
    assert mean == pytest.approx({"a": plain, "b": plain})
    got = w.weighted_stats(df, "x", "w", [0.5], ["m"], ["g"]).first().m
    if factor >= 1:  # the rank is the total weight's half
        total, run = sum(v for g, _, v in rows if g == "a"), 0
        at = next(x for g, x, v in rows if (run := run + v) >= 1 + (total - 1) * 0.5)
        assert got == pytest.approx(at, abs=1)
    else:  # less than one in all: no rank below the last is reached
        assert got == 199.0


def test_whole_totals_come_out_whole(spark):
    """Sums of tenths reach their whole number exactly, from either side of a unit."""
    for largest, step in ((0.7, 0.1), (700.0, 0.1), (0.3, 0.3), (2.5e7, 2.5e7)):
        limbs = w.Limbs(largest)
        rows = spark.range(1000).select(F.lit(step).alias("w"))
        high, low = limbs.split(F.col("w"))
        total = rows.select(high.alias("h"), low.alias("l")).agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
        assert total.select(limbs.number(F.col("h"), F.col("l"))).first()[0] == round(step * 1000)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_groups_streamed_by_range_give_the_same(spark, monkeypatch, batch):
    """A hot group over several ranges, point masses, null groups and many small ones; small Arrow batches."""
    rnd = random.Random(9)
    rows = []
    for i in range(3000):
        g = rnd.choice(["hot"] * 5 + [None, "", *[f"g{rnd.randint(0, 200)}" for _ in range(6)]])
        rows.append((g, rnd.choice([None, float("nan"), 4.0, 4.0, rnd.random() * 9]), rnd.choice([0.1, 0.25, 3.0, 0.0, -1.0, None]), i % 2))
    df = spark.createDataFrame(rows, "g string, x double, w double, k int").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for by in (["g"], ["k"], ["g", "k"]):
            runs = []
            for limit in (0, 10**9):
                monkeypatch.setattr(w, "GROUPS_PER_RANGE", limit)
                out = w.weighted_stats(df, "x", "w", PROBS, NAMES, by, mean="mean").collect()
                runs.append(sorted(([r[b] for b in by], [round(r[n], 9) for n in [*NAMES, "mean"]]) for r in out) if by == ["k"] else {tuple(r[b] for b in by): [round(r[n], 9) for n in [*NAMES, "mean"]] for r in out})
            assert runs[0] == runs[1] and len(runs[0]) > 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    monkeypatch.setattr(w, "GROUPS_PER_RANGE", 0)
    assert w.weighted_stats(df.limit(0), "x", "w", PROBS, NAMES, ["g"]).collect() == []


def test_many_groups_read_the_fact_once_for_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(w, "GROUPS_PER_RANGE", 0)
    df = spark.range(500).select((F.col("id") % 100).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    out = w.weighted_quantile(df, "x", "w", [0.5], ["g"])
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 100
