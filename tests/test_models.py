import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levyscape.operators import learning, regression
from levyscape.operators.design import Factor, ModelSpec, usable_terms


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(600):
        x, g, h = float(rnd.normal()), rnd.choice(["a", "b", "c"]), rnd.choice(["u", "v"])
        y = 1 + 2 * x + {"a": 0.0, "b": 0.5, "c": -1.0}[g] + float(rnd.normal())
        hit = float(rnd.random() < 1 / (1 + math.exp(-(-0.5 + x + {"a": 0, "b": 0.7, "c": -0.4}[g]))))
        rows.append((i, x, 2 * x, str(g), str(h), y, hit))
    return spark.createDataFrame(rows, "hh_id bigint, x double, x2 double, g string, h string, y double, hit double").cache()


SPEC = ModelSpec(("x",), (Factor("g", ("a", "b", "c")), Factor("h", ("u", "v"))))


def matrix(df, terms):
    rows = df.select(F.lit(1.0), *[t.expr() for t in terms]).collect()
    return np.array([list(r) for r in rows])


def test_ols_residuals_are_orthogonal_and_errors_match(data):
    m = regression.ols(data, "y", SPEC)
    x = matrix(data, m.terms)
    y = np.array([r.y for r in data.select("y").collect()])
    beta = np.array(m.coefficients)
    assert np.abs(x.T @ (y - x @ beta)).max() < 1e-6
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    assert np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x))) == pytest.approx(m.errors)
    table = m.table(data.sparkSession).collect()
    assert table[0].term == "(Intercept)" and [t.term for t in table] == ["(Intercept)", "x", "gb", "gc", "hv"]


def test_unused_levels_and_aliased_columns(data):
    spec = ModelSpec(("x", "x2"), (Factor("g", ("zero", "a", "b", "c", "never")),))
    kept, aliased = usable_terms(data, spec)
    assert [t.name for t in kept] == ["x", "gb", "gc"] and [t.name for t in aliased] == ["x2"]
    m = regression.ols(data, "y", spec)
    assert all(e is not None for e in m.errors)
    assert [r.term for r in m.table(data.sparkSession).filter("estimate IS NULL").collect()] == ["x2"]


def test_incomplete_rows_are_left_out_and_score_null(data):
    holes = data.withColumn("g", F.when(F.col("hh_id") % 10 > 0, F.col("g")))
    m = regression.ols(holes, "y", SPEC)
    assert m.fit["n"] == 540
    scored = m.predict(holes)
    assert scored.filter("prediction IS NULL").count() == 60
    assert regression.prediction_errors(scored, "y", "prediction").first().mse is None


def test_logit_score_equations_and_errors(data):
    m = regression.logit(data, "hit", SPEC)
    x = matrix(data, m.terms)
    y = np.array([r.hit for r in data.select("hit").collect()])
    p = 1 / (1 + np.exp(-(x @ np.array(m.coefficients))))
    assert np.abs(x.T @ (y - p)).max() < 1e-5
    assert np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x))) == pytest.approx(m.errors, rel=1e-5)
    null = y.mean()
    dev = -2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    dev0 = -2 * len(y) * (null * math.log(null) + (1 - null) * math.log(1 - null))
    assert m.fit["pseudo_r2"] == pytest.approx(1 - dev / dev0) and m.fit["converged"]
    scored = np.array([r.prediction for r in m.predict(data).select("prediction").collect()])
    assert scored == pytest.approx(p)


@pytest.mark.parametrize("contrast", ["observed", "clean"])
def test_marginal_effects_by_finite_differences(data, contrast):
    m = regression.logit(data, "hit", SPEC)
    x, beta = matrix(data, m.terms), np.array(m.coefficients)
    names = [t.name for t in m.terms]

    def effects(b):
        out = []
        for j, name in enumerate(names, 1):
            if name == "x":
                p = 1 / (1 + np.exp(-(x @ b)))
                out.append((p * (1 - p)).mean() * b[j])
                continue
            one, zero = x.copy(), x.copy()
            same = [k for k, other in enumerate(names, 1) if other[0] == name[0]] if contrast == "clean" else [j]
            one[:, same] = 0
            zero[:, same] = 0
            one[:, j] = 1
            out.append((1 / (1 + np.exp(-(one @ b))) - 1 / (1 + np.exp(-(zero @ b)))).mean())
        return np.array(out)

    got = regression.average_marginal_effects(m, data, contrast).collect()
    assert [r.factor for r in got] == names
    assert [r.AME for r in got] == pytest.approx(effects(beta))
    p = 1 / (1 + np.exp(-(x @ beta)))
    cov = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    step = 1e-6
    grad = np.array([(effects(beta + step * e) - effects(beta - step * e)) / (2 * step) for e in np.eye(len(beta))]).T
    assert [r.std_error for r in got] == pytest.approx(np.sqrt(np.diag(grad @ cov @ grad.T)), rel=1e-5)


def test_captions_order_and_exclusion(data):
    spec = ModelSpec(("log_expenditures_hh",), (Factor("province", ("a", "b", "c")),))
    named = data.withColumnsRenamed({"x": "log_expenditures_hh", "g": "province"})
    m = regression.logit(named, "hit", spec)
    out = regression.caption_terms(regression.average_marginal_effects(m, named), exclude=["provincec"]).collect()
    assert [r.caption for r in out] == ["Expenditures (log)", "Province: b"]


def test_top_decile_and_side_by_side(data):
    flagged = regression.top_decile_flag(data, "y", by=["h"])
    for r in flagged.groupBy("h").agg(F.count_if("burden_decile").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == r.n // 10
    spark = data.sparkSession
    models = {"one": regression.ols(data, "y", SPEC), "two": regression.ols(data, "y", SPEC.without("h"))}
    out = {r.term: (r.one, r.two) for r in regression.compare_models(models, spark).collect()}
    assert out["hv"][0] is not None and out["hv"][1] is None
    stats = regression.fit_table(models, spark)
    assert stats.filter("model = 'one' AND statistic = 'r2'").count() == 1


def test_transfer_reports_both_fits(data):
    m = regression.ols(data.filter("hh_id < 300"), "y", SPEC)
    r = regression.transfer_quality(m, data.filter("hh_id >= 300")).first()
    assert r.r2_predictive <= r.r2_refit + 1e-12 and r.r2_predictive > 0.5


def test_zscore_kmeans_and_profile(spark):
    rows = [(i, float(i % 2) * 10 + (i % 5) * 0.1, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "hh_id bigint, v double, flat double")
    z = learning.zscore(df, ["v", "flat"])
    stats = z.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.max("flat").alias("f")).first()
    assert (stats.m, stats.s, stats.f) == pytest.approx((0, 1, 0), abs=1e-9)
    _, labelled = learning.kmeans(df, ["v"], 2)
    sizes = sorted(r.n for r in learning.cluster_sizes(labelled).collect())
    assert sizes == [30, 30]
    profile = learning.cluster_profile(labelled, ["v"], [1, 2])
    values = sorted([profile.first()["1"], profile.first()["2"]])
    assert values[0] < 1 and values[1] > 10
    assert learning.distinctive(profile, 100.0).count() == 0
    within = {r.k: r.within_ss for r in learning.elbow(df, ["v"], range(2, 4)).collect()}
    assert within[1] == pytest.approx(59 * df.agg(F.var_samp("v")).first()[0]) and within[2] < within[1] / 50
    sil = {r.k: r.silhouette for r in learning.silhouettes(df, ["v"], range(2, 4)).collect()}
    assert sil[2] > 0.9


def test_forest_learns_and_ranks_columns(data):
    rows = data.withColumn("noise", F.rand(3))
    model = learning.forest(rows, "y", ["x", "noise"], mtry=1, trees=20, depth=6)
    table = {r.variable: r.overall for r in learning.importance(model, ["x", "noise"], data.sparkSession).collect()}
    assert table == {"x": 100.0, "noise": 0.0}
    scored = learning.predict_with_truth(model, rows, ["x", "noise"], "y", "hh_id")
    assert regression.prediction_errors(scored, "Actual", "Predicted").first().rmse < 2.0
    cv = learning.forest_cv(rows, "y", ["x", "noise"], mtry=(1, 2), folds=2, trees=5, depth=4)
    assert {r.mtry for r in learning.cv_table(cv, data.sparkSession).collect()} == {1, 2}


def test_least_squares_on_badly_conditioned_columns(spark):
    """Powers of a year: condition number beyond 1e9, where cross products keep no digit."""
    rows = [(i, 1900.0 + i % 120, float((i * 7919) % 101) / 100) for i in range(2000)]
    rows = [(i, t, t * t, 3 + 2 * (t - 1960) / 60 - ((t - 1960) / 60) ** 2 + e) for i, t, e in rows]
    df = spark.createDataFrame(rows, "hh_id bigint, t double, t2 double, y double").repartition(5)
    x = np.array([[1.0, r[1], r[2]] for r in rows])
    assert np.linalg.cond(x) > 1e9
    m = regression.ols(df, "y", ModelSpec(("t", "t2")))
    # the same line in centred powers, which are well conditioned
    u = (x[:, 1] - 1960) / 60
    z, y = np.column_stack([np.ones(len(u)), u, u * u]), np.array([r[3] for r in rows])
    a, b, c = np.linalg.solve(z.T @ z, z.T @ y)
    q = 1960 / 60
    assert m.coefficients == pytest.approx([a - b * q + c * q * q, (b - 2 * c * q) / 60, c / 3600], rel=1e-6)
    s2 = ((y - z @ [a, b, c]) ** 2).sum() / (len(y) - 3)
    assert m.errors[2] == pytest.approx(math.sqrt(s2 * np.linalg.inv(z.T @ z)[2, 2]) / 3600, rel=1e-6)


def test_student_tail():
    """Closed forms for 1, 2 and 4 degrees of freedom, and the normal limit."""
    for t in (0.01, 0.5, 1.0, 3.0, 40.0):
        assert regression.student_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert regression.student_p(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
        w = t / math.sqrt(4 + t * t)
        assert regression.student_p(t, 4) == pytest.approx(1 - w * (3 - w * w) / 2, rel=1e-6)
    assert regression.student_p(1.5, 1e6) == pytest.approx(regression.normal_p(1.5), rel=1e-5)
    assert (regression.student_p(0.0, 5), regression.student_p(math.inf, 5)) == (1.0, 0.0)


def test_logits_in_shared_passes(data):
    """Models of different rows and outcomes as if fitted one by one; separated data are named."""
    odd = data.withColumns(
        {
            "part": F.col("hh_id") % 3,
            # in part 1 nobody with g = c and everybody with h = v and g = a is hit
            "apart": F.when(F.col("g") == "c", 0.0).when((F.col("h") == "v") & (F.col("g") == "a"), 1.0).otherwise(F.col("hit")),
            "clear": (F.col("x") > 0).cast("double"),
            "holes": F.when(F.col("hh_id") % 7 > 0, F.col("hit")),
        }
    )
    models = {
        "all": ("hit", F.lit(True)),
        "part": ("hit", F.col("part") == 1),
        "holes": ("holes", F.col("part") == 2),
        "apart": ("apart", F.col("part") == 1),
        "clear": ("clear", F.lit(True)),
    }
    fits = regression.logits(odd, models, SPEC)
    for name, rows in (("all", odd), ("part", odd.filter("part = 1")), ("holes", odd.filter("part = 2"))):
        y = models[name][0]
        single = regression.logit(rows, y, SPEC)
        assert fits[name].coefficients == pytest.approx(single.coefficients, abs=1e-7)
        assert fits[name].errors == pytest.approx(single.errors, rel=1e-6)
        assert fits[name].fit["converged"] and not fits[name].fit["separated"]
        assert fits[name].fit["n"] == rows.filter(F.col(y).isNotNull()).count()
    assert fits["apart"].fit["separated"] and "gc" in fits["apart"].growing
    assert fits["clear"].fit["separated"] and "x" in fits["clear"].growing
    assert not fits["clear"].fit["converged"] and fits["clear"].fit["iterations"] < 30


def test_states_of_tasks_without_rows_and_of_no_rows(data):
    from levyscape.operators.design import design_columns, tall_factor

    none = data.filter("hh_id < 0")
    n, r = tall_factor(none, design_columns([]))
    assert n == 0 and not r.any()
    with pytest.raises(ValueError):
        regression.ols(none, "y", SPEC)
    with pytest.raises(ValueError):
        regression.logit(none, "hit", SPEC)
    few = regression.ols(data.filter("hh_id < 2").repartition(6), "y", ModelSpec(("x", "x2")))
    assert few.fit["n"] == 2 and few.errors == [None, None] and [t.name for t in few.aliased] == ["x2"]


def _forest_rows(spark, n=6000):
    rng = np.random.default_rng(5)
    x, a, b = rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 5, n)
    y = np.sin(2 * x) + 2.0 * a * (b > 2) + rng.normal(scale=0.1, size=n)
    rows = [(int(i), *map(float, r)) for i, r in enumerate(zip(x, a, b, np.ones(n), y))]
    return spark.createDataFrame(rows, "k long, x double, a double, b double, same double, y double").repartition(5)


_FOREST = ["x", "a", "b", "same"]


def test_forest_is_the_same_however_it_is_dealt_out(spark, monkeypatch):
    """Trees grown in one region each, and in many with upper nodes from histograms, cut alike."""
    from levyscape.operators import forests

    rows = _forest_rows(spark)
    whole = learning.forest(rows, "y", _FOREST, mtry=2, trees=12)
    one = learning.predict_with_truth(whole, rows, _FOREST, "y", "k").toPandas().sort_values("k")
    assert not (whole.top.column >= 0).any() and len(one) == 6000
    monkeypatch.setattr(forests, "REGION", 300)
    monkeypatch.setattr(forests, "CELLS", 5000)
    parts = learning.forest(rows, "y", _FOREST, mtry=2, trees=12)
    many = learning.predict_with_truth(parts, rows, _FOREST, "y", "k").toPandas().sort_values("k")
    assert (parts.top.column >= 0).sum() > 100
    assert one.Predicted.to_numpy() == pytest.approx(many.Predicted.to_numpy(), abs=1e-9)
    assert whole.importances() == pytest.approx(parts.importances(), abs=1e-9)
    assert whole.importances()[3] == 0 and sum(whole.importances()) == pytest.approx(1)
    # the largest part of a tree that a task holds is bounded by the region, not by the table
    assert parts.nodes.selectExpr("max(length(mean)) / 8 as n").first().n <= 300 / 5


def test_forest_is_as_good_as_the_learner_of_spark(spark):
    from pyspark.ml.regression import RandomForestRegressor

    rows = _forest_rows(spark)
    train, rest = rows.filter("k % 4 > 0"), rows.filter("k % 4 = 0")
    # without the constant column: a node that tries no other stays a leaf, and luck decides how many do
    names = _FOREST[:3]
    learner = RandomForestRegressor(labelCol="y", numTrees=60, maxDepth=30, minInstancesPerNode=5, featureSubsetStrategy="2", seed=1)
    theirs = learner.fit(learning.assembled(train, names))
    scored = theirs.transform(learning.assembled(rest, names))
    want = regression.prediction_errors(scored, "y", "prediction").first().rmse
    ours = learning.forest(train, "y", names, mtry=2, trees=60)
    assert regression.prediction_errors(learning.predict_with_truth(ours, rest, names, "y", "k"), "Actual", "Predicted").first().rmse == pytest.approx(want, rel=0.1)
    assert ours.importances() == pytest.approx(theirs.featureImportances.toArray().tolist(), abs=0.05)


def test_forest_search_leaves_folds_out(spark):
    """An outcome of pure noise: rows a tree has seen would be predicted better than by their mean."""
    rows = spark.createDataFrame([(i, float(i * 7919 % 1009), float(i * 104729 % 997)) for i in range(1500)], "k long, x double, y double")
    found = learning.forest_cv(rows, "y", ["x"], mtry=(1, 3), folds=4, trees=8)
    sd = rows.agg(F.stddev_pop("y")).first()[0]
    assert found.mtry == [1, 3] and all(r > 0.98 * sd for r in found.rmse)
    assert found.best.trees.held.max() == -1 and len(found.best.trees.names) == 8


def test_forest_of_odd_rows(spark):
    """Few rows, equal outcomes, missing predictors and outcomes, and no rows."""
    rows = spark.createDataFrame([(i, float(i % 3) if i else None, 7.5) for i in range(9)], "k long, x double, y double")
    few = learning.predict_with_truth(learning.forest(rows, "y", ["x"], 1, trees=5), rows, ["x"], "y", "k").collect()
    assert sorted(r.k for r in few) == list(range(1, 9)) and all(r.Predicted == pytest.approx(7.5) for r in few)
    with pytest.raises(ValueError):
        learning.forest(rows.filter("k = 0"), "y", ["x"], 1, trees=2)
    with pytest.raises(ValueError):
        learning.forest(rows.withColumn("y", F.when(F.col("k") > 4, 1.0)), "y", ["x"], 1, trees=2)


def test_forest_of_rows_that_a_task_can_hold_takes_no_pass_for_its_upper_nodes(spark, monkeypatch):
    from levyscape.operators import forests

    passes = []
    plain = forests._level
    monkeypatch.setattr(forests, "_level", lambda *a: passes.append(1) or plain(*a))
    rows = spark.range(40000).selectExpr("double(id % 997) as x", "double(id * 31 % 101) as y")
    model = learning.forest(rows, "y", ["x"], mtry=1, trees=3)
    assert not passes and len(model.top.tree) == 3 and model.nodes.count() == 3


def test_large_nodes_and_many_small_ones_are_cut_as_a_plain_tree_is(monkeypatch):
    """One by one above SMALL rows, side by side below, columns of 1, 2 and more bins."""
    from levyscape.operators import forests

    rng = np.random.default_rng(8)
    n = 3000
    values = [rng.normal(size=n), *rng.integers(0, 2, (9, n)).astype(float), np.ones(n), rng.integers(0, 5, n).astype(float)]
    cuts = [np.quantile(values[0], np.arange(1, 32) / 32), *[np.array([0.5])] * 9, np.zeros(0), np.arange(4) + 0.5]
    code = forests.Code(tuple(map(str, range(12))), tuple(cuts))
    packed = code.pack(values)
    y = values[0] * values[3] + np.sin(values[11]) + rng.normal(scale=0.3, size=n)
    w = rng.integers(1, 4, n).astype(float)
    want = forests._plain_subtree(code.unpack(packed), y, w, np.uint64(77), 5, 12, 5, code.widths)
    for small, side in ((2000, 4000), (300, 900), (30, 40)):
        monkeypatch.setattr(forests, "SMALL", small)
        monkeypatch.setattr(forests, "SIDE", side)
        got = forests._subtree(code, packed, y, w, np.uint64(77), 5, 12, 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and (want[0] >= 0).sum() > 200
        assert got[2] == pytest.approx(want[2]) and got[3] == pytest.approx(want[3])


def test_draws_are_those_of_the_hash():
    from levyscape.operators import forests

    trees = forests.plan([(1, -1), (1, 2)], 40, 4, 1)
    ids = np.arange(5000, dtype=np.uint64) * np.uint64(3)
    u = (forests._hash(ids[:, None], trees.names[None, :]) >> np.uint64(11)).astype(float) / 2**53
    want = np.searchsorted(forests._POISSON, u, "right")
    want[trees.fold(ids)[:, None] == trees.held[None, :]] = 0
    for tree, rows, w in trees.drawn(ids, range(80)):
        assert (w == want[:, tree]).all() and (rows == np.flatnonzero(w)).all()
    assert [len(rows) for _, rows in trees.scored(ids, (0, 40))] == [5000, (trees.fold(ids) == 2).sum()]
