import random
from collections import defaultdict

import pytest

from levyscape.operators import quality as q
from pyspark.sql import functions as F
from levyscape.sources.staging import stage_observing


def lines(spark, rows):
    return spark.createDataFrame(rows, "hh_id bigint, item_code string, v double")


def test_baskets_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for hh in range(300):
        for item in rnd.sample("abcd", rnd.randint(1, 3)):
            rows.append((hh, item, float(rnd.randint(1, 3))))
    rows += [(0, "e", None)]
    rows += [(900, "a", 1.0), (900, "a", 1.0), (901, "a", 1.0)]  # a repeated line is not one line
    baskets = defaultdict(list)
    for hh, item, v in rows:
        if v is not None:
            baskets[hh].append((item, v))
    groups = defaultdict(list)
    for hh, b in baskets.items():
        groups[tuple(sorted(b))].append(hh)
    want = {hh: len(g) for g in groups.values() if len(g) > 1 for hh in g}
    got = {r.hh_id: r.number for r in q.duplicate_baskets(lines(spark, rows), "hh_id", "item_code", "v").collect()}
    assert got == want


def test_same_total_different_items(spark):
    rows = [(1, "a", 3.0), (2, "b", 3.0), (3, "a", 1.0), (3, "b", 1.5)]
    df = lines(spark, rows)
    assert q.duplicate_baskets(df, "hh_id", "item_code", "v").count() == 0
    assert {r.hh_id for r in q.duplicate_totals(df, "hh_id", "v").collect()} == {1, 2}


def test_shared_values_and_negative_totals(spark):
    rows = [(1, "a", 5.0), (1, "b", 2.0), (2, "a", 5.0), (2, "c", 9.0), (3, "b", 2.0), (4, "z", -1.0), (5, "q", 0.0)]
    df = lines(spark, rows)
    assert sorted(r.hh_id for r in q.shared_values(df, "hh_id", "item_code", "v").collect()) == [1, 3]
    assert [r.hh_id for r in q.negative_totals(df, "hh_id", "v").collect()] == [4]


def test_duplicate_rows_match_on_missing_values(spark):
    df = spark.createDataFrame([(1, None, 2), (2, None, 2), (3, 1, 2)], "hh_id int, a int, b int")
    assert sorted((r.hh_id, r.number) for r in q.duplicate_rows(df, "hh_id").collect()) == [(1, 2), (2, 2)]


def test_lines_codes_and_coverage(spark):
    df = lines(spark, [(1, "a", 1.0), (1, "a", 2.0), (1, "b", None), (2, "c", 1.0)])
    assert q.duplicate_lines(df, ["hh_id", "item_code"]).count() == 2
    assert sorted(map(tuple, q.collapse_lines(df, ["hh_id", "item_code"], "v").collect())) == [(1, "a", 3.0), (2, "c", 1.0)]
    dim = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "item_code string, label string")
    assert [r.item_code for r in q.unmatched_codes(df, dim, "item_code").collect()] == ["c"]
    assert [(r.item_code, r.n) for r in q.ambiguous_codes(dim, "item_code").collect()] == [("a", 2)]
    other = spark.createDataFrame([("b", "f"), ("d", "g")], "item_code string, fuel string")
    both = q.two_sided_coverage(dim.dropDuplicates(["item_code"]), other, "item_code", "label", "fuel")
    assert {r.item_code for r in both.collect()} == {"a", "d"}
    cover = q.key_coverage(df, spark.createDataFrame([(1,), (7,), (8,)], "hh_id bigint"), "hh_id").first()
    assert tuple(cover) == (2, 3, 1, 2)


def test_require_stops(spark):
    df = lines(spark, [(1, "a", 1.0)])
    q.require(df.filter("false"), "fine")
    with pytest.raises(q.CheckFailed, match="bad"):
        q.require(df, "bad")


def test_flagged_households_can_be_dropped(spark):
    df = lines(spark, [(1, "a", 1.0), (2, "b", 1.0)])
    flagged = df.filter("hh_id = 1").select("hh_id")
    assert [r.hh_id for r in q.drop_flagged(df, flagged, "hh_id").collect()] == [2]
    assert [r.hh_id for r in q.drill_down(df, flagged, "hh_id").collect()] == [1]
    assert q.report_row(flagged, "x", "%d found").first().detail == "1 found"


def test_infinite_guard(spark):
    df = spark.createDataFrame([(1.0,), (float("-inf"),), (None,)], "x double")
    assert q.has_infinite(df, ["x"]).first().infinite
    assert not q.has_infinite(df.filter("x = 1"), ["x"]).first().infinite


def test_infinities_are_seen_while_rows_are_staged(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("-inf")), (3, None)], "id int, x double")
    for rows, infinite in ((df, True), (df.filter("id <> 2"), False), (df.filter("x > 5"), False), (df.filter(F.lit(False)), False)):
        staged, seen = stage_observing(rows, infinite=q.any_infinite(["x"]))
        assert bool(seen.get("infinite")) is infinite
        assert sorted(r.id for r in staged.collect()) == sorted(r.id for r in rows.collect())
