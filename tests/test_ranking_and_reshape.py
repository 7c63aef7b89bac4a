import random

import pytest
from pyspark.sql import functions as F

from levyscape.operators import ranking, reshape, splits
from levyscape.sources import readers, writers


@pytest.mark.parametrize("rows_per_cell", [50_000, 5])
def test_ranked_with_ties_and_hot_group(spark, rows_per_cell):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice("abc"), float(rnd.choice([0, 0, 0, 1, 2, 7])), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, x double, id bigint").repartition(6)
    got = {r.id: (r.rn, r.n) for r in ranking.ranked(df, "x", "id", ["g"], rows_per_cell=rows_per_cell).collect()}
    for g in ("a", "b", "c", "hot"):
        mine = sorted((x, i) for h, x, i in rows if h == g)
        for rn, (_, i) in enumerate(mine, 1):
            assert got[i] == (rn, len(mine))
    overall = {r.id: r.rn for r in ranking.ranked(df, "x", "id", rows_per_cell=rows_per_cell).collect()}
    assert [i for i, _ in sorted(overall.items(), key=lambda kv: kv[1])] == [i for _, i in sorted((x, i) for _, x, i in rows)]


def test_ranked_with_fractional_and_negative_values(spark):
    rnd = random.Random(2)
    rows = [(rnd.gauss(0, 1), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, id bigint")
    got = {r.id: r.rn for r in ranking.ranked(df, "x", "id", rows_per_cell=7).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1])] == [i for _, i in sorted(rows)]


@pytest.mark.parametrize("n, k", [(10, 3), (3, 10), (100, 10), (7, 7)])
def test_ntile_agrees_with_the_window_function(spark, n, k):
    from pyspark.sql import Window

    df = spark.range(n).select(F.col("id"), ((F.col("id") * 37) % 11).cast("double").alias("x"))
    mine = ranking.ntile(df, "x", k, "id", "t")
    want = df.withColumn("t", F.ntile(k).over(Window.orderBy("x", "id")))
    assert sorted((r.id, r.t) for r in mine.collect()) == sorted((r.id, r.t) for r in want.collect())


@pytest.mark.parametrize("cell", [None, 9])
def test_ranking_by_keys_of_any_type(spark, cell):
    """Text, dates and nulls as order, tie-break and group; the window function is the plain version."""
    from pyspark.sql import Window

    df = spark.range(400).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") * 7919 % 23)).alias("text"),
        F.when(F.col("id") % 2 > 0, F.col("id") * 31 % 17).alias("half"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 11).cast("int")).alias("day"),
        F.concat(F.lit("id"), F.col("id")).alias("id"),
    )
    for order, by in (("text", []), ("half", []), ("day", ["text"]), ("half", ["text"]), ("text", ["half"])):
        within = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order, "id")
        got = ranking.ranked(df, order, "id", by, rows_per_cell=cell).select("id", "rn", "n")
        want = df.select("id", F.row_number().over(within).alias("rn"), F.count("*").over(Window.partitionBy(*(by or [F.lit(0)]))).alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        present = Window.partitionBy(*(by or [F.lit(0)]), F.col(order).isNull()).orderBy(order, "id")
        tiles = df.select("id", F.when(F.col(order).isNotNull(), F.ntile(4).over(present)).alias("t"))
        got = ranking.ntile(df, order, 4, "id", "t", by, rows_per_cell=cell).select("id", "t")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, tiles.collect()), key=repr)


def test_no_range_holds_more_than_its_share_of_nulls_ties_or_a_group(spark):
    """Half of all rows without a value, a third in one group, a quarter at one value: ranges of about 1 % stay under 2 %."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 > 0, F.when(F.col("id") % 4 == 1, 5.0).otherwise(F.rand(1))).alias("x"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 50).otherwise(-1).alias("g"),
        F.concat(F.lit("t"), F.col("id")).alias("tie"),
    )
    for keys in (["x", "tie"], ["g", "x", "tie"]):
        dealt = ranking.dealt_by_range(df, keys, rows_per_cell=400)
        sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 800


def test_equal_rows_and_empty_tables_rank(spark):
    same = spark.createDataFrame([(1.0, "a")] * 50, "x double, tie string")
    assert sorted(r.rn for r in ranking.ranked(same, "x", "tie", rows_per_cell=5).collect()) == list(range(1, 51))
    assert ranking.ranked(same.limit(0), "x", "tie").count() == 0 and ranking.ntile(same.limit(0), "x", 3, "tie", "t", ["tie"]).count() == 0


def test_stratified_split_by_a_text_key(spark):
    df = spark.range(500).select(F.concat(F.lit("h"), F.col("id")).alias("hh"), (F.col("id") % 37).cast("double").alias("y"))
    out = splits.stratified_split(df, "y", "hh")
    assert out.count() == 500 and out.filter("train").count() == 350
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, splits.stratified_split(df.repartition(7), "y", "hh").collect()))


def test_ntile_of_missing_is_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "id bigint, x double")
    assert {r.id: r.t for r in ranking.ntile(df, "x", 2, "id", "t").collect()} == {1: 1, 2: None, 3: 2}


def test_surrogates_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(k,) for k in [50, 7, 7, 1000, 3]], "hh_id bigint")
    got = {r.hh_id: r.new for r in ranking.surrogate_index(df, "hh_id", "new").collect()}
    assert got == {3: 1, 7: 2, 50: 3, 1000: 4}


def test_first_per_key_does_not_depend_on_partitioning(spark):
    rows = [(i % 5, (i * 7) % 13, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    runs = [sorted(reshape.first_per_key(d, "k", ["o"]).collect()) for d in (df.coalesce(1), df.repartition(9))]
    assert runs[0] == runs[1]
    for k, o, v in runs[0]:
        assert (o, v) == min((b, c) for a, b, c in rows if a == k)


def test_shares_sum_to_one_and_null_group_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 2.0)], "g string, v double")
    out = reshape.share_of(df, "v", ["g"]).collect()
    assert sorted((r.g or "", r.share) for r in out) == [("", 0.5), ("", 0.5), ("a", 0.25), ("a", 0.75)]


def test_pivot_and_transpose(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 5.0)], "id int, k string, v double")
    wide = reshape.pivot_fill(df, ["id"], "k", "v", ["a", "b"], "s_", 0.0).orderBy("id").collect()
    assert [(r.id, r.s_a, r.s_b) for r in wide] == [(1, 2.0, 3.0), (2, 5.0, 0.0)]
    flipped = reshape.transpose_summary(reshape.pivot_fill(df, ["id"], "k", "v", ["a", "b"]), "id", [1, 2])
    assert {r.variable: (r["1"], r["2"]) for r in flipped.collect()} == {"a": (2.0, 5.0), "b": (3.0, None)}


def test_split_shares(spark):
    df = spark.range(5000).select(F.col("id").alias("hh_id"), (F.col("id") % 97).cast("double").alias("y"))
    assert 0.72 < splits.hash_split(df, "hh_id").filter("train").count() / 5000 < 0.78
    out = splits.stratified_split(df, "y", "hh_id")
    assert out.filter("train").count() == 3500 and out.count() == 5000


def test_delimited_reader_keeps_quoted_separators(spark, tmp_path):
    path = tmp_path / "sectors.csv"
    path.write_bytes(b'Number;GTAP;Explanation\r\n1;pdr; Rice: seed \r\n8;ocr;"Other: one; two; ""three"""\r\n')
    rows = readers.read_delimited(spark, str(path), readers.SECTOR_LIST).collect()
    assert [tuple(r) for r in rows] == [(1, "pdr", "Rice: seed"), (8, "ocr", 'Other: one; two; "three"')]


def test_writers_and_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 2.5), ("B", 2, None)], "country string, id int, v double")
    writers.write_by_country(df, str(tmp_path / "c"))
    got = readers.read_country(spark, str(tmp_path / "c"), "B")
    assert [tuple(r) for r in got.select("id", "v").collect()] == [(2, None)]
    assert "PartitionFilters: [isnotnull(country" in got._jdf.queryExecution().toString()
    writers.write_csv(df, str(tmp_path / "d"))
    back = readers.read_csv(spark, str(tmp_path / "d"), "country string, id int, v double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert readers.drop_row_index(df).columns == ["id", "v"]
    assert readers.columns_between(df, "id", "v") == ["id", "v"]


def test_a_run_for_one_country_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "c")
    writers.write_by_country(spark.createDataFrame([("za", 1), ("za", 2), ("ng", 3)], "country string, v int"), path)
    writers.write_by_country(spark.createDataFrame([("za", 9)], "country string, v int"), path)
    writers.write_by_country(spark.createDataFrame([("ke", 4)], "country string, v int"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("country", "v").collect()) == [("ke", 4), ("ng", 3), ("za", 9)]
