import random

import pytest

from levyscape.llm import cube
from .helpers import docs, prose, words

SF = "/root/testdata/sf0.001"


def water(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by source, the excess of full ones shared again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def check(plan, table, near):
    sizes = {}
    for _, text, source in table:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = water(sizes)
    taken = {s: 0 for s in sizes}
    for r in plan:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert len(plan) == len(table)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near * max(1, target[s]), s


def test_query_table(spark):
    table = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    plan = cube.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check(plan, table, 0.01)
    rows = sorted(tuple(r) for r in cube.query(spark, SF).collect())
    assert rows == sorted(tuple(r) for r in cube.mix_sources(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect())


def test_levels_of_groups(spark, monkeypatch):
    """Small groups and a small fan: several levels, still near the targets."""
    rng = random.Random(4)
    table = [(i, prose(i, rng.randint(0, 40)), rng.choice(["a", "b", "B", None, "é"])) for i in range(900)]
    monkeypatch.setattr(cube, "FAN", 3)
    df = docs(spark, [(i, t, None, s) for i, t, s in table], extra=("mark", "copies", "n"))
    check(cube.mix_sources(df, group=10).collect(), table, 0.01)


def test_awkward_rows_and_empty_table(spark):
    table = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "q r", None), (4, "d e f g h i j k", "z")]
    df = docs(spark, [(i, t, None, s) for i, t, s in table], extra=("of_id", "times", "bucket"))
    plan = cube.mix_sources(df).collect()
    assert len(plan) == 6 and all(0 <= r.taken <= 2 * r.size for r in plan)
    mix = cube.repeat_documents(df)
    assert mix.columns == [*df.columns, "copy"]
    copies = {}
    for r in plan:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    assert cube.mix_sources(docs(spark, [])).collect() == [] and cube.repeat_documents(docs(spark, [])).collect() == []


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    units = [[rng.random(), float(rng.randint(1, 500))] for _ in range(400)]
    words_, n = sum(p * s for p, s in units), sum(p for p, _ in units)
    cube.flight(units, random.Random(2))
    assert sum(0 < p < 1 for p, _ in units) <= 2
    assert sum(p * s for p, s in units) == pytest.approx(words_) and sum(p for p, _ in units) == pytest.approx(n)


def test_flight_hits_each_unit_as_often_as_its_chance():
    hits = 0
    for seed in range(600):
        units = [[0.3, float(s)] for s in range(5, 35)]
        cube.flight(units, random.Random(seed))
        hits += units[4][0]
    assert abs(hits / 600 - 0.3) < 0.08


def test_repeats_of_one_row_are_spread(spark):
    """A null id with one text makes most of the table: its rows get numbers of their own, over several runs."""
    table = [(None, "a b c", "x")] * 3500 + [(i, prose(i, 30), random.Random(i).choice(["x", "y"])) for i in range(400)]
    df = docs(spark, [(i, t, None, s) for i, t, s in table])
    check(cube.mix_sources(df, group=100).collect(), table, 0.01)
    sized = df.selectExpr("doc_id", "source", "xxhash64(text) AS mark", "3L AS size")
    numbered = cube.numbered_repeats(sized)
    assert numbered.count() == len(table)
    same = numbered.filter("doc_id IS NULL")
    assert sorted(r.nth for r in same.collect()) == list(range(3500))
    assert same.selectExpr("pmod(xxhash64(CAST(doc_id AS STRING), mark, nth), 39) AS b").groupBy("b").count().agg({"count": "max"}).first()[0] < 150
