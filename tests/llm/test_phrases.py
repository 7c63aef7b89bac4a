import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from levyscape.llm import phrases
from tests.llm.helpers import docs, lower, prose, rows


def plain(table, best=2000, longest=5, least=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in kept.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(q) for q, b in kept.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    common = [w.capitalize() if i % 5 == 0 else w for i, w in enumerate(prose(1, 7).split())]
    table = []
    for i in range(90):
        w = [rng.choice(common) + rng.choice(["", "", "", "", ",", ".", "\t", "\n", "\x0b"]) for _ in range(400)]
        w += ["the quick brown fox jumps over"] * rng.randint(0, 5) + ["a a a a a a a"] + [f"rare{rng.random()}"]
        table.append((i, " ".join(w), rng.choice(["en", "de", None])))
    table += [(90, None, "en"), (91, "", "en"), (92, " \n.,", "xx"), (93, "só été. " * 120, "fr"), (94, "zé\x01q zé " * 101 + "ÀB ab", "fr"), (95, "zé x und" * 120, "und")]
    return table


def test_against_brute_force(spark):
    table = corpus()
    want = plain(table)
    assert len(want) > 100 and rows(phrases.collocations(docs(spark, table, ["size", "phrase", "n", "rank"]))) == want


def test_small_slices_other_limits_and_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 500)
    monkeypatch.setattr(phrases, "HELD", 40)
    table = corpus(8)[:40] * 2
    assert rows(phrases.collocations(docs(spark, table), best=7, longest=3, least=30)) == plain(table, 7, 3, 30)


def test_a_long_text_and_a_hot_phrase(spark):
    table = [(1, "in the house, " * 60_000, "en"), (2, "in the garden. " * 150, "en"), (3, "x " * 200_000, None)]
    assert rows(phrases.collocations(docs(spark, table))) == plain(table)


def test_nothing_frequent(spark):
    assert rows(phrases.collocations(docs(spark, []))) == []
    assert rows(phrases.collocations(docs(spark, [(1, "one two three", "en")]))) == []


def test_products_beyond_64_bits(spark):
    schema = "lang string, size int, phrase string, f long"
    big = 4 * 10**12
    found = [("en", 0, "", 9 * 10**14), ("en", 1, "a", big + 7), ("en", 1, "b", big + 11), ("en", 2, "a b", big)]
    got = [tuple(r) for r in phrases.scored(spark.createDataFrame(found, schema)).collect()]
    assert got == [("en", "a b", big, big + 7, big + 11, 9 * 10**14, 1000 * big * 9 * 10**14 // ((big + 7) * (big + 11)))]


def test_rows_of_a_phrase_follow_the_cores_not_the_splits(spark):
    every = spark.sparkContext.broadcast(np.full(1 << 19, 2**64 - 1, np.uint64))
    tasks = 2 * spark.sparkContext.defaultParallelism
    table = spark.range(40 * tasks, numPartitions=4 * tasks).selectExpr("'in the house' AS text", "'en' AS lang")
    found = phrases.task_counts(table, [every, every])
    got = {r.phrase: (r.rows, r.n) for r in found.filter("size > 0").groupBy("phrase").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    assert set(got) == {"in", "the", "house", "in the", "the house"}
    assert all(rows <= tasks and n == 40 * tasks for rows, n in got.values()), got
