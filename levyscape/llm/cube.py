"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source is taken floor(m) times, m = target / size of its source, and
once more with probability m - floor(m). Which ones are taken once more is decided by
the cube method: the fractional probabilities move through the null space of the two
balancing equations (words, documents) until all but two are 0 or 1. Three documents
are on the move at a time; a settled one is replaced by the next.

A source is divided into groups of about `GROUP` documents by a hash of the id, the text
and the number of the repeat, so that repeats of one row are spread as well. What a
group leaves unsettled, two documents at most, moves on with that of up to `FAN` other
groups, until each source is one group. There a dozen documents of all sizes stay out of
the flight; with the two it leaves they are the landing problem, solved by trying every
choice. Order and random numbers depend on the rows alone: reruns agree.

Defined cases: a null text has size 0 and takes part; a null source is a source, the
last; repeated rows are documents of their own; an empty table gives an empty result;
sources without words have target 0; further columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscape.llm.common import as_row, of_row, stage

GROUP, FAN, SEED = 10_000, 4096, 17
# repeats of one row that are spelled out together
RUN = 1_000
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9
# documents kept for the landing, besides the two that the flight leaves
LANDING = 12


def targets(totals: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """totals (source, source_size, n) with the words to take of each source.

    Weights repeat along the sources by code point, null last. A target stops at `most`
    times its source; the excess goes to the others by weight, until none is above. One
    row per source is ordered in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    weighed = stage(totals.withColumn("weight", weight), "weights")
    level, before = 0.0, -1
    while True:
        full = F.col("source_size") * most < level * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == before or not row["open"]:
            break
        before = row["n"]
        level = (share * (row["all"] or 0) - most * (row["full"] or 0)) / row["open"]
    goal = F.least(F.col("source_size") * most, F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", goal.cast("double"))


def flight(units: list[list], rng: random.Random) -> None:
    """Move the probabilities of units [probability, size], in place, until two at most are between 0 and 1."""
    active: list[list] = []
    for unit in units:
        if not 0 < unit[0] < 1:
            continue
        active.append(unit)
        if len(active) < 3:
            continue
        a, b, c = (x[1] for x in active)
        u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - p[0]) / d if d > 0 else -p[0] / d for p, d in zip(active, u) if d)
        down = min(p[0] / d if d > 0 else (p[0] - 1) / d for p, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for p, d in zip(active, u):
            x = p[0] + step * d
            p[0] = 0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x
        active = [x for x in active if 0 < x[0] < 1]


def land(units: list[list]) -> None:
    """Settle the last few units at once: the choice that misses the fewest words, then the fewest documents."""
    if not units:
        return
    chance, size = (np.array(x) for x in zip(*units))
    choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    miss = np.abs(choices @ size - chance @ size) + 0.01 * size.mean() * np.abs(choices.sum(axis=1) - chance.sum())
    for unit, x in zip(units, choices[miss.argmin()].tolist()):
        unit[0] = float(x)


def _settle(level: int, last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "mark"], ascending=[False, True, True], kind="stable")
        units = [list(x) for x in zip(rows["chance"].tolist(), rows["size"].astype(float).tolist())]
        moving = [x for x in units if 0 < x[0] < 1]
        kept = moving[:: max(1, len(moving) // LANDING)][:LANDING] if last else []
        spared = {id(x) for x in kept}
        flight([x for x in moving if id(x) not in spared], random.Random(f"{seed} {level} {key[0]!r} {key[1]}"))
        if last:
            land([x for x in moving if 0 < x[0] < 1])
        return rows.assign(chance=[x[0] for x in units])

    return run


def numbered_repeats(sized: DataFrame) -> DataFrame:
    """sized with equal rows numbered as `nth`: counted, dealt out in runs of `RUN`, spelled out run by run."""
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("rows"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN).cast("long"))))
    # a row with very many repeats is one row of the counts
    runs = runs.repartition("doc_id", "mark", "run")
    first = F.col("run") * RUN
    return runs.withColumn("nth", F.explode(F.sequence(first, F.least(F.col("rows"), first + RUN) - 1))).drop("rows", "run")


def balanced(rows: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """rows (source, id, mark, nth, size, chance, n: rows of the source, ...) with chance moved to 0 or 1."""
    groups = F.ceil(F.col("n") / group).cast("long")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "mark", "nth"), groups))
    biggest = rows.agg(F.max("bucket")).first()[0]
    level, settled = 0, []
    while biggest is not None:
        last = biggest == 0
        moved = stage(rows.groupBy("source", "bucket").applyInPandas(_settle(level, last, seed), rows.schema), "flight")
        if last:
            settled.append(moved)
            break
        between = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(moved.filter(~between))
        rows = moved.filter(between).withColumn("bucket", F.floor(F.col("bucket") / FAN))
        biggest, level = biggest // FAN, level + 1
    out = settled[0] if settled else rows
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.drop("bucket")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, source, mark (hash of the text), size, source_size, target, copies and taken (= copies * size) per row of docs."""
    sized = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    sized = stage(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(totals, share, most, weights).select(F.col("source").alias("of"), "source_size", "n", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        numbered_repeats(sized).join(goals, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("id", F.col("doc_id").cast("string"))
        .withColumn("whole", F.floor(rate))
        .withColumn("chance", rate - F.floor(rate))
    )
    done = balanced(rows, seed, group).withColumn("copies", F.col("whole") + F.round("chance").cast("long"))
    return done.select("doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the number of the copy (from 1) as `copy`."""
    plan = mix_sources(docs, **options)
    key = ["id", "source", "mark"]
    alike = plan.select(F.col("doc_id").cast("string").alias("id"), "source", "mark", "copies").groupBy(*key)
    # documents of a source differ by one copy at most
    per_key = alike.agg(F.min("copies").alias("least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    rows = docs.select(
        as_row(docs), F.col("doc_id").cast("string").alias("of_id"), F.col("source").cast("string").alias("of_source"), F.xxhash64("text").alias("of_mark")
    )
    same = F.col("of_id").eqNullSafe(F.col("id")) & F.col("of_source").eqNullSafe(F.col("source")) & (F.col("of_mark") == F.col("mark"))
    # of rows that are alike in all three, the first ones are taken once more
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    times = F.col("least") + F.when(nth <= F.col("more"), 1).otherwise(0)
    taken = rows.join(per_key.hint("shuffle_hash"), same).withColumn("times", times).filter("times > 0")
    names = [c for c in docs.columns if c != "copy"]
    return taken.select(*of_row(names), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))


def query(spark, sf_dir: str) -> DataFrame:
    plan = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")
