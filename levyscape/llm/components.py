"""Connected components of a graph given as links, by large-star and small-star rounds.

In each round every vertex links its larger neighbours, then its smaller ones, to the
smallest vertex it knows; the links end as stars around the smallest vertex of each
component. Minima are combined before the shuffle and joined back, so that a vertex of
any degree is spread over tasks. Each round is a written table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.llm.common import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task contracted to stars: each vertex but the smallest with the smallest of its component."""
    vertices, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(vertices))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(root)))
    return vertices[far], vertices[root[far]]


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Rows (a, root) for each vertex of links (a, b: long) that is not the smallest of its component."""
    links = stage(links.filter("a <> b").distinct(), "links")
    before = None
    while True:
        links = stage(_small_star(_large_star(links)).filter("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.withColumnRenamed("b", "root")
        before = now
