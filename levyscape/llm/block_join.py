"""Exact nearest neighbours by a block matrix join with int8 tiles.

Vectors are dealt into blocks by a hash of their id. Query blocks and candidate blocks
meet tile by tile on the pair of block numbers. A tile multiplies the vectors rounded to
int8 (one scale per vector; the sums of products are whole numbers, exact in single
precision) and knows how far the result can be from the true product: with x = x' + e,

    |x.y - x'.y'| <= |x'| |f| + |e| |y|        (y = y' + f)

Pairs whose upper bound reaches the k-th best lower bound of their query survive and are
recomputed in double precision from the original components, summed in order. Each tile
returns the best k of a query; the best of all tiles are merged per query.

Equal vectors of a block are one column of the tile: at most the k + 1 smallest ids of
each can be among the best, so the others are set aside without loss.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite
components take no part, nor do rows without an id; rows that repeat an id count as one
vector, the smallest; vectors of different lengths are not compared; further columns are
ignored; queries without any candidate, and empty tables, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscape.llm.common import int64_column, stage, whole_buckets

K, QUERY_BLOCK, BLOCK = 20, 1024, 8192

BLOCKS = "dim long, block long, ids binary, vectors binary"


def usable(df: DataFrame, vector: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).filter(finite & some).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _pack(most_equal: int):
    def run(batches):
        for table in whole_buckets(batches, 1):
            lists = table.column("v").combine_chunks()
            dims, block, ids = (int64_column(table.column(c)) for c in ("dim", "g", "vec_id"))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for b in np.unique(block):
                for dim in np.unique(dims[block == b]).tolist():
                    at = np.flatnonzero((block == b) & (dims == dim))
                    m = flat[(ends[at] - dim)[:, None] + np.arange(dim)] + 0.0  # no negative zeros
                    order = np.lexsort((*m.T[::-1], ids[at]))
                    m, who = m[order], ids[at][order]
                    new = np.concatenate(([True], who[1:] != who[:-1]))  # of rows that repeat an id, the smallest vector
                    m, who = m[new], who[new]
                    if most_equal:
                        raw = np.ascontiguousarray(m).view(np.dtype((np.void, 8 * dim))).ravel()
                        _, kind = np.unique(raw, return_inverse=True)
                        by = np.lexsort((who, kind))
                        start = np.concatenate(([True], kind[by][1:] != kind[by][:-1]))
                        nth = np.arange(len(by)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                        few = np.sort(by[nth < most_equal])
                        m, who = m[few], who[few]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim]), pa.array([int(b)]), pa.array([who.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                        ["dim", "block", "ids", "vectors"],
                    )

    return run


def blocks(vectors: DataFrame, n_blocks: int, most_equal: int = 0) -> DataFrame:
    """One row per block and length: ids and vectors, packed."""
    dealt = vectors.select("vec_id", "v", F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("g"))
    return dealt.repartition(n_blocks, "g").sortWithinPartitions("g").mapInArrow(_pack(most_equal), BLOCKS)


def rounded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of the rounded vectors and of what rounding left."""
    scale = np.abs(m).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    q = np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(m - back, axis=1)


def tile(q_ids, q, c_ids, c, k: int):
    """(query, candidate, score) of the k best candidates of each query in one tile."""
    qi, qs, q_len, q_err = rounded(q)
    ci, cs, c_len, c_err = rounded(c)
    whole = np.linalg.norm(c, axis=1)
    # sums of 127 * 127 stay exact in single precision up to 1,040 components
    kind = np.float32 if q.shape[1] <= 1024 else np.float64
    about = (qi.astype(kind) @ ci.T.astype(kind)).astype(np.float64) * qs[:, None] * cs[None, :]
    off = q_len[:, None] * c_err[None, :] + q_err[:, None] * whole[None, :]
    off += 1e-9 * (np.abs(about) + off) + 1e-300  # rounding of the bound itself
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, about - off)
    n = min(k, low.shape[1])
    least = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
    a, b = np.nonzero((about + off >= least[:, None]) & ~own)
    score = np.zeros(len(a))
    for d in range(q.shape[1]):
        score += q[a, d] * c[b, d]
    order = np.lexsort((c_ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else a
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.concatenate((start, [len(a)]))))
    best = nth < k
    return q_ids[a[best]], c_ids[b[best]], score[best]


def _tiles(k: int):
    def run(batches):
        for batch in batches:
            for dim, q_ids, q, c_ids, c in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found = tile(
                    np.frombuffer(q_ids, np.int64), np.frombuffer(q).reshape(-1, dim), np.frombuffer(c_ids, np.int64), np.frombuffer(c).reshape(-1, dim), k
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product, other ids than the query's own."""
    q, c = usable(queries, vector), usable(candidates, vector)
    n_q = max(1, -(-q.count() // QUERY_BLOCK))
    n_c = max(1, -(-c.count() // BLOCK))
    rows = stage(blocks(q, n_q), "queries").withColumnRenamed("ids", "q_ids").withColumnRenamed("vectors", "q").withColumnRenamed("block", "q_block")
    columns = stage(blocks(c, n_c, k + 1), "candidates")
    # every query block goes to every candidate block, by number
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<bigint>")))
    columns = columns.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")))
    met = rows.join(columns, ["dim", "q_block", "block"]).select("dim", "q_ids", "q", "ids", "vectors")
    found = met.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
