"""Hard negatives by exact integer scores from residue-number-system products.

Components are whole numbers. A task holds a block of anchors and streams packed blocks
of candidates past it. For each of several small odd primes it multiplies the balanced
residues of both in single precision: with primes up to 251 the sums of 1,024 products
stay below 2^24 and are exact; longer vectors are cut and their parts reduced before
they are added. The residues of a score give its balanced mixed-radix digits (Chinese
remaindering without a large modulus), and these the signed score. As many primes are
taken as the largest possible score needs, by the largest component of either side.

Two passes: the first scores anchors against candidates of their own label and keeps the
best positives; the second scores them against all others and selects, for each positive,
the best negatives within its window of scores. Within a task the best so far are merged
after each block; the few that each task keeps are ranked by a window.

What travels: anchor blocks once per group of candidate blocks, candidate blocks once per
anchor block. There are as many groups as keep all cores busy, or as the groups' size
asks for.

Defined cases: rows with a null label, a null vector, or any null or non-finite component
take no part, nor do rows without an id; a vector whose score with itself might pass 64
bits (a component above sqrt(2^63 / length)) takes none either; of rows that repeat an id
the smallest (label, vector) counts; vectors of different lengths are not compared; empty
vectors score 0; further columns are ignored; without positives or negatives there are no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscape.llm.common import int64_column, stage, whole_buckets

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
# a negative's score lies between these hundredths of its positive's
LOW, HIGH = 50, 95
ANCHORS, BLOCK, GROUP = 8192, 4096, 64
# anchors of a block that meet a candidate block at a time
TILE = 512
# a sum of so many products of balanced residues is exact in single precision
DEPTH = 1024
# fixed values: the largest odd primes of 8 bits; 11 of them pass 2^64 with room for the sign
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197, 193)

PACKED = "dim long, block long, ids binary, labels binary, vectors binary"
POSITIVE = "array<struct<score:bigint,vec_id:bigint>>"


def whole_vectors(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (whole numbers) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(finite)
    # what lies beyond 1e18 is too large for any length
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-1e18)), F.lit(1e18))))
    most = F.floor(F.sqrt(F.lit(2.0**63 - 1024) / F.greatest(F.size(v), F.lit(1))))
    rows = rows.filter(F.forall(whole, lambda x: F.abs(x) <= most))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _pack(with_positives: bool):
    """Rows sorted by g, vec_id: a packed row per length and block, ordered by label and id."""

    def run(batches):
        for table in whole_buckets(batches, 1):
            dims, block, ids, labels = (int64_column(table.column(c)) for c in ("dim", "g", "vec_id", "label"))
            lists = table.column("v").combine_chunks()
            flat, ends = int64_column(lists.flatten()), np.cumsum(dims)
            if with_positives:
                held = table.column("positives").combine_chunks()
                first = held.offsets.to_numpy()
                inner = held.flatten()
                score, who = int64_column(inner.field("score")), int64_column(inner.field("vec_id"))
                first = first - first[0]
            for b in np.unique(block):
                for dim in np.unique(dims[block == b]).tolist():
                    at = np.flatnonzero((block == b) & (dims == dim))
                    m = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                    order = np.lexsort((*m.T[::-1], labels[at], ids[at]))
                    at, m = at[order], m[order]
                    new = np.ones(len(at), bool)
                    new[1:] = ids[at][1:] != ids[at][:-1]  # of rows that repeat an id, the smallest
                    at, m = at[new], m[new]
                    order = np.argsort(labels[at], kind="stable")
                    at, m = at[order], m[order]
                    columns = [pa.array([dim]), pa.array([int(b)]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[at], labels[at], m.astype(np.int64)))]
                    names = ["dim", "block", "ids", "labels", "vectors"]
                    if with_positives:
                        n = np.diff(first)[at]
                        take = np.repeat(first[:-1][at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        columns += [pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.int64), score[take], who[take])]
                        names += ["counts", "scores", "positives"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def blocks(vectors: DataFrame, size: int, count: int, with_positives: bool = False) -> DataFrame:
    """Packed blocks of about `size` of the `count` vectors."""
    n = max(1, -(-count // size))
    dealt = vectors.withColumn("dim", F.size("v").cast("long")).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    more = ", counts binary, scores binary, positives binary" if with_positives else ""
    return dealt.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_pack(with_positives), PACKED + more)


def primes_for(largest: int, dim: int) -> tuple[int, ...]:
    """Enough primes that scores of vectors with such components are between -M/2 and M/2."""
    bound, m, out = 2 * largest * largest * max(dim, 1) + 1, 1, []
    for p in PRIMES:
        if m > bound:
            break
        out.append(p)
        m *= p
    return tuple(out or PRIMES[:1])


def balanced(m: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p - 1) / 2 and (p - 1) / 2."""
    r = np.mod(m, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residue of whole numbers in double precision."""
    return x - p * np.rint(x / p)


def residues(m: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    return [balanced(m, p) for p in primes]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact products of rows of a with rows of b, from their residues."""
    digits, out, weight = [], np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for i, p in enumerate(primes):
        x = np.zeros(out.shape)
        for d in range(0, a[i].shape[1], DEPTH):
            x = _reduced(x + a[i][:, d : d + DEPTH] @ b[i][:, d : d + DEPTH].T, p)
        # next digit: what the digits so far leave, over the primes so far
        for digit, q in zip(digits, primes):
            x = _reduced((x - digit) * pow(q, -1, p), p)
        digits.append(x)
        # 64-bit sums may wrap on the way, the score itself fits
        out += x.astype(np.int64) * np.int64((weight + 2**63) % 2**64 - 2**63)
        weight *= p
    return out


def best(keys: tuple, score: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: highest score, then smallest id."""
    order = np.lexsort((who, -score, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[order][1:] != x[order][:-1]
    start = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate((start, [len(order)]))))
    return order[nth < k]


def _positives(anchor, block, primes, k: int):
    """(anchor, candidate, score) of the k best of the anchor's label; both ordered by label."""
    found = []
    for label in np.unique(anchor["labels"]).tolist():
        x, y = (slice(*np.searchsorted(side["labels"], [label, label + 1]).tolist()) for side in (anchor, block))
        if y.start == y.stop:
            continue
        for i in range(x.start, x.stop, TILE):
            rows = slice(i, min(i + TILE, x.stop))
            s = scores([r[rows] for r in anchor["residues"]], [r[y] for r in block["residues"]], primes)
            q, c = anchor["ids"][rows], block["ids"][y]
            other = q[:, None] != c[None, :]
            n = min(k + 1, s.shape[1])  # one of them may be the anchor itself
            least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            a, b = np.nonzero((s >= least[:, None]) & other)
            keep = best((q[a],), s[a, b], c[b], k)
            found.append((q[a[keep]], c[b[keep]], s[a[keep], b[keep]]))
    return [np.concatenate(x) for x in zip(*found)] if found else None


def window_of(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative: low/100 and high/100 of the positive's, exactly."""
    q, r = positive // 100, positive % 100
    return q * low + -((-r * low) // 100), q * high + r * high // 100


def _negatives(anchor, block, primes, k: int):
    """(anchor, positive, candidate, positive's score, score) of the k best within each positive's window."""
    found = []
    for i in range(0, len(anchor["ids"]), TILE):
        rows = slice(i, min(i + TILE, len(anchor["ids"])))
        n = anchor["counts"][rows]
        first = np.cumsum(anchor["counts"])[rows] - n
        span = slice(first[0], first[-1] + n[-1])
        owner = np.repeat(np.arange(len(n)), n)
        p_score, p_id = anchor["scores"][span], anchor["positives"][span]
        low, high = window_of(p_score, LOW, HIGH)
        floor = np.minimum.reduceat(low, first - first[0])
        ceiling = np.maximum.reduceat(high, first - first[0])
        s = scores([r[rows] for r in anchor["residues"]], block["residues"], primes)
        a, b = np.nonzero((s >= floor[:, None]) & (s <= ceiling[:, None]) & (anchor["labels"][rows][:, None] != block["labels"][None, :]))
        if not len(a):
            continue
        value, who = s[a, b], block["ids"][b]
        # candidates in order of score, and each window's upper end in its place among them
        every = np.lexsort((np.concatenate((who, np.zeros(len(high), np.int64))), np.concatenate((np.ones(len(a), np.int8), np.zeros(len(high), np.int8))), -np.concatenate((value, high)), np.concatenate((a, owner))))
        is_window = every >= len(a)
        ordered = every[~is_window]
        start = (np.cumsum(~is_window))[is_window]
        window = every[is_window] - len(a)
        for step in range(k):
            at = start + step
            ok = at < len(ordered)
            hit = ordered[np.minimum(at, len(ordered) - 1)]
            ok &= (a[hit] == owner[window]) & (value[hit] >= low[window])
            w, hit = window[ok], hit[ok]
            found.append((anchor["ids"][rows][owner[w]], p_id[w], who[hit], p_score[w], value[hit]))
    return [np.concatenate(x) for x in zip(*found)] if found else None


def _meet(primes, k: int, negatives: bool):
    """Rows sorted by cell and kind: the cell's anchors, then its candidate blocks, one at a time."""
    names = ["anchor_id", "positive_id", "vec_id", "positive_score", "score"] if negatives else ["anchor_id", "vec_id", "score"]

    def merged(held):
        columns = [np.concatenate(x) for x in zip(*held)]
        keys = (columns[0], columns[1]) if negatives else (columns[0],)
        keep = best(keys, columns[-1], columns[2 if negatives else 1], k)
        return [x[keep] for x in columns]

    def run(batches):
        anchor, cell, held, rows = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["dim"], row["cell"])
                if here != cell:
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names)
                    anchor, cell, held, rows = None, here, [], 0
                block = {"ids": np.frombuffer(row["ids"], np.int64), "labels": np.frombuffer(row["labels"], np.int64)}
                block["residues"] = residues(np.frombuffer(row["vectors"], np.int64).reshape(len(block["ids"]), row["dim"]), primes)
                if row["kind"] == 0:
                    anchor = block
                    if negatives:
                        anchor |= {x: np.frombuffer(row[x], np.int64) for x in ("counts", "scores", "positives")}
                elif anchor is not None:
                    found = _negatives(anchor, block, primes, k) if negatives else _positives(anchor, block, primes, k)
                    if found is not None:
                        held.append(found)
                        rows += len(found[0])
                    if rows > 2_000_000:
                        held = [merged(held)]
                        rows = len(held[0][0])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names)

    return run


def met(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int, primes, k: int, negatives: bool) -> DataFrame:
    """Each block of anchors with each group of candidate blocks, in one task each; both staged by blocks()."""
    groups = max(1, -(-n_candidates // GROUP), min(n_candidates, -(-2 * anchors.sparkSession.sparkContext.defaultParallelism // n_anchors)))
    more = [F.lit(None).cast("binary").alias(c) for c in ("counts", "scores", "positives")] if negatives else []
    columns = ["dim", "ids", "labels", "vectors"] + (["counts", "scores", "positives"] if negatives else [])
    part = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))
    side = F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)).cast("array<bigint>"))
    left = anchors.withColumn("part", part).select((F.col("block") * groups + F.col("part")).alias("cell"), F.lit(0).alias("kind"), *columns)
    right = candidates.withColumn("side", side).select((F.col("side") * groups + F.col("block") % groups).alias("cell"), F.lit(1).alias("kind"), "dim", "ids", "labels", "vectors", *more)
    cells = left.unionByName(right).repartition(n_anchors * groups, "dim", "cell").sortWithinPartitions("dim", "cell", "kind")
    out = "anchor_id long, positive_id long, vec_id long, positive_score long, score long" if negatives else "anchor_id long, vec_id long, score long"
    return cells.mapInArrow(_meet(primes, k, negatives), out)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, v (whole numbers); is_anchor: condition on vec_id.
    """
    vectors = stage(vectors, "vectors")
    size = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    count, of_anchors, dim, largest = vectors.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("v")), size).first()
    primes = primes_for(largest or 0, dim or 0)
    n_a, n_c = max(1, -(-of_anchors // ANCHORS)), max(1, -(-count // BLOCK))
    candidates = stage(blocks(vectors, BLOCK, count), "candidates")
    anchors = stage(blocks(vectors.filter(is_anchor), ANCHORS, of_anchors), "anchors")
    near = met(anchors, candidates, n_a, n_c, primes, positives, False)
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id"))
    near = near.withColumn("nth", nth).filter(F.col("nth") <= positives)
    # windows above zero only: 50 and 95 hundredths of a negative score do not enclose anything
    near = near.filter("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("score", F.col("vec_id").alias("vec_id"))).alias("positives"))
    held = vectors.filter(is_anchor).join(near, "vec_id").select("vec_id", "label", "v", F.col("positives").cast(POSITIVE).alias("positives"))
    anchors = stage(blocks(held, ANCHORS, of_anchors, True), "anchors")
    far = met(anchors, candidates, n_a, n_c, primes, negatives, True)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id"))
    far = far.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
