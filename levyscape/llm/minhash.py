"""MinHash near-duplicates by one-permutation hashing with optimal densification.

One hash of every shingle serves all bins: its leading bits choose the bin, the smallest
hash of a bin is the bin's value. An empty bin takes the value of a bin that a hash of
(bin, attempt) chooses, with attempts until it hits one that is not empty; two documents
agree in such a bin with the probability of their similarity, as in any other. Six bins
make a band, 32 bands a document's keys: a pair at the limit of 0.85 misses all of them
with probability 3e-7.

Documents with equal sets are one vertex. A key's bucket gives star-shaped candidates:
its smallest vertex with each other one, so that pairs grow with the bucket's size, not
its square. A star alone may lose a link between two of its points, so what it left apart
goes on: each point not yet joined to the centre's component meets a growing slice of its
bucket (8, 256, 8,192, ... vertices), as far as these are of another component. After a
slice that covers the bucket every pair of it has been compared or lies in one component
already. Points join quickly, so few are left for the long slices; nothing is capped.

Two that meet become a candidate pair if their sizes and odd sketches allow a link: a set's
sketch has the parities of the numbers of its shingles in 1,024 cells, and sets that differ
in d shingles differ in d parities at most, so no link is lost there. All candidates are
verified on the full sets.

Defined cases: a text without words (null, empty, only blanks) has an empty set, no
links and itself as component; fewer than five words are one shingle; rows that repeat
an id each get a row; a null doc_id is a component's id only if there is no other (then
null, and kept); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.llm.common import (
    LAST_ID,
    groups,
    id_or_last,
    in_sieve,
    int64_column,
    lower_case,
    mix,
    name_words,
    sieve,
    slices,
    space_words,
    stage,
    utf8_column,
    window_names,
    window_starts,
    word_spans,
)
from levyscape.llm.components import components

SHINGLE, SHARE, OF = 5, 85, 100
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
# cells of an odd sketch, in longs
CELLS = 16
# bytes of text, and rows, whose shingles a task holds at a time
SLICE, MOST = 2 << 20, 4096
# vertices of a bucket that all its points meet after the star, and how the number grows
FIRST, GROWTH = 8, 32
# attempts before an empty bin takes the first full one; a single full bin is hit within them but once in e^21
ATTEMPTS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Names of each row's distinct shingles in order, and where each row's begin."""
    data = lower_case()[data]
    first, end, at = word_spans(data, offsets, space_words())
    names = name_words(data, first, end)
    words = np.diff(at)
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    h = np.empty(begin[-1], np.uint64)
    long = words >= width
    h[np.repeat(long, n)] = window_names(names, width)[window_starts(at, width)]
    for w in range(1, width):
        few = np.flatnonzero(words == w)
        if len(few):
            h[begin[few]] = window_names(names, w)[at[few]]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][n > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[begin]


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of all bins of each row, empty ones densified; rows without shingles stay zero."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    cell = row * BINS + ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
    head = groups(cell)
    values, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    values[cell[head]], full[cell[head]] = h[head], True
    values, full = values.reshape(n, BINS), full.reshape(n, BINS)
    r, empty = np.nonzero(~full & (np.diff(at) > 0)[:, None])
    source, left = np.argmax(full[r], axis=1) if len(r) else empty, np.arange(len(r))
    for attempt in range(ATTEMPTS):
        if not len(left):
            break
        probe = (mix(empty[left].astype(np.uint64), np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        hit = full[r[left], probe]
        source[left[hit]] = probe[hit]
        left = left[~hit]
    values[r, empty] = values[r, source]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    bands = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for i in range(ROWS):
        key = mix(key, bands[:, :, i])
    return key


def odd_sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in each cell, as longs."""
    n = len(at) - 1
    cell = np.repeat(np.arange(n), np.diff(at)) * (64 * CELLS) + (h % np.uint64(64 * CELLS)).astype(np.int64)
    odd = np.bincount(cell, minlength=n * 64 * CELLS).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd.reshape(n, -1), axis=1, bitorder="little").view(np.int64)


def digests(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each row's set."""
    out = []
    for salt in (np.uint64(11), np.uint64(12)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h, salt))))
        out.append(mix(sums[at[1:]] - sums[at[:-1]], salt).view(np.int64))
    return out[0], out[1]


def _sets(column, width: int):
    """(rows from, to, names, where each row's begin) of a text column, slice by slice."""
    data, offsets = utf8_column(column)
    for first, last in slices(offsets, SLICE):
        for i in range(first, last, MOST):
            j = min(i + MOST, last)
            yield i, j, *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            for i, j, h, at in _sets(batch.column(1), width):
                keys = band_keys(signatures(h, at))
                bands, odd = (pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys.view(np.int64), odd_sketches(h, at)))
                h1, h2 = digests(h, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(h1), pa.array(h2), bands, odd], ["doc_id", "n", "h1", "h2", "bands", "odd"])

    return run


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n (size of the set), h1 and h2 (its digest), bands (keys), odd (sketch)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(width), "doc_id long, n long, h1 long, h2 long, bands array<long>, odd array<long>")


def _wanted(width: int, bitmap):
    """Full sets of the rows whose (digest, id) may be wanted, once per task."""

    def run(batches):
        seen = set()
        for batch in batches:
            ids = int64_column(batch.column(0))
            for i, j, h, at in _sets(batch.column(1), width):
                h1, h2 = digests(h, at)
                k = ids[i:j]
                maybe = in_sieve(bitmap.value, h1.view(np.uint64) ^ (k.view(np.uint64) << np.uint64(39)))
                out = []
                for r in np.flatnonzero(maybe & (np.diff(at) > 0)).tolist():
                    who = (int(k[r]), int(h1[r]), int(h2[r]))
                    if who not in seen:
                        seen.add(who)
                        out.append((*who, h[at[r] : at[r + 1]].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "set" else pa.int64()) for n, c in zip(("k", "h1", "h2", "set"), zip(*out))], ["k", "h1", "h2", "set"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and set of each vertex of wanted (node, k, h1, h2): shingle names of the document that stands for it."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(sieve(wanted, F.col("h1").bitwiseXOR(F.expr("shiftleft(k, 39)"))))
    found = docs.select(id_or_last("doc_id").alias("k"), "text").mapInArrow(_wanted(width, bitmap), "k long, h1 long, h2 long, set binary")
    return wanted.join(found, ["k", "h1", "h2"]).select("node", "set").dropDuplicates(["node"])


def _confirm(share: int, of: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if of * len(x) < share * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = of * both >= share * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, share: int = SHARE, of: int = OF) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(share, of), "a long, b long")


def may_link(share: int, of: int):
    """Whether sets of n and m shingles with odd sketches odd and its_odd may be similar enough."""
    differ = F.expr(" + ".join(f"bit_count(odd[{i}] ^ its_odd[{i}])" for i in range(CELLS)))
    return F.greatest(F.abs(F.col("n") - F.col("m")), differ) * (of + share) <= (F.col("n") + F.col("m")) * (of - share)


def linked(members: DataFrame, sets: DataFrame, share: int = SHARE, of: int = OF) -> DataFrame:
    """(a, root) of every vertex but the smallest of each component.

    members: key, node, n, odd, size (of the bucket), centre (its smallest vertex), written.
    """

    def candidates(one: DataFrame, other: DataFrame, also) -> DataFrame:
        other = other.select("key", F.col("node").alias("its"), F.col("n").alias("m"), F.col("odd").alias("its_odd"), F.col("root").alias("its_root"))
        met = one.join(other, "key").filter(also & may_link(share, of))
        return stage(met.select(F.least("node", "its").alias("a"), F.greatest("node", "its").alias("b")).distinct(), "pairs")

    at = members.withColumn("root", F.col("node"))
    roots = components(confirmed(candidates(at.filter("node <> centre"), at.filter("node = centre"), F.lit(True)), sets, share, of))
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 28)) * F.col("size")
    covered, step = 0, FIRST
    while True:
        # what is left apart from the centre's component, in buckets not yet covered
        at = members.filter(F.col("size") > max(covered, 2)).join(roots.select(F.col("a").alias("node"), "root"), "node", "left")
        at = stage(at.withColumn("root", F.coalesce("root", "node")), "at")
        middle = at.filter("node = centre").select("key", F.col("root").alias("middle"))
        apart = at.join(middle, "key").filter("root <> middle").drop("middle")
        if apart.isEmpty():
            return roots
        part = at.filter("node <> centre").filter((place >= covered << 28) & (place < step << 28))
        pairs = candidates(apart, part, F.col("root") != F.col("its_root"))
        if not pairs.isEmpty():
            roots = components(roots.select("a", F.col("root").alias("b")).unionByName(confirmed(pairs, sets, share, of)))
        covered, step = step, GROWTH * step


def near_duplicates(docs: DataFrame, width: int = SHINGLE, share: int = SHARE, of: int = OF) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    docs = docs.select("doc_id", "text")
    sketch = stage(sketches(docs, width), "sketches")
    keyed = sketch.withColumn("k", id_or_last("doc_id"))
    # one vertex for each different set; the numbers are fixed by the written table
    sets = keyed.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("k").alias("k"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    every = sets.select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre")).filter("size > 1")
    members = stage(every.join(shared, "key"), "members")
    members = stage(members.join(sets.select("node", "n", "odd"), "node"), "members")
    wanted = sets.select("node", "k", "h1", "h2").join(members.select("node").distinct(), "node", "left_semi")
    full = stage(full_sets(docs, wanted, width), "full")
    roots = linked(members, full, share, of)
    rooted = sets.select("node", "n", "h1", "h2", "k").join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("k").alias("component"))
    named = rooted.join(smallest, "root").select("n", "h1", "h2", F.expr(f"nullif(component, {LAST_ID}L)").alias("component_id"))
    out = sketch.select("doc_id", "n", "h1", "h2").join(named.withColumn("found", F.lit(True)), ["n", "h1", "h2"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
