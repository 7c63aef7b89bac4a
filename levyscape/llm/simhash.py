"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 bits have a variant in common that differs
from either in at most 2. Every distinct fingerprint therefore emits all its variants
within 2 bits (2,081 of them), and those that share a variant are linked.

The emission is done in two steps, so that what travels is small. A variant is a
variant of the leading k bits followed by one of the rest. Only the leading part is
shuffled on: 1 + k + k(k-1)/2 rows per fingerprint, each with the number of bits it may
still change. The task that holds a leading part makes the variants of the rest for all
its fingerprints, sorts them and links the ones that collide to the smallest; links are
verified by counting the differing bits. A leading part whose fingerprints would make
more than `MOST` variants is divided by more bits, again and again, so no task holds a
hot group whole. k follows from the number of distinct fingerprints.

Defined cases: a text without words (null, empty, only blanks) has fingerprint zero and
links like any other; repeated rows return the same row; a null doc_id is never the
component's id unless there is no other; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscape.llm.common import LAST_ID, as_row, groups, id_or_last, int64_column, of_row, stage, utf8_column, whole_buckets
from levyscape.llm.components import components, forest

SHINGLE, RADIUS, SEED = 4, 4, 42
# variants that one leading part may make, and bits by which a larger one is divided
MOST, MORE_BITS, LONGEST = 4_000_000, 6, 56
PIECE = 200_000

LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
SPACES = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in LOWER)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64; zero without words."""
    words = text.translate(SPACES).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), PIECE):
        hashes = np.array([h(whole[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            prints = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the 64 bits as a long, for each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def masks(bits: int, most: int) -> np.ndarray:
    """All values of `bits` bits with at most `most` ones."""
    return np.array([sum(1 << i for i in c) for n in range(min(most, bits) + 1) for c in combinations(range(bits), n)], np.uint64)


def ball(bits, most):
    """Number of such values, as a column."""
    bits = bits.cast("double")
    return F.when(most >= 2, 1 + bits + bits * (bits - 1) / 2).when(most == 1, 1 + bits).otherwise(F.lit(1.0))


def _divide(rows: DataFrame, bits: int, half: int) -> DataFrame:
    """Rows (fp, used, length, part) with `bits` more leading bits; used: bits changed so far."""
    variants = [F.lit(int(m)) for m in masks(bits, half)]
    out = rows.select("*", F.explode(F.array(*variants)).alias("mask")).filter(F.col("used") + F.bit_count("mask") <= half)
    leading = F.expr(f"shiftrightunsigned(fp, 64 - {bits} - length)").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.col("mask"))
    return out.select(
        "fp",
        (F.col("used") + F.bit_count("mask")).alias("used"),
        (F.col("length") + bits).cast("int").alias("length"),
        (F.expr(f"shiftleft(part, {bits})") + leading).alias("part"),
    )


def _collide(half: int, radius: int):
    """Rows sorted by part: links between fingerprints that share a variant."""

    def run(batches):
        for table in whole_buckets(batches, 1):
            part, fp = int64_column(table.column("g")), int64_column(table.column("fp")).view(np.uint64)
            used = int64_column(table.column("used"))
            found_a, found_b = [], []
            edges = [*groups(part).tolist(), len(part)]
            for x, y in zip(edges[:-1], edges[1:]):
                if y - x < 2:
                    continue
                rest = 64 - (int(part[x]).bit_length() - 1)
                a, b = _links(fp[x:y], used[x:y], rest, half)
                found_a.append(a)
                found_b.append(b)
            if not found_a:
                continue
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            good = np.bitwise_count(a ^ b) <= radius
            a, b = forest(a[good].view(np.int64), b[good].view(np.int64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _links(fp: np.ndarray, used: np.ndarray, rest: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    low = fp & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for done in range(half + 1):
        who = np.flatnonzero(used == done)
        if len(who):
            m = masks(rest, half - done)
            variants.append((low[who][:, None] ^ m[None, :]).ravel())
            owners.append((who, len(m)))
    every = np.concatenate(variants)
    ordered = np.sort(every)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return fp[:0], fp[:0]
    shift = np.uint64(44)
    maybe = np.zeros(1 << 20, bool)
    maybe[(shared * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
    at = np.flatnonzero(maybe[(every * np.uint64(0x9E3779B97F4A7C15)) >> shift])
    value = every[at]
    slot = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
    hit = shared[slot] == value
    at, slot = at[hit], slot[hit]
    bounds = np.cumsum([0] + [len(w) * n for w, n in owners])
    owner = np.empty(len(at), np.int64)
    for i, (who, n) in enumerate(owners):
        mine = (at >= bounds[i]) & (at < bounds[i + 1])
        owner[mine] = who[(at[mine] - bounds[i]) // n]
    order = np.lexsort((fp[owner], slot))
    slot, owner = slot[order], owner[order]
    head = groups(slot)
    first = np.repeat(owner[head], np.diff(np.concatenate((head, [len(slot)]))))
    other = owner != first
    pairs = np.unique(first[other] * np.int64(len(fp)) + owner[other])
    return fp[pairs // len(fp)], fp[pairs % len(fp)]


def near_links(fps: DataFrame, count: int, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, distinct; count of them) at `radius` or fewer bits, directly or in steps."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius 0, 2 or 4")
    half = radius // 2
    # a leading part makes at most a quarter of `most` on average, so that only hot ones are divided
    bits = 3
    while count * 2081 > (most // 4 << bits) and bits < 24:
        bits += 1
    rows = _divide(fps.select("fp", F.lit(0).alias("used"), F.lit(0).alias("length"), F.lit(1).cast("long").alias("part")), bits, half)
    ready = []
    while True:
        sizes = rows.groupBy("part").agg(F.sum(ball(64 - F.col("length"), half - F.col("used"))).alias("size"), F.max("length").alias("length"))
        hot = stage(sizes.filter((F.col("size") > most) & (F.col("length") < LONGEST)).select("part"), "hot")
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, "part", "left_anti"))
        rows = _divide(rows.join(hot, "part", "left_semi"), MORE_BITS, half)
    every = ready[0].select("part", "fp", "used")
    for more in ready[1:]:
        every = every.unionByName(more.select("part", "fp", "used"))
    dealt = every.withColumnRenamed("part", "g").withColumn("used", F.col("used").cast("long")).repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(_collide(half, radius), "a long, b long")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """fp, root and first (smallest id) of every distinct fingerprint of prints (fp, k); equal roots are one group."""
    first = stage(prints.groupBy("fp").agg(F.min("k").alias("first")), "distinct")
    roots = components(near_links(first.select("fp"), first.count(), radius))
    return stage(first.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stage(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    rooted = _rooted(prints.select("fp", id_or_last("doc_id").alias("k")), radius)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", F.expr(f"nullif(component, {LAST_ID}L)").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Rows of docs, one for each group of near-duplicates: the smallest id, then the smallest hash of the text."""
    keyed = docs.select(as_row(docs), id_or_last("doc_id").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    marked = keyed.select(F.struct("k", "mark").alias("doc_id"), F.col("row.text").alias("text"))
    prints = stage(marked.mapInArrow(_fingerprints(shingle), "doc_id struct<k: bigint, mark: bigint>, fp long").select("doc_id.*", "fp"), "fingerprints")
    rooted = _rooted(prints.select("fp", "k"), radius).select("fp", "root")
    stays = prints.join(rooted, "fp").groupBy("root").agg(F.min(F.struct("k", "mark")).alias("stays")).select("stays.*")
    kept = keyed.join(stays.hint("shuffle_hash"), ["k", "mark"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("k", "mark").orderBy(F.lit(1)))
    return kept.withColumn("nth", nth).filter("nth = 1").select(*of_row(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
