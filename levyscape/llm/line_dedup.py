"""Line dedup by pairwise alignment.

A line is known by the hash of its text without blanks at the ends. What can show that
documents overlap are runs of neighbouring lines that just reach `MIN_CHARS` characters
(a long line by itself, short ones together): the shortest from each line on, the
shortest up to each line, and two of the first kind in succession. Each later holder of
such a run, however many there are, becomes a partner of the earliest one. Every such
pair is aligned by patience diff over all its lines (common head and tail, then the
longest increasing chain of lines that occur once in both, then the gaps between them),
and common blocks (aligned neighbours with at least `MIN_CHARS` characters) are deleted
from the later document; what is left of it is aligned again until nothing more goes, so
that blocks in another order go as well. Pairs grow with the lines (three runs a line,
each with one earliest holder), never with the square of a group.

Every line of a block that an earlier document holds as well lies in a run of that block,
so the later document has a partner that holds the line with its neighbours, whoever else
holds the line alone. It stays only where each such partner repeats the line, so that
patience diff has nothing unique to go by.

Documents are ordered by id, null last, then by a hash of the text. Rows that repeat
both are one document and return the same. Defined cases: a null text has no lines and
stays null; an empty one is a single empty line; blank and short lines go only inside a
block; a document may lose all lines; an empty table gives an empty result; further
columns are kept or ignored as each function says.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.llm.common import as_row, id_or_last, of_row, row_type, stage

MIN_CHARS = 20
# holders of a run for which one copy of its earliest document is made
DEALT = 1_000
# names of runs are values of a polynomial in the lines' names; equal names only suggest an alignment
MODULUS, BASE = (1 << 61) - 1, 0x1D2C_6B3F_5A97_E401


def line_names(text: str) -> tuple[list[int], bytes]:
    """Signed 64-bit names of the lines, and their lengths up to 255 as bytes."""
    lines = [line.strip() for line in text.split("\n")]
    names = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    return [h - (1 << 64) if h >> 63 else h for h in names], bytes(min(len(line), 255) for line in lines)


def run_places(sizes: bytes, least: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of lines that can show an overlap."""
    ends, end, total = [], 0, 0
    for size in sizes:
        while end < len(sizes) and total < least:
            total += sizes[end]
            end += 1
        if total < least:
            break
        ends.append(end)
        total -= size
    out = list(enumerate(ends))
    out += [(i, ends[end]) for i, end in enumerate(ends) if end < len(ends)]
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        while total - sizes[first] >= least:
            total -= sizes[first]
            first += 1
        if total >= least:
            out.append((first, i + 1))
    return out


def run_names(names: list[int], sizes: bytes, least: int) -> set[int]:
    """Names of a document's runs."""
    before, power = [0], [1]
    for x in names:
        before.append((before[-1] * BASE + x) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    return {(before[end] - before[first] * power[end - first]) % MODULUS for first, end in run_places(sizes, least)}


def _sequences(least: int):
    def run(batches):
        for batch in batches:
            pairs = [line_names(t) for t in batch.column(2).to_pylist()]
            names, sizes = [p[0] for p in pairs], [p[1] for p in pairs]
            runs = [sorted(run_names(x, y, least)) for x, y in pairs]
            new = [pa.array(names, pa.list_(pa.int64())), pa.array(sizes, pa.binary()), pa.array(runs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["k", "tag", "lines", "sizes", "runs"])

    return run


def _chain(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest increasing chain of the lines that occur once in both parts."""
    once_a, once_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    where = {x: j for j, x in enumerate(b[blo:bhi], blo) if once_b[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(a[alo:ahi], alo) if once_a[x] == 1 and x in where]
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(piles[p - 1] if p else -1)
        tops[p : p + 1], piles[p : p + 1] = [j], [n]
    chain, n = [], piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines, increasing in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        chain = _chain(a, b, alo, ahi, blo, bhi)
        if chain:
            found += chain
            edges = [(alo - 1, blo - 1), *chain, (ahi, bhi)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(found)


def common_blocks(earlier: list[int], later: list[int], sizes: bytes, least: int) -> list[int]:
    """Places in later of the aligned blocks of at least `least` characters.

    What an alignment leaves is aligned anew until nothing more is found: blocks that the
    documents hold in different orders, and lines that the later one repeats.
    """
    out: list[int] = []
    left = list(range(len(later)))
    while left:
        found: list[int] = []
        block: list[int] = []
        last = (-2, -2)
        for i, at in [*patience(earlier, [later[j] for j in left]), (-9, -9)]:
            j = left[at] if at >= 0 else at
            if (i, j) != (last[0] + 1, last[1] + 1):
                if sum(sizes[x] for x in block) >= least:
                    found += block
                block = []
            block.append(j)
            last = (i, j)
        if not found:
            break
        out += found
        gone = set(found)
        left = [j for j in left if j not in gone]
        if not any(sizes[j] for j in left):
            break
    return out


def _align(least: int):
    def run(batches):
        for batch in batches:
            gone = [common_blocks(e, x, n, least) for e, x, n in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["k", "tag", "gone"])

    return run


def _kept(text_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(text_at + 1).to_pylist()):
                if text is None:
                    texts.append(None), totals.append(0), removed.append(0)
                    continue
                lines = text.split("\n")
                out = {i for places in gone or () for i in places}
                totals.append(len(lines)), removed.append(len(out))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
            new = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(text_at)), *new], names)

    return run


def common_lines_gone(docs: DataFrame, keep: list[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """row (columns `keep` of docs), n_lines, n_removed and kept, the text of the lines that stay; docs has doc_id and text.

    `min_chars`, from 1 to 255, is the length of a run and the least length of a block.
    """
    row = as_row(docs, keep)
    keyed = docs.select(row, id_or_last("doc_id").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    named = keyed.filter("text is not null").select("k", "tag", "text")
    named = named.mapInArrow(_sequences(min_chars), "k long, tag long, lines array<long>, sizes binary, runs array<long>")
    sequences = stage(named, "lines")
    runs = sequences.select("k", "tag", F.explode("runs").alias("h"))
    holders = runs.groupBy("h").agg(F.min(F.struct("k", "tag")).alias("first"), F.max(F.struct("k", "tag")).alias("last"), F.count("*").alias("n"))
    held = runs.join(holders.filter("first <> last"), "h").filter("struct(k, tag) <> first")
    pairs = held.groupBy("k", "tag", F.col("first.k").alias("first_k"), F.col("first.tag").alias("first_tag")).agg(F.max("n").alias("n"))
    # the later holders of a common run are dealt over copies of the earliest, so that no task reads all of them
    pairs = pairs.select("k", "tag", "first_k", "first_tag", F.pmod(F.xxhash64("k", "tag"), F.ceil(F.col("n") / DEALT)).alias("copy"))
    pairs = stage(pairs, "pairs")
    one_each = sequences.groupBy("k", "tag").agg(F.first(F.struct("lines", "sizes")).alias("it")).select("k", "tag", "it.lines", "it.sizes")
    earlier = one_each.select(F.col("k").alias("first_k"), F.col("tag").alias("first_tag"), F.col("lines").alias("earlier"))
    copies = pairs.select("first_k", "first_tag", "copy").distinct().join(earlier, ["first_k", "first_tag"])
    both = pairs.join(one_each, ["k", "tag"]).join(copies, ["first_k", "first_tag", "copy"])
    aligned = both.select("k", "tag", "earlier", "lines", "sizes").mapInArrow(_align(min_chars), "k long, tag long, gone array<int>")
    gone = aligned.groupBy("k", "tag").agg(F.collect_list("gone").alias("gone"))
    done = keyed.join(gone.hint("shuffle_hash"), ["k", "tag"], "left").select("row", "text", "gone")
    names = ["row", "n_lines", "n_removed", "kept"]
    return done.mapInArrow(_kept(1, names), f"row {row_type(docs, row)}, n_lines long, n_removed long, kept string")


def without_common_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay, n_chars to match; documents that lose every line go."""
    others = [c for c in docs.columns if c != "text"]
    out = common_lines_gone(docs, others).filter("n_lines = 0 or n_removed < n_lines")
    new = dict(zip(others, of_row(others))) | {"text": F.col("kept").alias("text")}
    if "n_chars" in others:
        n = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = common_lines_gone(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
