"""Helpers shared by the operators of this folder: staging, Arrow columns, names as 64-bit hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscape.sources.staging import remove_at_end, shared_dir

# Stands for a missing id, so that such rows have a place (the last) in every order.
LAST_ID = 2**63 - 1


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later passes and retries start from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_or_last(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def as_row(df: DataFrame, names: list[str] | None = None) -> Column:
    """The columns of df (or names) as one, `row`, so that no further column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if names is None else names)]).alias("row")


def row_type(df: DataFrame, row: Column) -> str:
    return df.select(row).schema["row"].dataType.simpleString()


def of_row(names: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in names]


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    if data is None or len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def int64_column(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes sum up to about `most`; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair (a, b): equal pairs get equal names everywhere."""
    x = a * _M1
    x ^= x >> np.uint64(29)
    x += b
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def byte_names() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64)
    return mix(mix(x, x), x)


def window_names(units: np.ndarray, width: int) -> np.ndarray:
    """Name of the `width` units from each place on.

    Names of 1, 2, 4, ... units are refined with the name found at the later offset,
    so each doubling reuses the names of the one before.
    """
    names, have, step, power = None, 0, 1, units
    while True:
        if width & step:
            if names is None:
                names = power[: len(units) - step + 1]
            else:
                n = max(0, len(units) - have - step + 1)
                names = mix(names[:n], power[have : have + n])
            have += step
        if have == width:
            return names
        n = max(0, len(power) - step)
        power = mix(power[:n], power[step : step + n])
        step *= 2


_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


class RangeNames:
    """Name of any range of units in constant time, the same wherever the range stands."""

    def __init__(self, units: np.ndarray):
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * _powers(_BASE, len(units)), out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[first]) * _powers(_BACK, len(self.sums))[first]
        return mix(raw, (end - first).astype(np.uint64))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of `width` keys from each place on, by doubling."""
    k = 1
    m = keys
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return m if k == width else np.minimum(m[: len(m) - (width - k)], m[width - k :])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of the rows laid end to end, and each row's first word (one more at the end)."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, end, np.searchsorted(first, offsets)


def space_words() -> np.ndarray:
    """Bytes that belong to a word of [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def groups(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def whole_buckets(batches, size: int) -> Iterator[pa.Table]:
    """Tables of complete buckets, of about `size` rows, from rows sorted by `g`."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = int64_column(batch.column(batch.schema.get_field_index("g")))
        cut = int(groups(g)[-1])
        if rows + cut >= size and not (cut == 0 and last == g[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        rows, last = rows + batch.num_rows, g[-1]
    if held:
        yield pa.Table.from_batches(held)


def name_words(data: np.ndarray, first: np.ndarray, end: np.ndarray, piece: int = 200_000) -> np.ndarray:
    """Name of each word, piece by piece, so that a very long text needs no large arrays of names."""
    names = byte_names()
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(first), piece):
        a, b = first[i : i + piece], end[i : i + piece]
        out.append(RangeNames(names[data[a[0] : b[-1]]]).of(a - a[0], b - a[0]))
    return np.concatenate(out)


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Where a window of `width` units fits into its row."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    return np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans from spans that overlap or touch."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], first[1:] > reach[:-1]))
    return first[new], reach[np.concatenate((np.flatnonzero(new)[1:], [len(first)])) - 1]


def lower_case() -> np.ndarray:
    """Each byte, A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


SIEVE_BITS = 25


def sieve(names: DataFrame, name: Column) -> np.ndarray:
    """Bitmap of the names' leading bits, of 4 MB whatever the number of names.

    A name that is not in it is certainly not among them, so it may hold back rows before
    a shuffle; one that is in it may or may not be, so the shuffle still decides. With
    very many names it fills up and holds back less, at no cost to the result.
    """
    slot = F.shiftrightunsigned(name, 64 - SIEVE_BITS)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    cells = names.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[int64_column(cells.column("cell"))] = int64_column(cells.column("bits")).view(np.uint64)
    return out


def in_sieve(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    slot = names >> np.uint64(64 - SIEVE_BITS)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
