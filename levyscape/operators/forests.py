"""Regression forests whose trees are grown over the cluster.

Columns are coded once into at most 32 bins, and a row is staged as a few bytes. A tree draws
its rows by a hash of (row, tree): how often a row counts is Poisson(1), the same in every pass.

Up to ``REGION`` rows reach every group of trees whole, and a task draws the rows of its trees
itself. Of more rows, while a node has more than ``REGION`` draws, a pass sums one histogram per
(node, tried column) in each task, and the sums of a tree meet in one task, which names the
best cut of each of its nodes. The driver keeps these top nodes alone: about
rows * trees / REGION of them. Then each row goes once to the regions it fell into, and a
region's part of the tree is grown where its rows met, down to the last leaf. The parts stay
in a staged table. No task holds more than ``REGION`` draws and their part of a tree.

Trees follow Spark's own learner: variance as impurity, a fresh choice of ``mtry`` columns at
each node, at least ``least`` draws a leaf, importance as gain times draws, normalised by tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.sources.staging import stage

BINS, LEAST = 32, 5
# draws of a node whose part of the tree is grown in one task
REGION = 1 << 20
# pairs (row, tree) that a task looks at together
CELLS = 1 << 27
# rows that are dealt together, at most
BLOCK = 1 << 16
# rows of a node up to which it is cut beside others, and rows of those together
SMALL, SIDE = 1 << 11, 1 << 15

_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0))
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 20.0)))))

# draws by the first 16 bits of a hash, 255 where these do not tell
_DRAWS = np.searchsorted(_POISSON, np.arange(1 << 16) / 65536, "right").astype(np.uint8)
_DRAWS[_DRAWS != np.searchsorted(_POISSON, np.arange(1, 1 + (1 << 16)) / 65536, "left")] = 255


def _hash(a, b) -> np.ndarray:
    """64 random-looking bits of the pair (a, b)."""
    x = np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64)
    for shift, factor in _MIX:
        x = x ^ (x >> np.uint64(shift))
        if factor:
            x = x * np.uint64(factor)
    return x


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the rows of data between the bounds."""
    data = np.ascontiguousarray(data)
    width = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(data)])


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


@dataclass(frozen=True)
class Code:
    """Cuts of every column; columns of two bins are packed as bits after the wider ones."""

    columns: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]

    @cached_property
    def order(self) -> tuple[list[int], list[int]]:
        wide = [i for i, c in enumerate(self.cuts) if len(c) > 1]
        return wide, [i for i, c in enumerate(self.cuts) if len(c) < 2]

    @cached_property
    def widths(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])

    def pack(self, values: Sequence[np.ndarray]) -> np.ndarray:
        coded = [np.searchsorted(c, v, "left").astype(np.uint8) for c, v in zip(self.cuts, values, strict=True)]
        wide, flags = self.order
        n = len(values[0])
        bits = np.packbits(np.stack([coded[i] for i in flags], 1), axis=1) if flags else np.zeros((n, 0), np.uint8)
        return np.concatenate([*[coded[i][:, None] for i in wide], bits], axis=1)

    @property
    def flags_at(self) -> int:
        """The first byte of the flags in a packed row."""
        return len(self.order[0])

    @property
    def size(self) -> int:
        return self.flags_at + (len(self.order[1]) + 7) // 8

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each column the byte of a packed row, if wide (else -1), and the bit among the flags, if not (else -1)."""
        byte, bit = np.full((2, len(self.cuts)), -1)
        for at, of in zip((byte, bit), self.order, strict=True):
            at[of] = np.arange(len(of))
        return byte, bit

    def column(self, packed: np.ndarray, i: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Codes of one column of packed rows."""
        byte, bit = (int(at[i]) for at in self.places)
        if bit < 0:
            return packed[rows, byte]
        return packed[rows, self.flags_at + bit // 8] >> np.uint8(7 - bit % 8) & np.uint8(1)

    def sums(self, packed: np.ndarray, i: int, w: np.ndarray, pull: np.ndarray, total: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Sums of w and of pull by code; total: both over all rows."""
        v, bins = self.column(packed, i, rows), len(self.cuts[i]) + 1
        if bins > 2:
            return np.stack([np.bincount(v, a, bins) for a in (w, pull)])
        v = v.astype(np.float64)
        right = np.array([w @ v, pull @ v])
        return np.stack((total - right, right), 1)[:, :bins]

    def rows_of(self, column) -> np.ndarray:
        """Packed rows of a binary column, widened to a power of two as these are moved faster."""
        packed = _joined(column, np.uint8).reshape(-1, self.size)
        out = np.zeros((len(packed), 1 << max(0, self.size - 1).bit_length()), np.uint8)
        out[:, : self.size] = packed
        return out

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        wide, flags = self.order
        packed = packed[:, : self.size]
        out = np.zeros((len(packed), len(self.cuts)), np.uint8)
        out[:, wide] = packed[:, : len(wide)]
        if flags:
            out[:, flags] = np.unpackbits(packed[:, len(wide) :], axis=1, count=len(flags))
        return out


def code_of(rows: DataFrame, columns: Sequence[str]) -> Code:
    """Midpoints between the values of a column of at most 32 values, else its 31 quantiles."""

    def seen(batches):
        some = [np.zeros(0)] * len(columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if some[i] is not None:
                    values = np.unique(np.concatenate((some[i], column.to_numpy(zero_copy_only=False))))
                    some[i] = values if len(values) <= BINS else None
        found = [(i, v) for i, values in enumerate(some) for v in ([None] if values is None else values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())], ["i", "v"])

    values = rows.select(*columns).mapInArrow(seen, "i int, v double").distinct()
    few: dict[int, list] = {}
    for r in values.groupBy("i").agg(F.count_if(F.col("v").isNull()).alias("many"), F.count("v").alias("n"), F.slice(F.array_sort(F.collect_list("v")), 1, BINS + 1).alias("v")).collect():
        if not r.many and r.n <= BINS:
            few[r.i] = [(a + b) / 2 for a, b in zip(r.v, r.v[1:])]
    many = [i for i in range(len(columns)) if i not in few]
    if many:
        wanted = F.array(*[F.lit(j / BINS) for j in range(1, BINS)])
        row = rows.agg(*[F.percentile_approx(columns[i], wanted, F.lit(10000)).alias(f"q{i}") for i in many]).first()
        few |= {i: sorted(set(row[f"q{i}"] or [])) for i in many}
    return Code(tuple(columns), tuple(np.array(few[i]) for i in range(len(columns))))


def packed_rows(rows: DataFrame, code: Code, others: Sequence[str], partitions: int) -> DataFrame:
    """Staged rows: id, the other columns, x (the coded columns)."""
    named = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(code.columns)]
    source = rows.select(F.monotonically_increasing_id().alias("id"), *others, *named).repartition(partitions).sortWithinPartitions("id")
    first = 1 + len(others)

    def run(batches):
        for batch in batches:
            x = code.pack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], _binary(x, np.arange(len(x) + 1))], [*batch.schema.names[:first], "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:first])
    return stage(source.mapInArrow(run, f"{kinds}, x binary"))


def _best(n: np.ndarray, s: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Gain (times draws) and place of the best cut of each histogram; n and s: draws and sums by bin, laid end to end."""
    cn, cs = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(s)))
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    ln, ls = cn[1:] - cn[begin[of]], cs[1:] - cs[begin[of]]
    rn, rs = cn[begin[of + 1]] - cn[1:], cs[begin[of + 1]] - cs[1:]
    fits = (ln >= least) & (rn >= least)
    gain = np.full(len(n), -1.0)
    ln, ls, rn, rs = ln[fits], ls[fits], rn[fits], rs[fits]
    gain[fits] = ls * ls / ln + rs * rs / rn - (ls + rs) * (ls + rs) / (ln + rn)
    most = np.maximum.reduceat(gain, begin[:-1])
    at = np.flatnonzero(gain == most[of])
    _, first = np.unique(of[at], return_index=True)
    return most, at[first] - begin[:-1]


def _tried(names: np.ndarray, columns: int, mtry: int) -> np.ndarray:
    """The columns that each node tries."""
    mtry = min(mtry, columns)
    drawn = _hash(names[:, None], np.arange(1, columns + 1)[None, :])
    return np.argpartition(drawn, mtry - 1, axis=1)[:, :mtry]


def _children(names: np.ndarray) -> np.ndarray:
    return np.stack((_hash(names, 1 << 40), _hash(names, 1 << 41)), 1).ravel()


def _plain_subtree(x, y, w, name, mtry, depth, least, widths):
    """A tree over few rows, level by level: column (-1: leaf) and cut of each node, means of the leaves, gains by column.

    The k-th node that is cut has the nodes 2k + 1 and 2k + 2 below it.
    """
    columns = len(widths)
    flat, rows = x.ravel(), np.arange(len(y)) * columns
    names, at = np.array([name], np.uint64), np.zeros(len(y), np.int64)
    nodes, cuts, means, gains = [], [], [], np.zeros(columns)
    while len(names):
        m = len(names)
        n = np.bincount(at, w, m)
        mean = np.bincount(at, w * y, m) / n
        off = y - mean[at]
        pull = w * off
        spread = np.bincount(at, pull * off, m)
        open_ = (n >= 2 * least) & (spread > 1e-28 * n * mean * mean) & (depth > 0)
        best, column, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        if open_.any():
            tried = _tried(names, columns, mtry)
            for f in tried.T:
                begin = np.concatenate(([0], np.cumsum(widths[f])))
                key = begin[at] + flat[rows + f[at]]
                gain, place = _best(np.bincount(key, w, begin[-1]), np.bincount(key, pull, begin[-1]), begin, least)
                more = open_ & (gain > best) & (gain > 1e-12 * spread)
                best[more], column[more], cut[more] = gain[more], f[more], place[more]
        split = column >= 0
        nodes.append(column)
        cuts.append(cut)
        means.append(mean[~split])
        np.add.at(gains, column[split], best[split])
        rank = np.cumsum(split) - 1
        stay = split[at]
        at, rows, y, w = at[stay], rows[stay], y[stay], w[stay]
        at = 2 * rank[at] + (flat[rows + column[at]] > cut[at])
        names, depth = _children(names[split]), depth - 1
    return np.concatenate(nodes).astype(np.int16), np.concatenate(cuts).astype(np.uint8), np.concatenate(means), gains


# Joint codes of g columns of two bins (lines) to the draws on the right side of each.
_RIGHT = {g: (np.arange(1 << g)[:, None] >> np.arange(g) & 1).astype(np.float64) for g in (1, 2, 3, 4)}


def _side_by_side(code, packed, y, w, sizes, names, mtry, depth, least, gains):
    """Trees over some rows each (laid end to end), level by level: column (-1: leaf), cut, mean of each node.

    Roots come first, then the two nodes below each node that is cut, in order. Adds the gains by
    column. Columns of two bins are counted by the joint codes of up to four.
    """
    (byte, bit), columns, widths = code.places, len(code.cuts), code.widths
    flags = np.ascontiguousarray(packed[:, code.flags_at : code.size])
    flat, step = np.unpackbits(flags), 8 * flags.shape[1]
    if not len(flat):  # no column of two bins
        flat, step = np.zeros(len(y), np.uint8), 1
    wide, spot = bit < 0, np.where(bit < 0, 0, bit)
    rows, at = np.arange(len(y)) * step, np.repeat(np.arange(len(names)), sizes)
    n = np.bincount(at, w, len(names))
    mean = np.bincount(at, w * y, len(names)) / n
    nodes, cuts, means = [], [], []
    while len(names):
        m = len(names)
        off = y - mean[at]
        pull = w * off
        spread = np.bincount(at, pull * off, m)
        # rows of nodes with too few draws are not here any more
        open_ = np.flatnonzero((n >= 2 * least) & (spread > 1e-28 * n * mean * mean) & (depth > 0))
        column, cut = np.full(m, -1), np.zeros(m, np.int64)
        nodes.append(column)
        cuts.append(cut)
        means.append(mean)
        if not len(open_):
            break
        tried, bins = np.zeros((2, min(mtry, columns), m), np.int64)
        tried[:, open_] = _tried(names[open_], columns, mtry).T
        bins[:, open_] = widths[tried[:, open_]]
        rn, rs = np.zeros((2, m, len(tried)))
        for low in range(0, len(tried), 4):
            some = tried[low : low + 4]
            g = len(some)
            key = at << g
            for j, f in enumerate(spot[some]):
                key += flat[rows + f[at]] << np.uint8(j)
            for sums, v in ((rn, w), (rs, pull)):
                sums[:, low : low + g] = np.bincount(key, v, m << g).reshape(m, -1) @ _RIGHT[g]
        total = np.bincount(at, pull, m)
        ln, ls = n[:, None] - rn, total[:, None] - rs
        gain = np.full(rn.shape, -1.0)
        fits = np.nonzero((ln >= least) & (rn >= least) & (bins.T == 2))
        a, b = ls[fits], rs[fits]
        gain[fits] = a * a / ln[fits] + b * b / rn[fits] - (a + b) * (a + b) / n[fits[0]]
        place = np.zeros(gain.shape, np.int64)
        # histograms of the columns of more bins, of the nodes that try one
        many = np.flatnonzero((bins > 2).any(0))
        if len(many):
            slot = np.full(m, -1)
            slot[many] = np.arange(len(many))
            on = np.flatnonzero(slot[at] >= 0)
            of, line, wo, po = slot[at[on]], rows[on] // step, w[on], pull[on]
            for j, (f, size) in enumerate(zip(tried[:, many], np.where(bins > 2, bins, 0)[:, many], strict=True)):
                has = np.flatnonzero(size)
                if len(has):
                    begin = np.concatenate(([0], np.cumsum(size)))
                    these = np.flatnonzero(size[of])
                    key = begin[of[these]] + packed[line[these], byte[f[of[these]]]]
                    some = _best(np.bincount(key, wo[these], begin[-1]), np.bincount(key, po[these], begin[-1]), np.append(begin[has], begin[-1]), least)
                    gain[many[has], j], place[many[has], j] = some
        pick = np.argmax(gain, axis=1)
        best = gain[np.arange(m), pick]
        split = open_[best[open_] > np.maximum(0.0, 1e-12 * spread[open_])]
        pick, best = pick[split], best[split]
        f = column[split] = tried[pick, split]
        cut[split] = place[split, pick]
        np.add.at(gains, f, best)
        # draws and means of the nodes below
        rn, rs = rn[split, pick], rs[split, pick]
        below = np.full(m, -1)
        below[split] = 2 * np.arange(len(split))
        to = below[at]
        stay = np.flatnonzero(to >= 0)
        at, rows, y, w, to = at[stay], rows[stay], y[stay], w[stay], to[stay]
        right = flat[rows + spot[column][at]]
        if wide[f].any():
            on = np.flatnonzero(wide[column][at])
            right[on] = packed[rows[on] // step, byte[column[at[on]]]] > cut[at[on]]
            more = np.flatnonzero(wide[f])
            pull = pull[stay][on]
            sums = [np.bincount(at[on], v * right[on], m)[split[more]] for v in (w[on], pull)]
            rn[more], rs[more] = sums
        ln, ls = n[split] - rn, total[split] - rs
        above = mean[split]
        n, mean = np.stack((ln, rn), 1).ravel(), np.stack((above + ls / ln, above + rs / rn), 1).ravel()
        at = to + right
        enough = np.flatnonzero(n[at] >= 2 * least)
        at, rows, y, w = at[enough], rows[enough], y[enough], w[enough]
        names, depth = _children(names[split]), np.repeat(depth[split] - 1, 2)
    return np.concatenate(nodes), np.concatenate(cuts), np.concatenate(means)


def _subtree(code, packed, y, w, name, mtry, depth, least):
    """A tree over packed rows: column (-1: leaf) and cut of each node, means of the leaves, gains by column.

    A node of more than SMALL rows is cut by itself, smaller ones side by side. In the result
    the k-th node that is cut has the nodes 2k + 1 and 2k + 2 below it.
    """
    widths, gains = code.widths, np.zeros(len(code.columns))
    if len(y) <= SMALL:
        return _plain_subtree(code.unpack(packed), y, w, name, mtry, depth, least, widths)
    # one line a node: column, cut, left, right; the means beside them
    lines, means = [[-1, 0, -1, -1]], [0.0]
    found, small, held = [], [], 0
    heap = [(0, name, depth, packed, y, w)]

    def settle():
        nonlocal small, held
        if small:
            slots, names, depths, *parts = zip(*small)
            sizes = [len(p) for p in parts[1]]
            parts = [np.concatenate(p) for p in parts]
            found.append((slots, *_side_by_side(code, *parts, sizes, np.array(names, np.uint64), mtry, np.array(depths), least, gains)))
            small, held = [], 0

    while heap:
        slot, name, depth, x, y, w = heap.pop()
        if len(y) <= SMALL:
            if held + len(y) > SIDE:
                settle()
            small.append((slot, name, depth, x, y, w))
            held += len(y)
            continue
        n = w.sum()
        mean = means[slot] = (w @ y) / n
        off = y - mean
        pull = w * off
        spread = pull @ off
        if not (n >= 2 * least and spread > 1e-28 * n * mean * mean and depth > 0):
            continue
        tried = _tried(np.array([name], np.uint64), len(widths), mtry)[0]
        total = np.array([n, pull.sum()])
        sums = [code.sums(x, f, w, pull, total) for f in tried]
        gain, place = _best(*np.concatenate(sums, axis=1), np.concatenate(([0], np.cumsum(widths[tried]))), least)
        pick = int(np.argmax(gain))
        if not gain[pick] > max(0.0, 1e-12 * spread):
            continue
        f, cut = int(tried[pick]), int(place[pick])
        gains[f] += gain[pick]
        right = code.column(x, f) > cut
        k = len(lines)
        lines[slot] = [f, cut, k, k + 1]
        for child, on in zip(_children(np.array([name], np.uint64)), (~right, right), strict=True):
            on = np.flatnonzero(on)
            heap.append((len(lines), child, depth - 1, x.take(on, 0), y.take(on), w.take(on)))
            lines.append([-1, 0, -1, -1])
            means.append(0.0)
    settle()
    # roots of the parts cut side by side stand for their slots; then all nodes level by level
    column, cut, left, right = ([c] for c in np.array(lines).T)
    mean, at = [np.array(means)], len(lines)
    real = np.arange(at)
    for slots, c, t, v in found:
        real[list(slots)] = at + np.arange(len(slots))
        below = at + len(slots) + 2 * (np.cumsum(c >= 0) - 1)
        for whole, part in zip((column, cut, left, right, mean), (c, t, below, below + 1, v), strict=True):
            whole.append(part)
        at += len(c)
    left[0], right[0] = real[left[0]], real[right[0]]
    column, cut, left, right, mean = map(np.concatenate, (column, cut, left, right, mean))
    level, order = real[:1], []
    while len(level):
        order.append(level)
        level = level[column[level] >= 0]
        level = np.stack((left[level], right[level]), 1).ravel()
    order = np.concatenate(order)
    column, cut, mean = column[order], cut[order], mean[order]
    return column.astype(np.int16), cut.astype(np.uint8), mean[column < 0], gains


def _walk(x: np.ndarray, column: np.ndarray, cut: np.ndarray, means: np.ndarray) -> np.ndarray:
    below, leaf = 2 * np.cumsum(column >= 0) - 1, np.cumsum(column < 0) - 1
    column, flat = column.astype(np.int64), x.ravel()
    out, at, rows, base = np.zeros(len(x)), np.zeros(len(x), np.int64), np.arange(len(x)), np.arange(len(x)) * x.shape[1]
    while len(rows):
        split = column[at]
        ends = np.flatnonzero(split < 0)
        if len(ends):
            out[rows[ends]] = means[leaf[at[ends]]]
            on = np.flatnonzero(split >= 0)
            rows, base, at, split = rows[on], base[on], at[on], split[on]
        at = below[at] + (flat[base + split] > cut[at])
    return out


@dataclass(frozen=True)
class Trees:
    """What the trees of one growth are: random name, columns tried at a node, fold left out (-1: none), model."""

    names: np.ndarray
    mtry: np.ndarray
    held: np.ndarray
    model: np.ndarray
    folds: int
    seed: int

    def fold(self, ids: np.ndarray) -> np.ndarray:
        return (_hash(ids, self.seed + (1 << 42)) % np.uint64(max(1, self.folds))).astype(np.int64)

    def drawn(self, ids: np.ndarray, trees) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each of the trees the rows that it draws, and how often each of all rows counts."""
        base, fold = ids * np.uint64(0x9E3779B97F4A7C15), self.fold(ids)
        x, moved = np.empty_like(base), np.empty_like(base)
        for tree in trees:
            np.add(base, self.names[tree], out=x)
            for shift, factor in _MIX:
                np.right_shift(x, np.uint64(shift), out=moved)
                np.bitwise_xor(x, moved, out=x)
                if factor:
                    np.multiply(x, np.uint64(factor), out=x)
            w = _DRAWS[np.right_shift(x, np.uint64(48), out=moved)]
            unsure = np.flatnonzero(w == 255)
            w[unsure] = np.searchsorted(_POISSON, (x[unsure] >> np.uint64(11)).astype(np.float64) / 2**53, "right")
            if self.held[tree] >= 0:
                w[fold == self.held[tree]] = 0
            yield tree, np.flatnonzero(w), w

    def scored(self, ids: np.ndarray, trees) -> Iterator[tuple[int, np.ndarray]]:
        """Of each of the trees the rows that it predicts: all, or those that it left out."""
        fold, every = self.fold(ids), np.arange(len(ids))
        left = {held: every if held < 0 else np.flatnonzero(fold == held) for held in set(self.held.tolist())}
        for tree in trees:
            yield tree, left[int(self.held[tree])]


@dataclass(frozen=True)
class Top:
    """The upper nodes of all trees, roots first: column (-1: not cut here), cut, left node below (right: the next)."""

    tree: np.ndarray
    name: np.ndarray
    depth: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    draws: np.ndarray
    mean: np.ndarray
    # no cut was found; the node stays a leaf
    leaf: np.ndarray

    def down(self, code: Code, packed: np.ndarray, rows: np.ndarray, tree: int) -> Iterator[tuple[int, np.ndarray]]:
        """The last upper nodes that the rows reach in a tree: node, rows."""
        heap = [(tree, rows)]
        while heap:
            node, rows = heap.pop()
            if not len(rows):
                continue
            if self.column[node] < 0:
                yield node, rows
                continue
            right = code.column(packed, self.column[node], rows) > self.cut[node]
            below = int(self.below[node])
            heap += [(below + 1, rows[np.flatnonzero(right)]), (below, rows[np.flatnonzero(~right)])]


def _blocks(batches, code: Code, trees: Trees):
    """Rows by the block: ids, y, packed columns."""
    most = min(BLOCK, max(1, CELLS // len(trees.names)))
    held, n = [], 0

    def block():
        t = pa.Table.from_batches(held)
        return t.column(0).to_numpy().astype(np.uint64), t.column(1).to_numpy(), code.rows_of(t.column(2))

    for batch in batches:
        i = 0
        while i < batch.num_rows:
            held.append(batch.slice(i, most - n))
            i, n = i + held[-1].num_rows, n + held[-1].num_rows
            if n == most:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _parcels(lines, schema: str):
    """Lines as record batches of about 16 MB."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*[(n, kinds[k]) for n, k in (part.split() for part in schema.split(", "))], strict=True)
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))

    for line in lines:
        held.append(line)
        size += sum(len(v) for v in line if isinstance(v, bytes))
        if size > 1 << 24:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _to_groups(rows: DataFrame, code: Code, trees: Trees, groups: int) -> DataFrame:
    """All rows, by the block, for each group of trees: grp, first, ids, y, x. Each group has a partition."""
    schema = "first long, ids binary, y binary, x binary"

    def block(batches):
        yield from _parcels(((int(ids[0]), ids.tobytes(), y.tobytes(), packed[:, : code.size].tobytes()) for ids, y, packed in _blocks(batches, code, trees)), schema)

    every = F.sequence(F.lit(0), F.lit(groups - 1))
    return rows.mapInArrow(block, schema).select(F.explode(every).alias("grp"), "first", "ids", "y", "x").repartitionById(groups, "grp")


def _groups(spark, trees: Trees) -> int:
    return min(len(trees.names), 4 * spark.sparkContext.defaultParallelism)


class Forest:
    """Forests grown side by side; nodes: staged parts of trees (grp: the upper node they hang from)."""

    def __init__(self, code: Code, trees: Trees, top: Top, nodes: DataFrame, gains: np.ndarray):
        self.code, self.trees, self.top, self.nodes, self.top_gains = code, trees, top, nodes, gains

    def importances(self) -> list[float]:
        """Gain times draws by column, normalised for each tree, then over all."""
        k, total = len(self.code.columns), self.top_gains.copy()
        parts = self.nodes.select("tree", "gains").groupBy("tree").applyInArrow(
            lambda t: pa.table({"tree": t["tree"][:1], "gains": [_joined(t["gains"], np.float64).reshape(-1, k).sum(0).tolist()]}),
            "tree int, gains array<double>",
        )
        for r in parts.toLocalIterator():
            total[r.tree] += r.gains
        sums = total.sum(1, keepdims=True)
        shares = (total / np.where(sums > 0, sums, 1)).sum(0)
        return (shares / (shares.sum() or 1.0)).tolist()

    def predict(self, rows: DataFrame) -> DataFrame:
        """model, id, prediction of packed rows (id, x)."""
        code, trees = self.code, self.trees
        spark, count = rows.sparkSession, len(trees.names)
        top = spark.sparkContext.broadcast(self.top)
        rows = rows.select("id", F.lit(0.0).alias("y"), "x")
        nodes = self.nodes.select("grp", "tree", "col", "cut", "mean")
        schema = "model int, part long, n int, ids binary, v binary"
        kinds = pa.schema([("model", pa.int32()), ("part", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())])

        def values(part, line, x):
            """What the rows get from a staged part of a tree."""
            return _walk(x, *[np.frombuffer(part[c][line].as_py(), d) for c, d in (("col", np.int16), ("cut", np.uint8), ("mean", np.float64))])

        def meet_all(key, left: pa.Table, right: pa.Table) -> pa.Table:
            """All rows meet the trees of a group; a model's values are summed."""
            left = left.sort_by("first")
            ids, x = _joined(left["ids"], np.uint64), code.unpack(code.rows_of(left["x"]))
            grp, line = key[0].as_py(), {t: i for i, t in enumerate(right["tree"].to_pylist())}
            mine = range(-(-grp * count // groups), -(-(grp + 1) * count // groups))
            found: dict[int, list] = {}
            for tree, these in trees.scored(ids, mine):
                mean = top.value.mean[tree]
                for part in range(0, len(these), BLOCK):
                    some = these[part : part + BLOCK]
                    out = found.setdefault((int(trees.model[tree]), part), [0, some, np.zeros(len(some))])
                    out[0] += 1
                    for i in range(0, len(some), SIDE):
                        out[2][i : i + SIDE] += values(right, line[tree], x[some[i : i + SIDE]]) if tree in line else mean
            return pa.Table.from_pylist([{"model": m, "part": p, "n": n, "ids": ids[some].tobytes(), "v": v.tobytes()} for (m, p), (n, some, v) in found.items()], schema=kinds)

        def deal(batches):
            upper = top.value

            def lines():
                for ids, _, packed in _blocks(batches, code, trees):
                    for tree, these in trees.scored(ids, range(count)):
                        for node, some in upper.down(code, packed, these, tree):
                            yield int(node), int(trees.model[tree]), int(ids[0]), ids[some].tobytes(), packed[some, : code.size].tobytes()

            yield from _parcels(lines(), "grp int, model int, part long, ids binary, x binary")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for r in left.to_pylist():
                n = len(r["ids"]) // 8
                if right.num_rows:
                    v = values(right, 0, code.unpack(np.frombuffer(r["x"], np.uint8).reshape(n, code.size)))
                else:  # a leaf among the upper nodes, or a tree that drew no row
                    v = np.full(n, top.value.mean[r["grp"]])
                out.append({"model": r["model"], "part": r["part"], "n": 1, "ids": r["ids"], "v": v.tobytes()})
            return pa.Table.from_pylist(out, schema=kinds)

        def mean(t: pa.Table) -> pa.Table:
            ids, of = np.unique(_joined(t["ids"], np.int64), return_inverse=True)
            n = np.repeat(t["n"].to_numpy(), [len(b) // 8 for b in t["ids"].to_pylist()])
            v = np.bincount(of, _joined(t["v"], np.float64), len(ids)) / np.bincount(of, n, len(ids))
            return pa.table({"model": pa.array(np.full(len(ids), t["model"][0].as_py()), pa.int32()), "id": ids, "prediction": v})

        # rows that a task can hold meet a group of whole trees
        if len(self.top.tree) == count and rows.count() <= REGION:
            groups = _groups(spark, trees)
            dealt = _to_groups(rows, code, trees, groups)
            held = nodes.withColumn("grp", F.expr(f"cast(cast(tree as long) * {groups} div {count} as int)")).repartitionById(groups, "grp")
            met = dealt.groupBy("grp").cogroup(held.groupBy("grp")).applyInArrow(meet_all, schema)
        else:
            dealt = rows.mapInArrow(deal, "grp int, model int, part long, ids binary, x binary")
            spread = _partitions(spark)
            met = dealt.repartition(spread, "grp").groupBy("grp").cogroup(nodes.repartition(spread, "grp").groupBy("grp")).applyInArrow(meet, schema)
        return met.repartition(_partitions(spark), "model", "part").groupBy("model", "part").applyInArrow(mean, "model int, id long, prediction double")


def grow(rows: DataFrame, code: Code, trees: Trees, depth: int, least: int = LEAST) -> Forest:
    """Trees over packed rows (id, y, x)."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    rows = rows.select("id", "y", "x")
    bad = F.col("y").isNull() | F.isnan("y")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread")).first()
    if not told.n or told.bad:
        raise ValueError(f"a forest needs rows whose outcome is known: {told.n} rows, {told.bad} without outcome")
    count, k, widths = len(trees.names), len(code.columns), code.widths
    # gain for each draw below which a node is held to be pure
    pure = 1e-14 * told.spread if told.spread > 1e-28 * told.mean**2 else np.inf
    every = np.arange(count)
    top = Top(every, trees.names.copy(), np.zeros(count, np.int64), np.full(count, -1), np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, float(told.n)), np.full(count, told.mean), np.zeros(count, bool))
    gains = np.zeros((count, k))
    while True:
        active = np.flatnonzero((top.column < 0) & ~top.leaf & (top.draws > REGION) & (top.depth < depth))
        active = active[np.argsort(top.tree[active], kind="stable")]
        if not len(active):
            break
        found = _level(rows, code, trees, top, active, told.mean, least)
        top, done = _cut(top, found, pure)
        np.add.at(gains, (top.tree[done], top.column[done]), found["gain"][found["gain"] > pure * found["n"]])
    shared = sc.broadcast(top)
    schema = "grp int, tree int, col binary, cut binary, mean binary, gains binary"
    kinds = pa.schema([("grp", pa.int32()), ("tree", pa.int32()), *[(c, pa.binary()) for c in ("col", "cut", "mean", "gains")]])

    def grown(node, tree, *rows):
        parts = _subtree(code, *rows, shared.value.name[node], int(trees.mtry[tree]), depth - int(shared.value.depth[node]), least)
        return dict(zip(kinds.names, (node, tree, *[p.tobytes() for p in parts]), strict=True))

    def whole(t: pa.Table) -> pa.Table:
        """The trees of a group, from all rows."""
        t = t.sort_by("first")
        ids, y, packed = _joined(t["ids"], np.uint64), _joined(t["y"], np.float64), code.rows_of(t["x"])
        bounds = np.cumsum([len(b) // 8 for b in t["ids"].to_pylist()])[:-1]
        out = []
        for tree, rows, w in trees.drawn(ids, range(t["grp"][0].as_py(), count, groups)):
            # blocks by their first drawn row, as parts of larger tables are
            parts = sorted((p for p in np.split(rows, np.searchsorted(rows, bounds)) if len(p)), key=lambda p: ids[p[0]])
            if parts:
                rows = np.concatenate(parts)
                out.append(grown(tree, tree, packed.take(rows, 0), y[rows], w[rows].astype(np.float64)))
        return pa.Table.from_pylist(out, schema=kinds)

    def deal(batches):
        upper = shared.value

        def lines():
            for ids, y, packed in _blocks(batches, code, trees):
                for tree, rows, w in trees.drawn(ids, range(count)):
                    for node, some in upper.down(code, packed, rows, tree):
                        if not upper.leaf[node]:
                            yield int(node), tree, int(ids[some[0]]), packed[some, : code.size].tobytes(), y[some].tobytes(), w[some].tobytes()

        yield from _parcels(lines(), "grp int, tree int, first long, x binary, y binary, w binary")

    def part(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")
        rows = code.rows_of(t["x"]), _joined(t["y"], np.float64), _joined(t["w"], np.uint8).astype(np.float64)
        return pa.Table.from_pylist([grown(t["grp"][0].as_py(), t["tree"][0].as_py(), *rows)], schema=kinds)

    if told.n <= REGION:
        # a task can hold all rows: it draws them itself
        groups = _groups(spark, trees)
        made = _to_groups(rows, code, trees, groups).groupBy("grp").applyInArrow(whole, schema)
    else:
        dealt = rows.mapInArrow(deal, "grp int, tree int, first long, x binary, y binary, w binary")
        # the work of a region is in its Python, not in its bytes, by which Spark would merge partitions
        made = dealt.repartition(_partitions(spark), "grp").groupBy("grp").applyInArrow(part, schema)
    return Forest(code, trees, top, stage(made), gains)


def _partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _level(rows: DataFrame, code: Code, trees: Trees, top: Top, active: np.ndarray, middle: float, least: int) -> dict[str, np.ndarray]:
    """The best cut of each active upper node (in order of trees): node, column, cut, gain, n, mean and those of the left part."""
    widths, columns = code.widths, len(code.columns)
    ends = np.flatnonzero(np.append(top.tree[active][1:] != top.tree[active][:-1], True)) + 1
    starts = np.concatenate(([0], ends[:-1]))
    shared = rows.sparkSession.sparkContext.broadcast((top, active))

    def layout():
        upper, nodes = shared.value
        most = int(min(columns, trees.mtry.max()))
        tried = np.zeros((len(nodes), most), np.int64)
        counts = np.minimum(columns, trees.mtry[upper.tree[nodes]])
        for m in np.unique(counts):
            tried[counts == m, :m] = _tried(upper.name[nodes[counts == m]], columns, int(m))
        size = np.where(np.arange(most)[None, :] < counts[:, None], widths[tried], 0)
        begin = np.concatenate(([0], np.cumsum(size.ravel())))
        return upper, nodes, tried, counts, begin, most

    def sums(batches):
        upper, nodes, tried, counts, begin, most = layout()
        slot = np.full(len(upper.tree), -1)
        slot[nodes] = np.arange(len(nodes))
        n, s, first = np.zeros(begin[-1]), np.zeros(begin[-1]), -1
        for ids, y, packed in _blocks(batches, code, trees):
            first = int(ids[0]) if first < 0 else first
            for tree, rows, draws in trees.drawn(ids, np.unique(upper.tree[nodes])):
                for node, some in upper.down(code, packed, rows, tree):
                    k = slot[node]
                    if k < 0:
                        continue
                    w = draws[some].astype(np.float64)
                    pull = w * (y[some] - middle)
                    total = np.array([w.sum(), pull.sum()])
                    for j in range(counts[k]):
                        at = slice(begin[k * most + j], begin[k * most + j] + widths[tried[k, j]])
                        one, other = code.sums(packed, tried[k, j], w, pull, total, some)
                        n[at] += one
                        s[at] += other
        if first >= 0:
            bounds = np.concatenate((begin[starts * most], begin[-1:]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts)), pa.int32()), pa.array([first] * len(starts), pa.int64()), _binary(n, bounds), _binary(s, bounds)], ["nth", "first", "n", "s"])

    def best(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")
        upper, nodes, tried, counts, begin, most = layout()
        i, j = starts[t["nth"][0].as_py()], ends[t["nth"][0].as_py()]
        n, s = (_joined(t[c], np.float64).reshape(t.num_rows, -1).sum(0) for c in ("n", "s"))
        m = int(counts[i])
        inner = (np.arange(i, j)[:, None] * most + np.arange(m)[None, :]).ravel()
        local = np.append(begin[inner] - begin[i * most], len(n))
        gain, cut = (a.reshape(-1, m) for a in _best(n, s, local, least))
        pick = np.argmax(gain, axis=1)
        line = np.arange(j - i)
        lo, hi = local[line * m + pick], local[line * m + pick + 1]
        cn, cs = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(s)))
        cut = cut[line, pick]
        return pa.table({
            "node": nodes[i:j], "col": tried[i:j][line, pick], "cut": cut.astype(np.int64), "gain": gain[line, pick],
            "n": cn[hi] - cn[lo], "s": cs[hi] - cs[lo], "ln": cn[lo + cut + 1] - cn[lo], "ls": cs[lo + cut + 1] - cs[lo],
        })

    told = rows.mapInArrow(sums, "nth int, first long, n binary, s binary").groupBy("nth").applyInArrow(best, "node long, col long, cut long, gain double, n double, s double, ln double, ls double")
    lines = sorted(tuple(r) for r in told.collect())
    node, col, cut, gain, n, s, ln, ls = map(np.array, zip(*lines, strict=True))
    rn, rs = n - ln, s - ls
    mean = middle + np.stack((s / n, ls / np.maximum(ln, 1), rs / np.maximum(rn, 1)))
    return {"node": node, "col": col, "cut": cut, "gain": gain, "n": n, "ln": ln, "rn": rn, "mean": mean}


def _cut(top: Top, found: dict[str, np.ndarray], pure: float) -> tuple[Top, np.ndarray]:
    """The upper nodes after these cuts, and the nodes that were cut."""
    good = found["gain"] > pure * found["n"]
    node, m = found["node"], len(top.tree)
    done = node[good]
    column, cut, below, leaf, draws, mean = (a.copy() for a in (top.column, top.cut, top.below, top.leaf, top.draws, top.mean))
    draws[node], mean[node] = found["n"], found["mean"][0]
    leaf[node[~good]] = True
    column[done], cut[done] = found["col"][good], found["cut"][good]
    below[done] = m + 2 * np.arange(len(done))
    pairs = lambda a, b: np.stack((a, b), 1).ravel()
    new = 2 * len(done)
    return replace(
        top,
        tree=np.concatenate((top.tree, np.repeat(top.tree[done], 2))),
        name=np.concatenate((top.name, _children(top.name[done]))),
        depth=np.concatenate((top.depth, np.repeat(top.depth[done] + 1, 2))),
        column=np.concatenate((column, np.full(new, -1))),
        cut=np.concatenate((cut, np.zeros(new, np.int64))),
        below=np.concatenate((below, np.zeros(new, np.int64))),
        draws=np.concatenate((draws, pairs(found["ln"][good], found["rn"][good]))),
        mean=np.concatenate((mean, pairs(found["mean"][1][good], found["mean"][2][good]))),
        leaf=np.concatenate((leaf, np.zeros(new, bool))),
    ), done


def plan(models: Sequence[tuple[int, int]], each: int, folds: int, seed: int) -> Trees:
    """``each`` trees for every model (mtry, fold left out)."""
    n = len(models) * each
    names = _hash(np.arange(1, n + 1), np.full(n, seed, np.int64))
    mtry, held = (np.repeat([m[i] for m in models], each) for i in (0, 1))
    return Trees(names, mtry, held, np.repeat(np.arange(len(models)), each), folds, seed)
