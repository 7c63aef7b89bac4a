"""Windows of a fixed number of units (bytes or words) that occur earlier in the corpus.

Both substring operators ask, for every window of a document, whether the same
window starts earlier. They differ in how a window finds its *anchor*, a place
inside it that depends on the window's units alone, and share the rest:

1. Each run of windows with one anchor is one row: `g`, the name of what stands at
   the anchor, and `c`, the name of all units the run covers (its context).
   Windows can only be equal if their `g` are, so a `g` that occurs once is done.
2. Rows whose context the same task has seen earlier are settled at once. The others
   take one shuffle by `g`. Rows whose context occurs earlier are settled as a whole.
   Only the first row of each context, in a bucket of several contexts, is open.
3. Open rows fetch their context from the text and meet again by `g`; there the
   names of all their windows are compared. In a bucket of more than `HOT`
   contexts the windows are dealt out by their own names instead.
4. The spans found go back to the documents.

Names are 64-bit hashes; equal windows are confirmed with a second, independent one.
A document is the pair (id, 64-bit hash of its text), `k` and `tag`: rows that repeat an
id with the same text count as one document, and each returns its result. A missing id
comes last. No row, window or partner is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.llm.common import (
    RangeNames,
    byte_names,
    id_or_last,
    int64_column,
    merged,
    mix,
    name_words,
    slices,
    space_words,
    stage,
    utf8_column,
    whole_buckets,
    window_names,
    window_starts,
    word_spans,
)

# Bytes worked on at once; contexts of a bucket beyond which its windows are dealt out singly.
SLICE = 1 << 20
HOT = 20_000
# Rows of a task that are looked at together before they travel.
TOGETHER = 400_000

# loc: the first window's start, 7 bits of the anchor's offset, 7 of the windows after the first
_LO, _DA = 14, 7

# every word separator as a space
SPACES = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in range(256))

Anchors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Repeats:
    """What a unit is, how many make a window, and how windows find their anchors.

    anchors(units, starts) returns each window's anchor, an id of it and its name.
    """

    unit: str
    width: int
    anchors: Anchors
    within_document: bool


def pieces(data: np.ndarray, offsets: np.ndarray, unit: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Units in pieces of bounded size: first row, units, offsets of the rows in them. A row longer than a piece comes alone."""
    for first, last in slices(offsets, SLICE):
        part, offs = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        yield first, *((part, offs) if unit == "byte" else word_units(part, offs))


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, end, rows = word_spans(data, offsets, space_words())
    return name_words(data, first, end), rows


def _anchor_rows(spec: Repeats):
    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for rows in _found_anchors(spec, batches):
            held.append(rows)
            if sum(len(x[0]) for x in held) >= TOGETHER:
                yield _settled_here(spec, held)
                held = []
        if held:
            yield _settled_here(spec, held)

    return run


def _settled_here(spec: Repeats, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of one task: those whose context the task has seen earlier are settled and no longer travel by `g`."""
    g, c, k, tag, loc = (np.concatenate(x) for x in zip(*held))
    key = mix(g.view(np.uint64), c.view(np.uint64))
    order = np.lexsort((loc, tag, k, key))
    g, c, k, tag, loc, key = g[order], c[order], k[order], tag[order], loc[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = _earlier(spec, head, k, tag, loc) & (g == g[head]) & (c == c[head])
    spread = mix(mix(k.view(np.uint64), tag.view(np.uint64)), loc.view(np.uint64)).view(np.int64)
    columns = (np.where(done, spread, g), np.where(done, 0, c), k, tag, loc, done)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "c", "k", "tag", "loc", "done"])


def _earlier(spec: Repeats, head: np.ndarray, k: np.ndarray, tag: np.ndarray, loc: np.ndarray) -> np.ndarray:
    """Whether the row at head, the first of the same windows, makes each row a repeat."""
    other = (k != k[head]) | (tag != tag[head])
    return other | (loc != loc[head]) if spec.within_document else other


def _found_anchors(spec: Repeats, batches) -> Iterator[tuple[np.ndarray, ...]]:
    names = byte_names()
    for batch in batches:
        data, offsets = utf8_column(batch.column(2))
        ids, tags = int64_column(batch.column(0)), int64_column(batch.column(1))
        for first, units, offs in pieces(data, offsets, spec.unit):
            alone = len(offs) == 2
            # windows start in [begin, begin + SLICE) of a row that stands alone, and may reach beyond
            for begin in range(0, max(1, int(offs[-1])), SLICE) if alone else (0,):
                some = units[begin : begin + SLICE + spec.width - 1] if alone else units
                if spec.unit == "byte":
                    some = names[some]
                part = np.array([0, len(some)]) if alone else offs
                s = window_starts(part, spec.width)
                if not len(s):
                    continue
                place, anchor, g = spec.anchors(some, s)
                cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1))))
                lo, hi = s[cut], s[np.concatenate((cut[1:], [len(s)])) - 1]
                row = np.searchsorted(part, lo, "right") - 1
                da, dw = place[cut] - lo, hi - lo
                c = mix(RangeNames(some).of(lo, hi + spec.width), (da * 128 + dw).astype(np.uint64))
                loc = ((lo - part[row] + begin) << _LO) | (da << _DA) | dw
                yield g[cut].view(np.int64), c.view(np.int64), ids[row + first], tags[row + first], loc


def _sort_out(spec: Repeats):
    """Rows sorted by g, c, k, tag, loc: which are covered, which are open, which drop out."""

    def run(batches):
        for table in whole_buckets(batches, 100_000):
            done = table.column("done").to_numpy()
            g, c, k, tag, loc = (int64_column(table.column(x)) for x in ("g", "c", "k", "tag", "loc"))
            settled = (k[done], tag[done], loc[done], g[done], np.zeros(done.sum(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled], ["k", "tag", "loc", "g", "kind"])
            g, c, k, tag, loc = g[~done], c[~done], k[~done], tag[~done], loc[~done]
            if not len(g):
                continue
            new_g = np.concatenate(([True], g[1:] != g[:-1]))
            new_c = new_g | np.concatenate(([True], c[1:] != c[:-1]))
            bucket, context = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
            covered = _earlier(spec, np.flatnonzero(new_c)[context], k, tag, loc)
            contexts = np.bincount(bucket, weights=new_c).astype(np.int64)[bucket]
            kind = np.where(covered, 0, np.where(contexts > HOT, 2, 1))
            keep = covered | (contexts > 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, tag, loc, g, kind)], ["k", "tag", "loc", "g", "kind"])

    return run


def _contexts(spec: Repeats):
    def run(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(batch.schema.get_field_index("text")))
            ids = int64_column(batch.column(batch.schema.get_field_index("k")))
            tags = int64_column(batch.column(batch.schema.get_field_index("tag")))
            lists = batch.column(batch.schema.get_field_index("open"))
            flat = lists.flatten()
            per_row = np.diff(lists.offsets.to_numpy())
            loc, g, kind = (int64_column(flat.field(x)) for x in ("loc", "g", "kind"))
            ends = np.cumsum(per_row)
            for row, (a, b) in enumerate(zip(ends - per_row, ends)):
                text = data[offsets[row] : offsets[row + 1]]
                lo = loc[a:b] >> _LO
                hi = lo + (loc[a:b] & 127) + spec.width
                if spec.unit == "byte":
                    first, end = lo, hi
                else:
                    word_first, word_end, _ = word_spans(text, np.array([0, len(text)]), space_words())
                    first, end = word_first[lo], word_end[hi - 1]
                raw = text.tobytes()
                context = [raw[x:y] for x, y in zip(first.tolist(), end.tolist())]
                out_g, out_loc, out_kind, out_context = g[a:b], loc[a:b], kind[a:b], context
                if (kind[a:b] == 2).any():  # windows dealt out by their own names
                    out_g, out_loc, out_kind, out_context = _single_windows(spec, out_g, out_loc, out_kind, context)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out_g),
                        pa.array(np.full(len(out_g), ids[row])),
                        pa.array(np.full(len(out_g), tags[row])),
                        pa.array(out_loc),
                        pa.array(out_kind),
                        pa.array(out_context, pa.binary()),
                    ],
                    ["g", "k", "tag", "loc", "kind", "context"],
                )

    return run


def _single_windows(spec: Repeats, g, loc, kind, context):
    cold = np.flatnonzero(kind != 2)
    gs, locs, kinds, contexts = [g[cold]], [loc[cold]], [kind[cold]], [context[i] for i in cold]
    for i in np.flatnonzero(kind == 2).tolist():
        units, _ = context_units(spec, [context[i]])
        names = window_names(units, spec.width).view(np.int64)
        start = (loc[i] >> _LO) + np.arange(len(names))
        gs.append(names)
        locs.append(start << _LO)
        kinds.append(np.full(len(names), 2))
        contexts += [b""] * len(names)
    return np.concatenate(gs), np.concatenate(locs), np.concatenate(kinds), contexts


def context_units(spec: Repeats, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in contexts], dtype=np.int64)))
    if spec.unit == "byte":
        return byte_names()[data], offsets
    return word_units(data, offsets)


def _compare(spec: Repeats):
    """Rows sorted by g, k, tag, loc: spans of windows that start earlier."""

    def run(batches):
        for table in whole_buckets(batches, 10_000):
            k, tags, loc, kind, g = (int64_column(table.column(x)) for x in ("k", "tag", "loc", "kind", "g"))
            units, offsets = context_units(spec, table.column("context").to_pylist())
            names = window_names(units, spec.width) if len(units) >= spec.width else np.zeros(0, np.uint64)
            ranges = RangeNames(units)
            single = kind == 2
            n = np.where(single, 1, (loc & 127) + 1)
            row = np.repeat(np.arange(len(k)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            alone = single[row]
            at = np.where(alone, 0, offsets[:-1][row] + j)
            name = np.where(alone, g[row].view(np.uint64), names[at] if len(names) else np.uint64(0))
            order = np.argsort(name, kind="stable")
            sorted_ = name[order]
            new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            first = np.empty(len(row), np.int64)
            first[order] = head
            doc, tag, start = k[row], tags[row], (loc[row] >> _LO) + j
            covered = (doc != doc[first]) | (tag != tag[first])
            if spec.within_document:
                covered |= start != start[first]
            check = np.flatnonzero(covered & ~alone)
            if len(check):
                same = ranges.of(at[check], at[check] + spec.width) == ranges.of(at[first[check]], at[first[check]] + spec.width)
                covered[check[~same]] = False
            hit = np.flatnonzero(covered)
            if not len(hit):
                continue
            cut = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])))
            a, b = hit[cut], hit[np.concatenate((np.flatnonzero(cut)[1:], [len(hit)])) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], tag[a], start[a], start[b] + spec.width)], ["k", "tag", "first", "end"])

    return run


def _kept(spec: Repeats, with_rest: bool):
    def run(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            firsts, lasts = int64_column(flat.field("first")), int64_column(flat.field("end"))
            per_row = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(per_row)
            out = []
            for row, (a, b) in enumerate(zip(ends - per_row, ends)):
                text = data[offsets[row] : offsets[row + 1]]
                first, end = merged(firsts[a:b], lasts[a:b])
                if spec.unit == "byte":
                    n, raw = len(text), text.tobytes()
                    edges = [0, *np.column_stack((first, end)).ravel().tolist(), n]
                    rest = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                else:
                    words = text.tobytes().translate(SPACES).split()
                    n = len(words)
                    edges = [0, *np.column_stack((first, end)).ravel().tolist(), n]
                    rest = b" ".join(w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y])
                out.append((n, int((end - first).sum()), len(first), hashlib.sha256(rest).hexdigest(), rest if with_rest else b""))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return run


def drop_repeats(docs: DataFrame, spec: Repeats, with_rest: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): what is left once the repeated windows are gone.

    Columns doc_id, n_units, n_removed, n_spans (maximal removed runs), kept_sha256 and
    kept (binary: bytes, or words joined by one space; only if with_rest).
    """
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_last("doc_id").alias("k"), tag, "text")
    rows = keyed.select("k", "tag", "text").mapInArrow(_anchor_rows(spec), "g long, c long, k long, tag long, loc long, done boolean")
    found = stage(
        rows.repartition("g").sortWithinPartitions("g", "c", "k", "tag", "loc").mapInArrow(_sort_out(spec), "k long, tag long, loc long, g long, kind long"),
        "repeats",
    )
    open_rows = found.filter("kind > 0").select("k", "tag", F.struct("loc", "g", "kind").alias("row")).groupBy("k", "tag").agg(F.collect_list("row").alias("open"))
    # one shuffle of the texts serves both joins
    contexts = (
        keyed.join(open_rows.hint("shuffle_hash"), ["k", "tag"])
        .select("k", "tag", "text", "open")
        .mapInArrow(_contexts(spec), "g long, k long, tag long, loc long, kind long, context binary")
    )
    late = contexts.repartition("g").sortWithinPartitions("g", "k", "tag", "loc").mapInArrow(_compare(spec), "k long, tag long, first long, end long")
    lo = F.shiftright("loc", _LO)
    early = found.filter("kind = 0").select("k", "tag", lo.alias("first"), (lo + F.col("loc").bitwiseAND(F.lit(127)) + spec.width).alias("end"))
    spans = early.unionByName(late).groupBy("k", "tag").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    done = keyed.join(spans.hint("shuffle_hash"), ["k", "tag"], "left").select("doc_id", "text", "spans")
    out = done.mapInArrow(_kept(spec, with_rest), "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_rest else out.drop("kept")
