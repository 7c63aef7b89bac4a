"""Substring dedup over words by recompression.

Method: every word gets a global name. A round names maximal runs of one symbol by
(symbol, length) and then pairs of a left-class and a right-class symbol, the class
being a bit of the name, by (left, right). Names are functions of what they stand for,
so a round needs no table of names and no exchange: equal substrings get equal symbols
in all documents, except next to their ends. A window of 50 words therefore drops, in
each round, what may have joined with a word outside (its end runs; a first symbol of
the right class; a last one of the left class); the rest, its core, is the same wherever
the window occurs. The highest round with a core (of at most `rounds`) supplies the
window's anchor: the core's symbol with the smallest name. It is named together with
the half of the window on its longer side (25 words before it or from it on). Symbols
that several documents share, so named, reveal the repeats, which are then verified over
all 50 words.

Defined cases: a null text has no words; documents under 50 words keep all; rows that
repeat an id with the same text are one document; a null doc_id comes last; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from levyscape.llm.common import RangeNames, mix
from levyscape.llm.repeats import Repeats, drop_repeats

WIDTH, ROUNDS = 50, 4


def one_round(symbols: np.ndarray, places: np.ndarray, b: np.ndarray, e: np.ndarray):
    """Symbols and their first words after naming runs and pairs; each core [b, e) mapped onto them."""
    new = np.concatenate(([True], symbols[1:] != symbols[:-1]))
    run = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    length = np.diff(np.concatenate((heads, [len(symbols)]))).astype(np.uint64)
    name = symbols[heads]
    name = np.where(length > 1, mix(mix(name, length), np.uint64(1)), name)
    b, e = run[b] + 1, run[np.maximum(e - 1, 0)]
    left = (name >> np.uint64(17)) & np.uint64(1) == 0
    pair = np.zeros(len(name), bool)
    pair[:-1] = left[:-1] & ~left[1:]
    second = np.concatenate(([False], pair[:-1]))
    some = b < e
    at_b, at_e = np.minimum(b, len(name) - 1), np.maximum(e - 1, 0)
    b, e = np.where(some & ~left[at_b], b + 1, b), np.where(some & left[at_e], e - 1, e)
    some = b < e
    where = np.cumsum(~second) - 1
    pairs = mix(mix(name, np.concatenate((name[1:], name[:1]))), np.uint64(2))
    name = np.where(pair, pairs, name)[~second]
    b, e = where[np.where(some, b, 0)], where[np.where(some, e - 1, 0)] + 1
    return name, places[heads[~second]], b, np.where(some, e, b)


def smallest(symbols: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Where in [b, e) the symbol with the smallest name stands, the leftmost if several."""
    keys = (symbols & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(symbols), dtype=np.uint64)
    level = np.frexp((e - b).astype(np.float64))[1] - 1
    out = np.empty(len(b), np.uint64)
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(keys[b[at]], keys[e[at] - (1 << k)])
        keys = np.minimum(keys[: max(0, len(keys) - (1 << k))], keys[1 << k :])
    return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)


def symbol_anchors(width: int, rounds: int):
    def anchors(units: np.ndarray, s: np.ndarray):
        place, ids, names = np.empty(len(s), np.int64), np.empty(len(s), np.int64), np.empty(len(s), np.uint64)
        symbols, places, live, b, e = units, np.arange(len(units)), np.arange(len(s)), s, s + width
        for level in range(rounds + 1):
            if level < rounds:
                after = one_round(symbols, places, b, e)
                ends = after[2] >= after[3]
            else:
                ends = np.ones(len(b), bool)
            if ends.any():
                at = smallest(symbols, b[ends], e[ends])
                who = live[ends]
                place[who], ids[who], names[who] = places[at], at * 8 + level, mix(symbols[at], np.uint64(level + 3))
            if ends.all():
                break
            live, symbols, places, b, e = live[~ends], after[0], after[1], after[2][~ends], after[3][~ends]
        # the window's half on the longer side of the anchor joins the name: a symbol of a few words alone recurs by chance
        half = width // 2
        late = place - s >= half
        side = RangeNames(units).of(np.where(late, place - half, place), np.where(late, place, place + width - half))
        return place, 2 * ids + late, mix(names, side)

    return anchors


def remove_repeated_words(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, with_rest: bool = True) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts in a document with a smaller id.

    Columns doc_id, n_words, n_removed, n_spans, kept_sha256 and kept (words joined by one space, if with_rest).
    """
    if not (1 <= width <= 127 and 0 <= rounds <= 7):
        raise ValueError("width <= 127, rounds <= 7")
    spec = Repeats("word", width, symbol_anchors(width, rounds), within_document=False)
    return drop_repeats(docs, spec, with_rest).withColumnRenamed("n_units", "n_words")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_words(docs, with_rest=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
