"""Benchmark decontamination by a broadcast set of benchmark n-grams.

The benchmark's windows of 10 normalised words (a shorter item is one window) are named
by 64-bit hashes, in blocks of at most `BLOCK_BYTES` of benchmark text. Each block is
broadcast and every document's word windows are looked up in it; what is found is
verified word by word. A larger benchmark means more blocks, one after the other over
the same rows, never a larger broadcast. After each `CHAIN` blocks the rows are written
with what was found so far, so that a task never runs more scans, nor holds more blocks,
at a time. No shuffle takes place.

Defined cases: a null text has no words; an item without words has no window; an item
without an id marks words but is neither listed nor counted; items that repeat an id
count once; repeated documents return the same row; all columns of docs are kept, and
a column named like a new one is replaced; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyscape.llm.common import as_row, name_words, of_row, slices, stage, utf8_column, window_names, window_starts, word_spans

WIDTH, BLOCK_BYTES, CHAIN, SLICE, BITS = 10, 4 << 20, 4, 1 << 20, 20

LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)
IS_WORD = np.array([0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 for i in range(256)])

SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
NEW = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("byte_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _words(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    first, end, rows = word_spans(low, offsets, IS_WORD)
    return low, first, end, rows


class Windows:
    """Benchmark windows of one block: by width, sorted names and the item and first word each stands for."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.ids: list[str | None] = []
        self.words: list[list[bytes]] = []
        names, owners, starts = defaultdict(list), defaultdict(list), defaultdict(list)
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            low, first, end, _ = _words(data, np.array([0, len(data)]))
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(first.tolist(), end.tolist())]
            if not words:
                continue
            w = min(width, len(words))
            mine = window_names(name_words(low, first, end), w)
            names[w].append(mine)
            owners[w].append(np.full(len(mine), len(self.ids), np.int32))
            starts[w].append(np.arange(len(mine), dtype=np.int32))
            self.ids.append(item)
            self.words.append(words)
        self.tables = {}
        for w in names:
            keys = np.concatenate(names[w])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            maybe = np.zeros(1 << BITS, bool)
            maybe[keys >> np.uint64(64 - BITS)] = True
            self.tables[w] = (keys, maybe, np.concatenate(owners[w])[order], np.concatenate(starts[w])[order])

    def items_with(self, w: int, name: np.uint64, words: list[bytes]) -> set[str | None] | None:
        """Ids of the items that hold these words; None if none does."""
        keys, _, owner, start = self.tables[w]
        a, b = np.searchsorted(keys, name, "left"), np.searchsorted(keys, name, "right")
        found = [self.ids[i] for i, x in zip(owner[a:b].tolist(), start[a:b].tolist()) if self.words[i][x : x + w] == words]
        return set(found) or None


def _scan(windows, text_at: int, with_before: bool, keep: list[str]):
    def run(batches):
        known = windows.value
        for batch in batches:
            data, offsets = utf8_column(batch.column(text_at))
            counts, hits = np.zeros(batch.num_rows, np.int64), defaultdict(list)
            found = defaultdict(set)
            for a, b in slices(offsets, SLICE):
                low, first, end, rows = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts[a:b] = np.diff(rows)
                names = name_words(low, first, end)
                for w, (keys, maybe, _, _) in known.tables.items():
                    s = window_starts(rows, w)
                    if not len(s):
                        continue
                    name = window_names(names, w)[s]
                    at = np.flatnonzero(maybe[name >> np.uint64(64 - BITS)])
                    at = at[keys[np.minimum(np.searchsorted(keys, name[at]), len(keys) - 1)] == name[at]]
                    row = np.searchsorted(rows, s[at], "right") - 1
                    for i, r in zip(at.tolist(), row.tolist()):
                        x = int(s[i])
                        words = [low[first[j] : end[j]].tobytes() for j in range(x, x + w)]
                        items = known.items_with(w, name[i], words)
                        if items is not None:
                            from_ = x - int(rows[r])
                            start = int(offsets[a + r] - offsets[a])
                            hits[a + r].append((from_, from_ + w, int(first[x]) - start, int(end[x + w - 1]) - start))
                            found[a + r] |= items
            before = [None] * batch.num_rows
            if with_before:
                before = batch.select(["spans", "byte_spans", "items"]).to_pylist()
            spans, byte_spans, items = [], [], []
            for r in range(batch.num_rows):
                mine = hits.get(r, [])
                some, ids = found.get(r, set()), []
                old = before[r]
                if old:
                    mine = mine + [(p["first"], p["end"], q["first"], q["end"]) for p, q in zip(old["spans"], old["byte_spans"])]
                    ids = old["items"]
                if mine:
                    four = np.array(sorted(mine), np.int64)
                    new = np.concatenate(([True], four[1:, 0] > np.maximum.accumulate(four[:, 1])[:-1]))
                    first, last = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:], [len(four)])) - 1
                    reach, byte_reach = np.maximum.accumulate(four[:, 1]), np.maximum.accumulate(four[:, 3])
                    spans.append([{"first": x, "end": y} for x, y in zip(four[first, 0].tolist(), reach[last].tolist())])
                    byte_spans.append([{"first": x, "end": y} for x, y in zip(four[first, 2].tolist(), byte_reach[last].tolist())])
                else:
                    spans.append([])
                    byte_spans.append([])
                items.append(sorted({*ids, *(str(x) for x in some if x is not None)}))
            new_columns = [pa.array(counts), pa.array(spans, SPAN), pa.array(byte_spans, SPAN), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + new_columns, keep + NEW.names)

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep` of docs (all, unless given) with n_words, spans (word ranges hit, maximal), byte_spans and items.

    byte_spans are the same ranges in the text's UTF-8 bytes.
    """
    keep = [c for c in (keep or docs.columns) if c not in NEW.names]
    spark = docs.sparkSession
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    # repeated items count once, in the size of a block as well
    items = stage(items.distinct(), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in rows], width))
        last = block == blocks - 1
        kept = keep if last else list(dict.fromkeys([*keep, "text"]))
        schema = T.StructType([docs.schema[c] for c in kept] + NEW.fields)
        out = out.mapInArrow(_scan(windows, out.columns.index("text"), block > 0, kept), schema)
        if not last and (block + 1) % CHAIN == 0:
            out = stage(out, "scanned")
    return out


def remove_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, whole_documents: bool = True) -> DataFrame:
    """Documents without a benchmark passage; or all of them, with the words hit (and what stands between) cut out."""
    names = docs.columns if whole_documents else [c for c in docs.columns if c != "text"]
    row = as_row(docs, names)
    if whole_documents:
        found = find_passages(docs.select(row, "text"), benchmark, width, ["row"])
        return found.filter(F.size("spans") == 0).select(*of_row(names))
    found = find_passages(docs.select(row, "text"), benchmark, width).select("row", "text", "byte_spans")

    def cut(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and spans:
                    raw, edges = text.encode(), [0, *(x for s in spans for x in (s["first"], s["end"])), None]
                    text = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    cut_out = found.mapInArrow(cut, T.StructType([found.schema["row"], T.StructField("text", T.StringType())]))
    new = dict(zip(names, of_row(names))) | {"text": F.col("text")}
    return cut_out.select(*[new[c] for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]))
