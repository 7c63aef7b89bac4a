"""Substring dedup by buckets of suffixes and names of windows.

Method: the first 20 bytes of a suffix name its initial bucket. Of each window of 100
bytes only one suffix is put into buckets, the one whose initial bucket has the
smallest name among the 81 that fit (the leftmost, if several): equal windows choose
the same one. Buckets of one suffix are done. In the others, runs of windows whose whole
context has one hash are settled at once, and what is left by the names of its windows:
64-bit names of 100 bytes, made by doubling from single bytes (`common.window_names`).
Both take the place of refining buckets round by round with the bucket names of later
offsets. The first in document order stays, the rest go.

Defined cases: a null text is empty; documents under 100 bytes keep all; repeated rows
count as one document and return the same row; a null doc_id comes last; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscape.llm.common import sliding_min, window_names
from levyscape.llm.repeats import Repeats, drop_repeats

Q = 20


def suffix_anchors(width: int, q: int):
    def anchors(units: np.ndarray, s: np.ndarray):
        bucket = window_names(units, q)
        order = (bucket & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(bucket), dtype=np.uint64)
        place = (sliding_min(order, width - q + 1)[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return place, place, bucket[place]

    return anchors


def remove_repeated_bytes(docs: DataFrame, width: int = 100, q: int = Q, with_rest: bool = True) -> DataFrame:
    """Remove each byte covered by a `width`-byte string that also starts earlier.

    Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary, if with_rest).
    """
    if not 1 <= q <= width <= 127:
        raise ValueError("q <= width <= 127")
    spec = Repeats("byte", width, suffix_anchors(width, q), within_document=True)
    return drop_repeats(docs, spec, with_rest).withColumnRenamed("n_units", "n_bytes")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_bytes(docs, with_rest=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_sha256"))
