"""URL filter: rules first, a character language-model ratio for the rest.

Rows that a rule accepts or rejects teach two Markov models of the URL's bytes, one
each. A model is of variable order: the chance of a byte after the last k is the count
there, smoothed with the chance after the last k - 1, down to single bytes. A URL's
score is the log-likelihood difference of the models by byte; it is accepted from a
threshold on that is calibrated on a quarter of the rule rows, kept out of the counts,
for the best mean of both classes' hit rates.

All rule rows are counted, and the counts are exact: a table of grams (a byte and the
`ORDER` before it) that grows with the URLs and never leaves Spark. URLs are scored in
batches of about `BATCH_BYTES`. A batch asks once for each gram it holds, so a gram that
every URL has (`http://`) is asked for once a batch; the log ratios are worked out order
by order in joins, in which no key has more than 256 rows a side, and go back to the
batches.

Defined cases: a null url, or one without "://", has empty host and path, no rule, and
is judged by the models as it is (null: the empty string); if one class has no row, or
none to calibrate on, the threshold is 0, and without any model row everything not ruled
on is accepted; repeated rows count as often as they occur and get the same verdict;
further columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscape.llm.common import as_row, int64_column, row_type, slices, stage, utf8_column

# (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER, STRENGTH, BIN, BATCH_BYTES = 5, 2.0, 0.01, 1 << 19
START, STOP = 2, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (host and path) and its verdict: the longest that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(urls) -> tuple[np.ndarray, np.ndarray]:
    """Row and gram of every byte of the urls and of the stop mark after each.

    A gram is the byte (lowest) and the ORDER before it as one number, start marks before the first.
    """
    data, offsets = utf8_column(urls)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n + ORDER + 1)
    starts = np.cumsum(n + ORDER + 1) - (n + ORDER + 1)
    at = np.arange(len(row)) - starts[row]
    padded = np.full(len(row), START, np.uint8)
    padded[(at >= ORDER) & (at < ORDER + n[row])] = data
    padded[at == ORDER + n[row]] = STOP
    place = np.flatnonzero(at >= ORDER)
    gram = np.zeros(len(place), np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram << 8 | padded[place - k]
    return row[place], gram


def _portions(urls):
    """Ranges of rows of bounded size."""
    return slices(utf8_column(urls)[1], BATCH_BYTES)


def _count(batches):
    for batch in batches:
        accepted = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for a, b in _portions(batch.column(0)):
            row, gram = _grams(batch.column(0).slice(a, b - a))
            kinds, at = np.unique(gram, return_inverse=True)
            good = np.bincount(at[accepted[a:b][row]], minlength=len(kinds))
            both = np.bincount(at, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(good), pa.array(both - good)], ["gram", "accepted", "rejected"])


def _sums(counts: DataFrame, gram: Column) -> DataFrame:
    return counts.groupBy(gram.alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def train(labelled: DataFrame) -> DataFrame:
    """gram, accepted, rejected: how often all rows of labelled (url, accepted) have each gram."""
    counts = labelled.select(F.coalesce("url", F.lit("")).alias("url"), "accepted").mapInArrow(_count, "gram long, accepted long, rejected long")
    return stage(_sums(counts, F.col("gram")), "counts")


def log_ratios(model: DataFrame, grams: DataFrame) -> DataFrame:
    """gram and ratio, the log of its last byte's chance among the accepted over that among the rejected."""
    asked = grams.select("gram", F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("rejected"))
    every = stage(_sums(model.unionByName(asked), F.col("gram")), "grams")
    chances = None
    for k in range(ORDER + 1):
        counts = _sums(every, F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)))
        if chances is None:
            known = counts.withColumns({"p_accepted": F.lit(1 / 256), "p_rejected": F.lit(1 / 256)})
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
            known = counts.withColumn("shorter", shorter).join(chances.withColumnRenamed("gram", "shorter"), "shorter")
        context = Window.partitionBy(F.shiftright("gram", 8))  # a row for each byte after it
        chances = known.select(
            "gram",
            *[
                ((F.col(c) + STRENGTH * F.col(f"p_{c}")) / (F.sum(c).over(context) + STRENGTH)).alias(f"p_{c}")
                for c in ("accepted", "rejected")
            ],
        )
    return chances.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def _pack(batches):
    """Rows (row, text) as one row per batch, with a number of its own."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a, b in _portions(batch.column(1)):
            part = batch.slice(a, b - a)
            rows = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["row", "text"])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays([0, b - a], rows)], ["batch", "rows"])
            number += 1


def _ask(batches):
    for batch in batches:
        for i, number in enumerate(int64_column(batch.column(0)).tolist()):
            kinds = np.unique(_grams(batch.column(1).slice(i, 1).flatten().field(1))[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), number)), pa.array(kinds)], ["batch", "gram"])


def _score(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            rows, answers = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
            grams, ratios = int64_column(answers.field(0)), answers.field(1).to_numpy(zero_copy_only=False)
            order = np.argsort(grams)
            row, gram = _grams(rows.field(1))
            found = ratios[order][np.searchsorted(grams[order], gram)]
            score = np.bincount(row, weights=found, minlength=len(rows)) / np.bincount(row, minlength=len(rows))
            yield pa.RecordBatch.from_arrays([rows.field(0), pa.array(score)], ["row", "score"])


def scored(df: DataFrame, model: DataFrame) -> DataFrame:
    """row (the columns of df, url among them) and score, the log-likelihood difference by byte of the url."""
    row = as_row(df)
    kind = row_type(df, row)
    texts = df.select(row, F.coalesce("url", F.lit("")).alias("text"))
    packed = stage(texts.mapInArrow(_pack, f"batch long, rows array<struct<row: {kind}, text: string>>"), "urls")
    asked = stage(packed.mapInArrow(_ask, "batch long, gram long"), "asked")
    # no more answers than a batch has bytes
    answers = asked.join(log_ratios(model, asked), "gram").groupBy("batch").agg(F.collect_list(F.struct("gram", "ratio")).alias("answers"))
    return packed.join(answers, "batch").select("rows", "answers").mapInArrow(_score, f"row {kind}, score double")


def threshold(calibration: DataFrame) -> float:
    """Score from which a url is accepted: best mean hit rate of both classes in calibration (row.accepted, score)."""
    bins = calibration.groupBy("row.accepted", F.floor(F.col("score") / BIN).alias("bin")).count().collect()
    found = {cls: {r["bin"]: r["count"] for r in bins if r["accepted"] == cls} for cls in (True, False)}
    if not found[True] or not found[False]:
        return 0.0
    edges = sorted({b for f in found.values() for b in f} | {0})
    total = {cls: sum(f.values()) for cls, f in found.items()}

    def rate(edge: int) -> float:
        return sum(n for b, n in found[True].items() if b >= edge) / total[True] + sum(n for b, n in found[False].items() if b < edge) / total[False]

    return max((*edges, edges[-1] + 1), key=lambda e: (rate(e), -abs(e))) * BIN


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score per row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    ruled = base.withColumn("rule", rule).withColumn("ruled", verdict)
    ruled = ruled.withColumn("accepted", F.col("ruled") == "allow")
    kept_out = F.col("ruled").isNotNull() & (F.pmod(F.crc32("url"), F.lit(4)) == 3)
    ruled = ruled.withColumn("kept_out", F.coalesce(kept_out, F.lit(False)))
    model = train(ruled.filter("ruled is not null and not kept_out"))
    judged = stage(scored(ruled, model), "scored")
    least = threshold(judged.filter("row.kept_out"))
    judged = judged.select("row.*", "score")
    by_model = F.when(F.col("score") >= least, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
