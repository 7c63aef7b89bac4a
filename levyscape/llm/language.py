"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. Letters of a
trigram are permuted by their place (a rotation) and bound by multiplication; a text is
the bundle (sum) of its trigrams' vectors; a language's prototype is the bundle of its
learning texts. A text gets the language whose prototype has the largest cosine.

Sums of whole numbers are exact, so the prototypes do not depend on partitions, nor on
where long texts are cut. A task holds the vectors of the letters it meets and of `KINDS`
trigrams at a time; the driver holds one vector per language value.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is
every text where nothing could be learned; equal cosines go to the value that sorts
first; a null doc_id is neither held out nor learned from; repeated rows return the
same row and count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscape.llm.common import as_row, of_row, row_type, slices

SIZE, SEED, PIECE, ROWS, KINDS = 1024, 11, 1 << 20, 256, 8192
UNKNOWN = "und"


@lru_cache(None)
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(100_000)
def letter_vector(code: int) -> np.ndarray:
    """The letter's vector; code 0 stands for everything between words."""
    bits = np.random.Generator(np.random.Philox(key=SEED, counter=code)).integers(0, 2, SIZE, np.int8)
    return (2 * bits - 1).astype(np.int8)


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _codes(text: str, before: np.ndarray | None = None) -> np.ndarray:
    """The text's code points after those `before`; every stretch without a letter is one 0."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.where(letter_table()[codes], codes, 0)
    if before is not None:
        codes = np.concatenate((before, codes))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def _sequences(texts: list[str]):
    """(first text, its codes one text after the other, text of each code) in portions of bounded size.

    A longer text comes alone, in pieces that carry the last two codes of the one before,
    so that the pieces have the trigrams of the whole and no others.
    """
    sizes = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for a, b in slices(sizes, PIECE):
        for i in range(a, b, ROWS):
            some = [f" {t.lower()} " for t in texts[i : min(b, i + ROWS)]]
            if len(some) == 1:
                last = None
                for k in range(0, len(some[0]), PIECE):
                    codes = _codes(some[0][k : k + PIECE], last)
                    yield i, codes, np.zeros(len(codes), np.int64)
                    last = codes[-2:]
            else:
                parts = [_codes(t) for t in some]
                yield i, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _add(out: np.ndarray, group: np.ndarray, codes: np.ndarray, row: np.ndarray) -> None:
    """Add the trigram vectors of a portion to the sums of its texts' groups, `KINDS` trigrams at a time."""
    alphabet = np.unique(codes)
    lut = np.zeros(int(alphabet[-1]) + 1, np.int64)
    lut[alphabet] = np.arange(len(alphabet))
    a, n = lut[codes], len(alphabet)
    if len(a) < 3:
        return
    good = row[2:] == row[:-2]
    gram = ((a[:-2] * n + a[1:-1]) * n + a[2:])[good]
    which, slot = np.unique(group, return_inverse=True)
    who = slot[row[2:][good]]
    if n**3 <= 1 << 22:
        there = np.zeros(n**3, bool)
        there[gram] = True
        kinds = np.flatnonzero(there)
        place = np.zeros(n**3, np.int64)
        place[kinds] = np.arange(len(kinds))
        at = place[gram]
    else:
        kinds, at = np.unique(gram, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in alphabet])
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    if len(kinds) > KINDS:
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
    edges = [*range(0, len(kinds), KINDS), len(kinds)]
    places = [0, *np.searchsorted(at, edges[1:-1]).tolist(), len(at)] if len(kinds) > KINDS else [0, len(at)]
    for low, high, from_, to in zip(edges[:-1], edges[1:], places[:-1], places[1:]):
        width, some = high - low, kinds[low:high]
        counts = np.bincount(who[from_:to] * width + (at[from_:to] - low), minlength=len(which) * width).reshape(-1, width)
        vectors = twice[some // (n * n)] * once[some // n % n] * letters[some % n]
        # whole numbers below 2**24 are exact in single precision; more take double
        kind = np.float32 if to - from_ < 1 << 24 else np.float64
        out[which] += counts.astype(kind) @ vectors.astype(kind)


def bundles(texts: list[str], group: np.ndarray, n_groups: int) -> np.ndarray:
    """Sum of the trigram vectors of the texts of each group."""
    out = np.zeros((n_groups, SIZE))
    for first, codes, row in _sequences(texts):
        _add(out, group[first : first + int(row[-1]) + 1], codes, row)
    return out


def _learn(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        values = batch.column(1).to_pylist()
        number = {lang: i for i, lang in enumerate(sorted(set(values)))}
        codes = np.array([number[lang] for lang in values], np.int64)
        for lang, vector in zip(number, bundles(_texts(batch.column(0)), codes, len(number))):
            total[lang] = total[lang] + vector if lang in total else vector
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "vector"])


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype per value of lang, from docs (text, lang); rows without a text or lang teach nothing."""
    taught = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    parts = taught.mapInArrow(_learn, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("vector"))
    found = {r["lang"]: np.array([x["value"] for x in r["vector"]]) for r in whole.collect()}
    return {k: v for k, v in sorted(found.items()) if v.any()}


def _predict(langs: list[str], matrix: np.ndarray):
    def run(batches):
        table = letter_table()
        for batch in batches:
            texts = _texts(batch.column(1))
            n = len(texts)
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if langs and n:
                sums = bundles(texts, np.arange(n), n)
                norms = np.linalg.norm(sums, axis=1)
                # rounded: the last bits depend on how many texts are multiplied together
                cosine = np.round(sums @ matrix.T / np.where(norms > 0, norms, 1)[:, None], 9)
                best = cosine.argmax(axis=1)
                known = [t.isalpha() or bool(table[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any()) for t in texts]
                pred = np.where(known, np.array(langs, object)[best], UNKNOWN)
                score = np.where(known, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """row (columns `keep` of docs), lang_pred and score (the cosine, at least 0); docs has text."""
    langs = list(learned)
    matrix = np.stack([v / np.linalg.norm(v) for v in learned.values()]) if langs else np.zeros((0, SIZE))
    row = as_row(docs, keep)
    return docs.select(row, F.col("text").alias("words")).mapInArrow(_predict(langs, matrix), f"row {row_type(docs, row)}, lang_pred string, score double")


def held_out() -> Column:
    """A quarter of the documents, by a checksum of their id, that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    return prototypes(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))


def recognised(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """Rows of docs whose language is known: not `und`, and a cosine beyond what unrelated vectors give (one standard deviation)."""
    out = predict(docs, learned, docs.columns)
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SIZE**-0.5)).select(*of_row(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(docs), ["doc_id"])
    return out.select(*of_row(["doc_id"]), "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
