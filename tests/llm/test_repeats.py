import hashlib

import numpy as np
import pytest

from levyscape.llm import recompress_dedup, repeats, suffix_dedup
from .helpers import docs, prose, words

PASSAGE, OTHER = prose(1, 90), prose(2, 70)
# shared passages, a repeat inside a document, a copy, periodic text, short, empty, null and non-ASCII texts
ROWS = [
    (5, prose(3, 40) + " " + PASSAGE + " " + prose(4, 30)),
    (2, PASSAGE),
    (7, prose(5, 10) + " " + PASSAGE[20:] + " " + OTHER + " é " + OTHER),
    (8, "la " * 200),
    (9, "da " * 30 + "la " * 70),
    (10, prose(6, 200)),
    (11, prose(6, 200)),
    (12, "é" * 150 + "ü" * 150),
    (13, "short"),
    (14, ""),
    (15, None),
    (16, " \t\n" * 80),
    (17, "a b " * 120 + OTHER),
]


def brute(rows, width, cut, join, within):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        units = cut(text)
        covered, new = [False] * len(units), set()
        for p in range(len(units) - width + 1):
            w = tuple(units[p : p + width])
            if w in seen or within and w in new:
                covered[p : p + width] = [True] * width
            new.add(w)
        seen |= new
        spans = sum(c and (p == 0 or not covered[p - 1]) for p, c in enumerate(covered))
        kept = join([u for u, c in zip(units, covered) if not c])
        out.append((i, len(units), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def as_bytes(rows, width):
    return brute(rows, width, lambda t: list((t or "").encode()), bytes, True)


def as_words(rows, width):
    return brute(rows, width, words, lambda w: " ".join(w).encode(), False)


def found(df):
    return sorted(tuple(r)[:5] for r in df.collect())


@pytest.mark.parametrize("width,q", [(100, 20), (30, 7), (12, 12)])
def test_bytes_equal_brute_force(spark, width, q):
    out = suffix_dedup.remove_repeated_bytes(docs(spark, ROWS, extra=("k", "g", "kept")), width, q)
    assert found(out) == as_bytes(ROWS, width)


@pytest.mark.parametrize("width,rounds", [(50, 4), (50, 0), (20, 7), (5, 2)])
def test_words_equal_brute_force(spark, width, rounds):
    out = recompress_dedup.remove_repeated_words(docs(spark, ROWS, extra=("tag", "loc")), width, rounds)
    assert found(out) == as_words(ROWS, width)


def test_kept_is_what_the_digest_says(spark):
    for r in suffix_dedup.remove_repeated_bytes(docs(spark, ROWS)).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert len(r.kept) == r.n_bytes - r.n_removed


def test_hot_buckets_and_long_texts_take_other_paths(spark, monkeypatch):
    """Windows dealt out singly, and texts cut into pieces, give the same rows."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(repeats, "TOGETHER", 10)
    for op, want in ((suffix_dedup.remove_repeated_bytes, as_bytes(ROWS, 100)), (recompress_dedup.remove_repeated_words, as_words(ROWS, 50))):
        assert found(op(docs(spark, ROWS).repartition(3))) == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    twice = [*ROWS[:3], *ROWS[:3]]
    got = found(suffix_dedup.remove_repeated_bytes(docs(spark, twice)))
    assert got == sorted([*as_bytes(ROWS[:3], 100)] * 2)
    last = suffix_dedup.remove_repeated_bytes(docs(spark, [(None, PASSAGE), (3, PASSAGE)])).collect()
    assert {r.doc_id: r.n_removed for r in last} == {3: 0, None: len(PASSAGE)}
    for op in (suffix_dedup.remove_repeated_bytes, recompress_dedup.remove_repeated_words):
        assert op(docs(spark, [])).collect() == []


@pytest.mark.parametrize("op,brute_", [(suffix_dedup, as_bytes), (recompress_dedup, as_words)])
def test_query_on_the_test_table(spark, op, brute_):
    sf = "/root/testdata/sf0.001"
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_(table, 100 if op is suffix_dedup else 50)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op.query(spark, sf).collect()}
    assert got == {r[0]: (r[2], r[4]) for r in want}


def test_cores_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    for trial in range(50):
        window = rng.integers(0, 4, 50).astype(np.uint64)
        anchors = recompress_dedup.symbol_anchors(50, 5)
        seen = set()
        for _ in range(5):
            before, after = rng.integers(0, 4, rng.integers(0, 20)), rng.integers(0, 4, rng.integers(0, 20))
            text = np.concatenate((before, window, after)).astype(np.uint64)
            place, _, name = anchors(text, np.array([len(before)]))
            seen.add((int(place[0]) - len(before), int(name[0])))
        assert len(seen) == 1, trial


@pytest.mark.parametrize("op,brute_", [(suffix_dedup.remove_repeated_bytes, as_bytes), (recompress_dedup.remove_repeated_words, as_words)])
def test_texts_under_one_missing_id_stay_apart_when_13_bits_of_their_hashes_agree(spark, op, brute_):
    def hashes(texts):
        table = spark.createDataFrame([(t,) for t in texts], "text string")
        return {r.text: r.h for r in table.selectExpr("text", "xxhash64(text) h").collect()}

    long_ = PASSAGE + " " + OTHER
    meets = hashes([f"{PASSAGE[:-1]} {i}" for i in range(60_000)])
    [want] = hashes([long_]).values()
    short = min(t for t, h in meets.items() if h % 8191 == want % 8191)
    texts = sorted([long_, short], key=(meets | {long_: want}).get)
    out = op(docs(spark, [(1, prose(9, 60)), *((None, t) for t in texts)]).repartition(2)).collect()
    got = sorted(tuple(r)[1:5] for r in out)
    assert got == sorted(r[1:] for r in brute_([(1, prose(9, 60)), (2, texts[0]), (3, texts[1])], 100 if op is suffix_dedup.remove_repeated_bytes else 50))
