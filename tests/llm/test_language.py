import tracemalloc

import numpy as np

from levyscape.llm import language
from .helpers import docs

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_same_rows_whatever_the_partitions(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.collect()}
    got = {r.doc_id: r for r in language.query(spark, SF).collect()}
    held = [i for i, r in got.items() if r.held_out and truth[i]]
    assert len(got) == len(truth) and len(held) > 20
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    again = language.predict(table.repartition(7), language.learn(table.repartition(5)), ["doc_id"])
    assert {r.row.doc_id: (r.lang_pred, r.score) for r in again.collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


ROWS = [
    (1, "the cat sat on the mat and the dog", "en"),
    (2, "der hund und die katze sind nicht da", "de"),
    (3, "the hat of the man is on the bed", "en"),
    (4, None, "en"),
    (5, "", "de"),
    (6, "12 34 !!", "en"),
    (7, "und die", None),
    (None, "the the the", "en"),
    (7, "und die", None),
    (8, "x" * 5000 + " the and", None),
]


def test_awkward_rows(spark):
    table = docs(spark, ROWS, extra=("lang_pred", "score", "row"))
    learned = language.prototypes(table)
    assert list(learned) == ["de", "en"]
    out = [r for r in language.predict(table, learned, ["doc_id", "row"]).collect()]
    by = {}
    for r in out:
        by.setdefault(r.row.doc_id, []).append((r.lang_pred, r.score))
    assert by[4] == by[5] == by[6] == [("und", 0.0)]
    assert by[1][0][0] == by[None][0][0] == "en" and by[2][0][0] == "de"
    assert len(by[7]) == 2 and by[7][0] == by[7][1] and by[7][0][0] == "de"
    kept = language.recognised(table, learned)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3} and not {4, 5, 6} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    table = docs(spark, [(1, "abc", None), (2, None, "en")])
    assert language.prototypes(table) == {}
    assert {(r.lang_pred, r.score) for r in language.predict(table, {}, ["doc_id"]).collect()} == {("und", 0.0)}
    assert language.predict(docs(spark, []), {}, ["doc_id"]).collect() == []


def plain_bundle(text):
    """Sum of the bound, rotated letter vectors of the trigrams, one by one."""
    padded, codes = f" {text.lower()} ", []
    for c in padded:
        code = ord(c) if c.isalpha() else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    vector = language.letter_vector
    out = np.zeros(language.SIZE)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        out += np.roll(vector(a), 2).astype(int) * np.roll(vector(b), 1) * vector(c)
    return out


TEXTS = ["the quick, brown fox -- " * 40, "", "a", "12", "ÄÖ İstanbul ΟΔΟΣ", "x" + "." * 500 + "y", "漢字かな交じり文 " * 30, "..." * 100 + "end"]


def test_bundles_equal_the_plain_ones(monkeypatch):
    want = np.stack([plain_bundle(t) for t in TEXTS])
    for piece, kinds, rows in ((1 << 20, 8192, 256), (64, 8192, 256), (3, 5, 2), (1, 1, 1), (1 << 20, 7, 3)):
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(language, "KINDS", kinds)
        monkeypatch.setattr(language, "ROWS", rows)
        assert (language.bundles(TEXTS, np.arange(len(TEXTS)), len(TEXTS)) == want).all()
        both = language.bundles(TEXTS, np.arange(len(TEXTS)) % 2, 2)
        assert (both == np.stack([want[::2].sum(axis=0), want[1::2].sum(axis=0)])).all()


def test_a_long_text_of_many_letters_stays_small():
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1 << 20)))
    tracemalloc.start()
    sums = language.bundles([text], np.array([0]), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.any() and peak < 600 << 20
