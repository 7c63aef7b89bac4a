import hashlib
import re

import pytest

from levyscape.llm import decontaminate
from .helpers import docs, lower, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def plain(table, bench, width=10):
    windows = {}
    for item, text in bench:
        w = WORD.findall(lower(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in table:
        w = WORD.findall(lower(text))
        hit, items = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit[i : i + n] = [True] * n
                    items |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


A, B = prose(1, 14), prose(2, 30)
BENCH = [(1, A), (20, A.upper() + "."), (3, B), (4, "Two words"), (5, ""), (6, None), (None, prose(3, 12)), (3, prose(4, 11)), (100, "é-ü")]
ROWS = [
    (1, f"{prose(5, 9)} {A} {prose(6, 5)}"),
    (2, B.replace(" ", ", ")),
    (3, " ".join(B.split()[:9]) + " x " + " ".join(B.split()[9:])),
    (4, "here are TWO-words, and two words"),
    (5, None),
    (6, ""),
    (7, "É ü é ü"),
    (8, prose(3, 12)),
    (9, " ".join(A.split()[:10])),
    (9, " ".join(A.split()[:10])),
    (None, A),
    (10, prose(9, 50)),
]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [16 << 20, 100])
def test_rows_against_the_plain_version(spark, block):
    table = docs(spark, ROWS, extra=("spans", "items", "n_words"))
    found = decontaminate.find_passages(table, bench(spark), keep=["doc_id"], block_bytes=block)
    assert sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=repr) == plain(ROWS, BENCH)


def test_query_on_the_test_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in decontaminate.query(spark, SF).collect()), key=repr) == plain(table, items)


def test_removal(spark):
    table = docs(spark, ROWS, extra=("spans", "items"))
    clean = decontaminate.remove_passages(table, bench(spark))
    assert clean.columns == table.columns
    dirty = {r[0] for r in plain(ROWS, BENCH) if r[5]}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in ROWS if i not in dirty)
    cut = decontaminate.remove_passages(table, bench(spark), whole_documents=False)
    assert cut.columns == table.columns and cut.count() == len(ROWS)
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    assert not any(r[5] for r in plain(texts, BENCH))


def test_empty_tables(spark):
    none = bench(spark, [])
    assert decontaminate.remove_passages(docs(spark, ROWS), none).count() == len(ROWS)
    assert decontaminate.remove_passages(docs(spark, []), bench(spark)).collect() == []


def test_repeated_items_and_null_texts_fill_no_block(spark, monkeypatch):
    sizes = []
    init = decontaminate.Windows.__init__

    def counted(self, items, width):
        sizes.append(sum(len(t) for _, t in items))
        init(self, items, width)

    monkeypatch.setattr(decontaminate.Windows, "__init__", counted)
    bench = spark.createDataFrame([(1, A)] * 2_000 + [(6, None)] * 500 + [(3, B)], "item_id long, text string")
    out = decontaminate.find_passages(docs(spark, ROWS), bench, keep=["doc_id"], block_bytes=len(A) + len(B))
    assert sizes == [len(A) + len(B)]
    assert {r.doc_id for r in out.filter("size(spans) > 0").collect()} >= {1, 2}
