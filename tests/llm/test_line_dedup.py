import hashlib

from levyscape.llm import line_dedup
from .helpers import docs, prose

L = [prose(i, 8) for i in range(40)]
ROWS = [
    (1, "\n".join(L[:8])),
    (2, "\n".join([L[20], *L[2:6], "", L[21]])),
    (3, "\n".join([L[30], "x", L[31]])),
    (4, "\n".join([L[31], "x", L[30]])),
    (5, "\n".join(L[:8])),
    (6, "\n".join([L[7], L[22], "  " + L[0] + "\r"])),
    (7, "short\nlines\nonly"),
    (8, "short\nlines\nonly"),
    (9, None),
    (10, ""),
    (11, "\n\n"),
    (12, "\n".join([L[23], L[23], L[24]])),
    (13, "\n".join([L[23], L[25]])),
]


def plain_align(a, b):
    """Patience diff, written recursively on lists."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    head, a, b = [(i, i) for i in range(n)], a[n:], b[n:]
    m = 0
    while m < min(len(a), len(b)) and a[-1 - m] == b[-1 - m]:
        m += 1
    tail = [(n + len(a) - 1 - i, n + len(b) - 1 - i) for i in range(m)][::-1]
    a, b = a[: len(a) - m], b[: len(b) - m]
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    places = [(a.index(x), b.index(x)) for x in once]
    # of several longest chains: the one whose places in b are smallest, from the end on
    best = []
    for p in places:
        before = [c for c in best if c[-1][1] < p[1]]
        longest = max(map(len, before), default=0)
        best.append([*min((c for c in before if len(c) == longest), key=lambda c: c[-1][1], default=[]), p])
    longest = max(map(len, best), default=0)
    chain = min((c for c in best if len(c) == longest), key=lambda c: c[-1][1], default=[])
    out = list(head)
    if chain:
        edges = [(-1, -1), *chain, (len(a), len(b))]
        for (i, j), (k, l) in zip(edges[:-1], edges[1:]):
            if i + 1 < k and j + 1 < l:
                out += [(x + i + 1 + n, y + j + 1 + n) for x, y in plain_align(a[i + 1 : k], b[j + 1 : l])]
            if (k, l) != (len(a), len(b)):
                out.append((k + n, l + n))
    return sorted(out + tail)


def plain(rows, min_chars=20):
    """Every document aligned with every earlier one that shares a line with it, until nothing more goes."""
    lines = {i: [x.strip() for x in t.split("\n")] if t is not None else [] for i, t in rows}
    out = []
    for i, t in rows:
        gone = set()
        for p in lines:
            if p >= i or not {x for x in lines[p] if x} & set(lines[i]):
                continue
            mine = set()
            while True:
                left = [n for n in range(len(lines[i])) if n not in mine]
                pairs = [(a, left[b]) for a, b in plain_align(lines[p], [lines[i][n] for n in left])]
                found, block = set(), []
                for n, (a, b) in enumerate([*pairs, (-9, -9)]):
                    if n and (a, b) != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
                        if sum(len(lines[i][y]) for y in block) >= min_chars:
                            found |= set(block)
                        block = []
                    block.append(b)
                mine |= found
                if not found:
                    break
            gone |= mine
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out.append((i, len(lines[i]), len(gone), kept))
    return sorted(out)


def found(df):
    return sorted((r.row.doc_id, r.n_lines, r.n_removed, r.kept) for r in df.collect())


def test_rows_against_the_plain_version(spark):
    for least in (20, 10, 1):
        got = found(line_dedup.common_lines_gone(docs(spark, ROWS, extra=("k", "lines")), ["doc_id", "k"], least))
        assert got == plain(ROWS, least)


def test_query_on_the_test_table(spark):
    sf = "/root/testdata/sf0.001"
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.query(spark, sf).collect()}
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest() if k is not None else None) for i, n, m, k in plain(table)}
    assert got.keys() == want.keys()
    assert got == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = line_dedup.common_lines_gone(docs(spark, [ROWS[0], ROWS[0], (None, ROWS[0][1])]), ["doc_id"]).collect()
    assert sorted((r.row.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (True, 8)]
    assert line_dedup.common_lines_gone(docs(spark, []), ["doc_id"]).collect() == []


def test_documents_that_lose_every_line_go(spark):
    table = docs(spark, ROWS, extra=("kept", "n_lines"))
    out = line_dedup.without_common_lines(table)
    assert out.columns == table.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert 5 not in kept and {1, 2, 7, 8, 9, 10} <= set(kept)
    assert all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)


def test_alignment_orders_equal_the_plain_one():
    import random

    rng = random.Random(8)
    for _ in range(200):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 15))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 15))]
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got))
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got[:-1], got[1:]))
        assert len(got) == len(plain_align(a, b))


def test_a_block_is_treated_alike_with_50_and_51_holders(spark):
    text = "\n".join([L[0], "x", "", L[1]])
    for n in (50, 51):
        rows = [(i, text) for i in range(n)] + [(n, "\n".join([L[1], L[5], L[0], "x", "", L[6]]))]
        got = found(line_dedup.common_lines_gone(docs(spark, rows), ["doc_id"]))
        assert [m for _, _, m, _ in got] == [0] + [4] * n  # the moved line of the last one goes as well
        assert got[-2:] == plain([rows[0], *rows[-2:]])[-2:]


def removed(spark, *texts):
    rows = list(enumerate("\n".join(t) for t in texts))
    got = found(line_dedup.common_lines_gone(docs(spark, rows), ["doc_id"]))
    assert got == plain(rows)
    return [m for _, _, m, _ in got]


def test_an_earlier_document_that_holds_one_line_saves_no_block(spark):
    block = ["one", L[0], "two", "three"]
    assert removed(spark, block, block) == [0, 4]
    assert removed(spark, [L[0]], block, block) == [0, 1, 4]
    assert removed(spark, [L[0]], ["a", *block, "b"], [L[0], "c"], [L[9], L[0], "d"], ["e", *block, "f"]) == [0, 1, 1, 1, 4]


def test_an_earlier_document_in_another_order_saves_no_block(spark):
    assert removed(spark, [L[2], L[1], L[0]], [L[0], L[1], L[2]], [L[5], L[0], L[1], L[2], L[6]]) == [0, 3, 3]
    assert removed(spark, [L[0], "x", L[1]], [L[1], "y", L[0], "z", L[1]]) == [0, 3]


def test_short_lines_count_together(spark):
    verse = ["the sun is up", "the day is new", "so go", "", "and sing"]
    assert removed(spark, ["x", *verse], [*verse, "y"], ["so go", "and sing"]) == [0, 5, 0]


def test_runs_reach_every_line_of_every_block():
    """Any stretch with enough characters is covered by runs that lie within it; blank stretches cost no more than others."""
    import random

    rng = random.Random(5)
    for _ in range(300):
        sizes = bytes(rng.choice([0, 0, 3, 5, 8, 19, 20, 30]) for _ in range(rng.randint(1, 12)))
        places = line_dedup.run_places(sizes, 20)
        assert len(places) <= 3 * len(sizes) and all(sum(sizes[a:b]) >= 20 for a, b in places)
        for a in range(len(sizes)):
            for b in range(a + 1, len(sizes) + 1):
                if sum(sizes[a:b]) >= 20:
                    assert set(range(a, b)) == {x for c, d in places if a <= c and d <= b for x in range(c, d)}
    names, sizes = line_dedup.line_names("\n" * 200_000 + L[0])
    assert len(line_dedup.run_names(names, sizes, 20)) > 200_000


def test_very_long_text(spark):
    lines = [prose(i, 6) for i in range(30_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x", *lines[100:29_000], "y"]))]
    got = found(line_dedup.common_lines_gone(docs(spark, rows), ["doc_id"]))
    assert [(n, m) for _, n, m, _ in got] == [(30_000, 0), (28_902, 28_900)]
