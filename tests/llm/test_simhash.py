import numpy as np
import pytest
import xxhash

from levyscape.llm import components, simhash
from .helpers import docs, lower, prose, words


def plain_fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min((ids[k] for k in range(len(ids)) if root[k] == root[i] and ids[k] is not None), default=None) for i in range(len(ids))]


BASE = prose(1, 300)
ROWS = [
    (4, BASE),
    (2, BASE.upper()),
    (9, BASE + " tail"),
    (3, prose(2, 300)),
    (11, "one two"),
    (12, "one two"),
    (5, None),
    (6, ""),
    (7, " \n\t"),
    (8, "é ü ß  ö"),
    (13, BASE.replace(" ", "\n")),
    (None, BASE),
    (4, BASE),
]


def test_documents_against_brute_force(spark):
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs(spark, ROWS, extra=("fp", "root"))).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in ROWS]
    ids = [i for i, _ in ROWS]
    want = sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(prints, ids))), key=repr)
    assert got == want
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("most", [4_000_000, 4_000])
def test_links_connect_exactly_the_close_ones(spark, most):
    """Chains, balls and far points; with a small limit hot parts are divided several times."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    for n in (1, 2, 3, 4, 5, 6, 9):
        for _ in range(12):
            bits = rng.choice(64, n, replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in bits))
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 80)} | {0, 1, 3, 0xF0, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.a: r.root for r in components.components(simhash.near_links(df, len(signed), 4, most)).collect()}
    group = {}
    for p in signed:
        group.setdefault(roots.get(p, p), set()).add(p)
    want = {}
    for p, c in zip(signed, plain_components(prints, signed)):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group_stays(spark):
    out = simhash.one_of_each(docs(spark, ROWS, extra=("_k", "nth")))
    assert out.columns[-2:] == ["_k", "nth"]
    kept = out.collect()
    wanted = {c for c in plain_components([plain_fingerprint(t) for _, t in ROWS], [i for i, _ in ROWS])}
    assert sorted(r.doc_id for r in kept) == sorted(wanted)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 1000 + i) for i in range(40)] + [(7, 7), (5, 6), (6, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    roots = {r.a: r.root for r in components.components(df).collect()}
    assert roots == {**{i: 100 for i in range(101, 161)}, **{1000 + i: 1 for i in range(40)}, 6: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
