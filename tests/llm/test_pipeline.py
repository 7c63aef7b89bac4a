import corpus_pipeline
from levyscape.llm import cube
from .helpers import docs, prose
from .test_decontaminate import plain as plain_hits
from .test_line_dedup import plain as plain_lines
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept: rows that go, rows that stay and their texts."""
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, apply in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in table.collect()}
        out = corpus_pipeline.stage(apply(spark, table, SF), name)
        after = [(r.doc_id, r.text) for r in out.collect()]
        if name != "mix":
            assert out.columns == table.columns
        if name == "language":
            assert {i for i, t in before.items() if any(c.isalpha() for c in t or "")} >= {i for i, _ in after}
            assert len(after) >= 0.98 * len(before)
        elif name == "lines":
            want = {i: k for i, n, gone, k in plain_lines(list(before.items())) if gone < n or not n}
            assert dict(after) == want
        elif name == "near_copies":
            ids = list(before)
            prints = [plain_fingerprint(before[i]) for i in ids]
            assert sorted(i for i, _ in after) == sorted(set(plain_components(prints, ids)))
        elif name == "benchmark":
            assert sorted(i for i, _ in after) == sorted(r[0] for r in plain_hits(list(before.items()), bench) if not r[5])
        else:
            plan = {r.doc_id: r.copies for r in cube.mix_sources(table).collect()}
            got = {}
            for i, _ in after:
                got[i] = got.get(i, 0) + 1
            assert got == {i: n for i, n in plan.items() if n}
        kept.append(len(after))
        table = out
    assert kept[0] > kept[1] > kept[2] > kept[3]


def test_awkward_tables_pass_through(spark):
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, prose(1, 80), "en", "a"), (4, prose(1, 80), "en", "a"), (None, prose(2, 80), "en", None), (5, prose(3, 4000), "de", "b")]
    for some in (rows, []):
        table = docs(spark, some, extra=("row", "kept", "copies", "spans", "k"))
        for name, apply in corpus_pipeline.STAGES:
            table = corpus_pipeline.stage(apply(spark, table, SF), name)
        assert (table.count() == 0) == (not some)
