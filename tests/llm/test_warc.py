import base64
import hashlib

import pytest

from levyscape.llm import warc
from levyscape.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, row string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def expected(rows, min_bytes=0):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        best = largest.get(h or "")
        revisit = len(data) >= min_bytes and best is not None and i != best
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.example/", "<p>one</p>"),
    (2, "http://b.example/ü?q=1 2\r\nX: y", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (3, "http://c.example/WARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record WARC/1.1WARC/1.1"),
    (4, "", None),
    (5, "u", ""),
    (6, "u", "é" * 999 + "\r\n\r\n" + "ü\n" * 500),
    (7, "u", "é" * 999 + "\r\n\r\n" + "ü\n" * 500),
    (8, "u", "x" * 5000),
    (10, "u", "a\r\n\r\nb\r\n"),
    (None, "u", "no id"),
    (None, "u", "<p>one</p>"),
    (11, "u", "twice"),
    (11, "u", "twice"),
    (12, "u", "WARC/" * 300),
]


@pytest.mark.parametrize("chunk", [64, 999, 32 << 10])
@pytest.mark.parametrize("min_bytes", [0, 20])
def test_round_trip(spark, chunk, min_bytes):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS).repartition(2), path, min_bytes, chunk)
    records = warc.read_archives(spark, path)
    got = sorted((tuple(r) for r in warc.payloads(records).collect()), key=repr)
    assert got == expected(ROWS, min_bytes)
    if chunk == 64:
        segments = records.filter("segment is not null").count()
        assert segments > 100 and max(len(r.block) for r in records.collect()) <= 64 + len(warc.HTTP)


def test_archives_are_split_between_tasks(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS).coalesce(1), path, chunk_bytes=64)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = warc.read_archives(spark, path)
        assert records.rdd.getNumPartitions() > 10
        assert sorted((tuple(r) for r in warc.payloads(records).collect()), key=repr) == expected(ROWS)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("chunk", [64, 32 << 10])
def test_every_reference_names_a_record(spark, chunk):
    rows = [*ROWS, (13, "u", "b" * 70), (13, "u", "b" * 700), (14, "u", "b" * 700), (13, "u", "c"), (15, "u", "c")]
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, rows), path, chunk_bytes=chunk)
    records = warc.read_archives(spark, path).collect()
    ids = [r.id for r in records]
    assert len(ids) == len(set(ids))
    by_id = {r.id: r for r in records}
    named = [r for r in records if r.type == "revisit"]
    assert sorted(r.id.split(":")[2] for r in named) == ["1", "13", "13", "2", "4", "6", "null"]
    for r in named:
        assert by_id[r.refers_to].type == "response" and by_id[r.refers_to].digest == r.digest
    for r in records:
        assert r.origin is None or by_id[r.origin].segment == 1


def test_every_chunk_row_carries_the_digest_so_far(spark):
    payload = ("é" * 300 + "WARC/1.1\r\n") * 5
    large = spark.createDataFrame([(1, 7, 0, "u", bytearray(payload.encode())), (2, 8, 1, "v", bytearray(b"x" * 130))], "page_id long, mark long, row long, url string, payload binary")
    table = warc.chunk_table(large, 64).orderBy("row", "chunk_no").collect()
    for row, data in ((0, payload.encode()), (1, b"x" * 130)):
        mine = [r for r in table if r.row == row]
        for i, r in enumerate(mine):
            so_far = b"".join(bytes(x.chunk) for x in mine[: i + 1])
            assert (r.chunk_no, r.bytes, r.sha1, r.last) == (i, len(so_far), hashlib.sha1(so_far).hexdigest(), i == len(mine) - 1)
        assert so_far == data


def test_empty_table_and_query(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, []), path)
    assert warc.payloads(warc.read_archives(spark, path)).collect() == []
    sf = "/root/testdata/sf0.001"
    table = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.query(spark, sf).collect()), key=repr) == expected(table)


def test_a_changed_block_is_noticed(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "u", "abc")]), path)
    from pyspark.sql import functions as F

    records = warc.read_archives(spark, path).withColumn("block", F.concat(F.lit(warc.HTTP).cast("binary"), F.lit("abd").cast("binary")))
    with pytest.raises(Exception, match="payload digest differs"):
        warc.payloads(records).collect()
