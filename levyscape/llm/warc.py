"""WARC archives written and read by Spark's text writer and reader, with a chunked record table.

A payload that fits into `CHUNK` bytes is one record. A larger one becomes rows
(page, chunk number, chunk): a task streams them, carrying bytes and SHA-1 so far, and
each row is a record of its own, a segment (`WARC-Segment-Number`, then `continuation`
records up to `WARC-Segment-Total-Length`). No task after the scan holds a whole large
payload. A block never holds the version line that starts a record: chunks are also cut
inside it. So files can be split between tasks at that line when they are read.

Of records with equal payloads (same length and SHA-1) the one with the largest page id
is the response and the others are revisits that name its record; payloads under `min_bytes`
are all responses.

Defined cases: a null html is an empty payload; a null page_id is written as such, is
never referred to unless the payload has no other page, and such pages are then
responses; repeated rows get records of their own, of the same type; url characters that
would break a header line are percent-encoded; further columns are ignored; an empty
table writes an archive without records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscape.llm.common import fresh_path, stage
from levyscape.sources.staging import remove_at_end

CHUNK = 32 << 10
VERSION = "WARC/1.1"
END = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNKS = "page_id long, mark long, row long, url string, chunk_no long, chunk binary, bytes long, sha1 string, last boolean"


def base32(hex_digest: Column) -> Column:
    """Base32 of a SHA-1 given in hexadecimal: four times 40 bits, as eight digits to base 32, then the letters for the digits."""
    digits = [F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _stream(batches):
    """Chunk rows in order of each record: bytes and SHA-1 carried from row to row; chunks cut inside the version line."""
    version, inside = VERSION.encode(), len("WARC/")
    row, state, total, number = None, None, 0, 0
    for batch in batches:
        out = []
        for page, mark, this, url, chunk, last in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if this != row:
                row, state, total, number = this, hashlib.sha1(), 0, 0
            cuts, at = [0], chunk.find(version)
            while at >= 0:
                cuts.append(at + inside)
                at = chunk.find(version, at + inside)
            cuts.append(len(chunk))
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = chunk[a:b]
                state.update(part)
                total += len(part)
                end = last and b == len(chunk)
                out.append((page, mark, this, url, number, part, total, state.hexdigest(), end))
                number += 1
        columns = list(zip(*out)) if out else [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def chunk_table(large: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (page_id, mark, row, url, chunk_no, chunk, bytes and sha1 so far, last) of pages (page_id, mark, row, url, payload)."""
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    cut = large.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    part = F.substring(F.col("payload"), F.col("i") * chunk_bytes + 1, F.lit(chunk_bytes))
    # an explode keeps the order of its rows, so a record's chunks follow each other in one task
    return cut.select("page_id", "mark", "row", "url", part.alias("chunk"), (F.col("i") == F.col("n") - 1).alias("last")).mapInArrow(_stream, CHUNKS)


def _header(kind: Column, url: Column, digest: Column, length: Column, more: list[Column], number: Column | None = None) -> Column:
    suffix = F.lit("") if number is None else F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise("")
    ident = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("row").cast("string"), suffix, F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20"), "WARC/", "WARC%2F")
    lines = [
        F.concat(F.lit(f"{VERSION}{END}WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), ident),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.lit("Content-Type: application/http; msgtype=response"),
        *more,
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    # a null line (one that does not apply) is left out
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END))


def _with_type(rows: DataFrame, groups: DataFrame) -> DataFrame:
    joined = rows.join(groups, ["digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when((F.col("page_id") < F.col("largest")) | F.col("page_id").isNull(), F.col("largest")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK) -> None:
    """One record for each row of pages (page_id, url, html), large payloads in segments, as WARC files in `path`."""
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("string").alias("html"),
        # one numbering for small and large payloads, so that no two records share an id
        F.monotonically_increasing_id().alias("row"),
    )
    bytes_ = F.octet_length("html").cast("long")
    oversized = (bytes_ > chunk_bytes) | F.col("html").contains(VERSION)
    small = source.filter(~oversized).select(
        "page_id", "url", "html", bytes_.alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"), "row"
    )
    large = source.filter(oversized).select(
        "page_id", F.xxhash64("html").alias("mark"), "row", "url", F.col("html").cast("binary").alias("payload")
    )
    chunks = stage(chunk_table(large, chunk_bytes), "chunks")
    wholes = chunks.filter("last").select("page_id", "row", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("digest"))
    every = small.select("page_id", "row", "payload_bytes", "digest").unionByName(wholes)
    same = every.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
    # written first: the planner knows its size when it decides how to join the payloads
    best = same.agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    groups = stage(best.select("digest", "payload_bytes", F.col("best.page_id").alias("largest"), F.col("best.row").alias("its_row")), "groups")

    http = F.lit(HTTP)
    name = base32(F.col("digest"))
    revisit = [F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("its_row").cast("string"), F.lit(">"))]
    is_revisit = F.col("refers_to").isNotNull()

    def again(rows: DataFrame) -> DataFrame:
        return rows.select(F.concat(_header(F.lit("revisit"), F.col("url"), name, F.lit(len(HTTP)), revisit), http, F.lit(END)).alias("value"))

    typed = _with_type(small, groups)
    first = _header(
        F.when(is_revisit, "revisit").otherwise("response"),
        F.col("url"),
        name,
        F.when(is_revisit, F.lit(len(HTTP))).otherwise(F.col("payload_bytes") + len(HTTP)),
        [F.when(is_revisit, line) for line in revisit],
    )
    one = typed.select(F.concat(first, http, F.when(is_revisit, "").otherwise(F.col("html")), F.lit(END)).alias("value"))

    told = stage(_with_type(wholes, groups), "told")
    rows = chunks.drop("bytes", "sha1").join(told.drop("page_id", "largest"), "row")
    number = F.col("chunk_no")
    origin = F.concat(F.lit("WARC-Segment-Origin-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("row").cast("string"), F.lit(">"))
    segment = [
        F.concat(F.lit("WARC-Segment-Number: "), (number + 1).cast("string")),
        F.when(number > 0, origin),
        F.when(F.col("last"), F.concat(F.lit("WARC-Segment-Total-Length: "), (F.col("payload_bytes") + len(HTTP)).cast("string"))),
    ]
    head = _header(
        F.when(number > 0, "continuation").otherwise("response"),
        F.col("url"),
        name,
        F.octet_length("chunk") + F.when(number > 0, 0).otherwise(len(HTTP)),
        segment,
        number,
    )
    parts = rows.filter(~is_revisit).select(F.concat(head, F.when(number > 0, "").otherwise(http), F.col("chunk").cast("string"), F.lit(END)).alias("value"))
    others = again(rows.filter(is_revisit & (number == 0)))
    one.unionByName(parts).unionByName(others).write.option("lineSep", END).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: type, id, uri, digest, refers_to, segment, origin, total (of the segmented block) and block (binary).

    Rows are cut at the version line, so the files' blocks must not hold that line, as
    those of write_archives do not.
    """
    pieces = spark.read.option("lineSep", VERSION + END).text(path).filter("value <> ''")
    header = F.substring_index("value", END + END, 1)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ?(.*?)\r?$", 1), F.lit(""))

    length = field("Content-Length").cast("int")
    return pieces.select(
        field("WARC-Type").alias("type"),
        field("WARC-Record-ID").alias("id"),
        field("WARC-Target-URI").alias("uri"),
        field("WARC-Payload-Digest").alias("digest"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Segment-Number").cast("long").alias("segment"),
        field("WARC-Segment-Origin-ID").alias("origin"),
        field("WARC-Segment-Total-Length").cast("long").alias("total"),
        F.substring(F.col("value").cast("binary"), F.octet_length(header) + 5, length).alias("block"),
    )


def _assemble(batches):
    """Blocks sorted by record and segment: bytes and SHA-1 of each record's payload, carried from row to row."""
    origin, state, total, expected = None, None, 0, None
    for batch in batches:
        out = []
        for this, segment, block, goal in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if this != origin:
                origin, state, total, expected = this, hashlib.sha1(), 0, 1
                block = block[block.index(b"\r\n\r\n") + 4 :]
            if segment != expected:
                raise ValueError(f"{origin}: segment {segment} where {expected} is due")
            state.update(block)
            total, expected = total + len(block), expected + 1
            if goal is not None:
                if total + len(HTTP) != goal:
                    raise ValueError(f"{origin}: {total + len(HTTP)} bytes, {goal} announced")
                out.append((origin, total, state.hexdigest()))
        columns = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["id", "payload_bytes", "sha1"])


def payloads(records: DataFrame) -> DataFrame:
    """Per record but continuations: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest come from the bytes read (a revisit's from its response's); a digest
    that differs from the one in the header is an error.
    """
    head = F.substring_index(F.col("block").cast("string"), END + END, 1)
    body = F.substring(F.col("block"), F.octet_length(head) + 5, F.octet_length("block"))
    singles = records.filter("type = 'response' and segment is null").select("id", "digest", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("sha1"))
    segments = records.filter("segment is not null").select(F.coalesce("origin", "id").alias("origin"), "segment", "block", "total")
    joined = segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_assemble, "id string, payload_bytes long, sha1 string")
    named = records.filter("segment = 1").select("id", "digest")
    response = singles.unionByName(joined.join(named, "id")).withColumn("payload_digest", base32(F.col("sha1")))
    checked = F.when(F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs: "), F.col("id")))
    )

    def page(column: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, 'urn:page:([^:>]*)', 1) as bigint)")

    response = response.select(page("id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"))
    by_page = response.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = records.filter("type = 'revisit'").select(page("id").alias("page_id"), page("refers_to").alias("refers_to"), F.expr("substring(digest, 6)").alias("payload_digest"))
    again = revisits.join(by_page, ["refers_to", "payload_digest"])
    plain = response.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    remove_at_end(spark, path)
    return payloads(read_archives(spark, path))
