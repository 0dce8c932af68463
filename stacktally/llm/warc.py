"""Web archives of pages as WARC records, written and read back by Spark's own text files.

A record is one row of a text file: its header and block are the row, the two line breaks that
end a record are the separator of rows. A payload over ``SEGMENT_BYTES`` is written as a row per
segment (the format's segmentation: the first segment keeps the type, ``continuation`` records
name it and count on), so no record is ever built or read whole. Every record begins with the id
of its archive, drawn at random when it is written; that beginning is the separator by which files
are split and read, and no payload can hold it.

Read back, an oversized record is a run of rows (record, number of the chunk, bytes). They are sorted
by record and number and streamed through an incremental SHA-1 that is carried from row to row and
from batch to batch; other records are hashed where they stand and cross no network.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacktally import workspace as w

SEGMENT_BYTES = 64 * 1024
# Equal payloads of at least so many bytes are stored once.
LEAST_SHARED_BYTES = 1000
# Fixed values of the format.
BREAK = "\r\n"
END = BREAK * 2
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "page_id BIGINT, url STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, "
    "refers_to BIGINT, n_chunks INT, intact BOOLEAN"
)


def _begin(archive: str) -> str:
    return f"{VERSION}{BREAK}WARC-Warcinfo-ID: <urn:uuid:{archive}>{BREAK}"


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)) for name, value in pairs]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def _page_uri(archive: str, page_id: Column) -> Column:
    return F.concat(F.lit(f"<urn:page:{archive}:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _typed(pages: DataFrame) -> DataFrame:
    """Adds digests, sizes and, to records that repeat another's payload, ``refers_to``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "n_bytes": F.octet_length("payload").cast("bigint"),
        "digest": F.sha1("payload"),
        "key": F.unhex(F.sha2("payload", 256)),
    })
    shared = rows.filter(F.col("n_bytes") >= LEAST_SHARED_BYTES).groupBy("key").agg(
        F.max("page_id").alias("last"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    shared = w.measure(w.publish(shared, "shared_payloads"))
    typed = w.join_lookup(rows, shared, ["key"], spread_by=["page_id"], how="left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    return typed.withColumn("refers_to", refers).drop("key", "last")


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``.

    The payload is the html in UTF-8, empty if null, in an HTTP response. Of equal payloads of 1,000
    bytes or more the record of the largest page_id is the response, the others are revisits that
    refer to it. Rows that repeat the largest page_id are responses too. A row without page_id revisits
    one that has an id; among such rows alone all are responses. An address that is null is left out; one
    with blanks, control or non-ASCII characters is percent-encoded. Other columns are ignored.
    """
    archive = str(uuid.uuid4())
    spark = pages.sparkSession
    date = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    about = f"format: WARC File Format 1.1{BREAK}"
    info = (
        f"{_begin(archive)}WARC-Type: warcinfo{BREAK}WARC-Record-ID: <urn:uuid:{archive}>{BREAK}WARC-Date: {date}"
        f"{BREAK}Content-Type: application/warc-fields{BREAK}Content-Length: {len(about)}{END}{about}"
    )
    spark.createDataFrame([(info,)], "value string").coalesce(1).write.option("lineSep", END).text(f"{path}/info")

    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("n_bytes").cast("string"), F.lit(END),
    )
    n_segments = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / segment_bytes)).cast("int")
    cut = F.when(revisit, F.array(F.lit(b""))).when(
        n_segments == 1, F.array("payload")
    ).otherwise(
        F.transform(F.sequence(F.lit(0), n_segments - 1), lambda i: F.substring(
            F.col("payload"), i * segment_bytes + 1, F.lit(segment_bytes)))
    )
    # The number tells apart records of rows that share a page_id.
    rows = _typed(pages).withColumn("row", F.monotonically_increasing_id()).select(
        "page_id", "url", "n_bytes", "digest", "refers_to", "row", http.alias("http"), n_segments.alias("n_segments"),
        F.posexplode(cut).alias("segment", "chunk"),
    )
    first, split = F.col("segment") == 0, ~revisit & (F.col("n_segments") > 1)
    last = split & (F.col("segment") == F.col("n_segments") - 1)
    uri = _page_uri(archive, F.col("page_id"))
    number = (F.col("segment") + 1).cast("string")
    block = F.when(first, F.concat(F.col("http").cast("binary"), F.col("chunk"))).otherwise(F.col("chunk"))
    address = F.when(F.col("url").rlike(r"^[\x21-\x7E]*$"), F.col("url")).otherwise(F.url_encode("url"))
    header = _fields(
        ("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        ("WARC-Record-ID", F.when(first, uri).otherwise(F.concat(F.rtrim(uri, F.lit(">")), F.lit("#"), number, F.lit(">")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Refers-To", F.when(revisit, _page_uri(archive, F.col("refers_to")))),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("WARC-Segment-Number", F.when(split, number)),
        ("WARC-Segment-Origin-ID", F.when(~first, uri)),
        ("WARC-Segment-Total-Length", F.when(last, F.octet_length("http") + F.col("n_bytes"))),
        ("X-Row", F.col("row")),
        ("Content-Type", F.when(first, "application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block")),
    )
    records = rows.withColumn("block", block).select(
        F.concat(F.concat(F.lit(_begin(archive)), header, F.lit(BREAK)).cast("binary"), F.col("block"))
        .cast("string").alias("value")
    )
    records.write.option("lineSep", END).option("compression", compression).text(f"{path}/records")


def _archive_of(spark: SparkSession, path: str) -> str:
    info = spark.read.text(f"{path}/info", wholetext=True).select(
        F.regexp_extract("value", r"WARC-Warcinfo-ID: <urn:uuid:([0-9a-f-]{36})>", 1)
    )
    return info.first()[0]


def _page_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r":(-?\d+)(?:#\d+)?>$", 1).try_cast("bigint")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive that ``write`` wrote: one row per record or segment.

    page_id, row (both name the record), url, record_type, refers_to, digest and n_bytes (as the
    record states them; null in later chunks), chunk (from 0), n_chunks (null unless this is the last
    one), segmented, data (the payload's part), intact (the block is as long as its header says).
    """
    lines = spark.read.option("lineSep", _begin(_archive_of(spark, path))).text(f"{path}/records")
    ends = F.instr("value", END)
    # Headers are ASCII: their characters are bytes.
    parsed = lines.filter("value <> ''").select(
        F.str_to_map(F.substring("value", F.lit(1), ends - 1), F.lit(BREAK), F.lit(": ")).alias("f"),
        ends.alias("at"), F.col("value").cast("binary").alias("whole"),
    ).select(
        "*", F.col("f")["Content-Length"].cast("bigint").alias("length"),
    ).select(
        "f", F.expr("substring(whole, at + 4, CAST(length AS INT))").alias("block"),
        (F.octet_length("whole") == F.col("at") + 3 + F.col("length") + len(END)).alias("intact"),
    )
    field = lambda name: F.col("f")[name]
    head = field("Content-Type") == "application/http;msgtype=response"
    text_end = F.when(head, F.instr(F.col("block").cast("string"), END) + 3).otherwise(0)
    number = field("WARC-Segment-Number").cast("int")
    record = F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))
    return parsed.withColumn("head_end", text_end).select(
        _page_of(record).alias("page_id"), field("X-Row").cast("bigint").alias("row"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"), _page_of(field("WARC-Refers-To")).alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        F.when(head, F.regexp_extract(
            F.expr("substring(block, 1, head_end)").cast("string"), r"Content-Length: (\d+)", 1
        ).try_cast("bigint")).alias("n_bytes"),
        (F.coalesce(number, F.lit(1)) - 1).alias("chunk"),
        F.when(field("WARC-Segment-Total-Length").isNotNull(), number).alias("n_chunks"),
        number.isNotNull().alias("segmented"),
        F.expr("substring(block, head_end + 1)").alias("data"), "intact",
    )


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per record from its chunks in order; holds a digest and a count, no payload."""
    open_record = None
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def finished() -> tuple:
        first, digest, size, n, total, whole = open_record
        right = whole and n == total and size == first.n_bytes and digest.hexdigest() == first.digest
        return (first.page_id, first.url, size, digest.hexdigest(), first.record_type, None, n, right)

    for batch in batches:
        done = []
        for chunk in batch.itertuples(index=False):
            if open_record is None or chunk.row != open_record[0].row:
                if open_record is not None:
                    done.append(finished())
                open_record = [chunk._replace(data=b""), hashlib.sha1(), 0, 0, -1, True]
            open_record[1].update(chunk.data)
            open_record[2] += len(chunk.data)
            open_record[5] &= bool(chunk.intact) and chunk.chunk == open_record[3]
            open_record[3] += 1
            if chunk.n_chunks == chunk.n_chunks:  # no NaN: the last one
                open_record[4] = int(chunk.n_chunks)
        if done:
            yield pd.DataFrame(done, columns=columns).convert_dtypes()
    if open_record is not None:
        yield pd.DataFrame([finished()], columns=columns).convert_dtypes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, n_chunks, intact.

    Bytes and digest of a response are those of the payload as read; a revisit states those of the
    payload it refers to. ``intact``: the record is whole and as its header says.
    """
    chunks = read_chunks(spark, path)
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("n_bytes")).otherwise(F.octet_length("data").cast("bigint"))
    digest = F.when(revisit, F.col("digest")).otherwise(F.sha1("data"))
    single = chunks.filter(~F.col("segmented")).select(
        "page_id", "url", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type",
        "refers_to", F.lit(1).alias("n_chunks"),
        (F.col("intact") & size.eqNullSafe(F.col("n_bytes")) & digest.eqNullSafe(F.col("digest"))).alias("intact"),
    )
    # A record's chunks pass through one task, one after the other: a digest has to see them in order.
    runs = chunks.filter("segmented").repartition("row").sortWithinPartitions("row", "chunk")
    return single.unionByName(runs.mapInPandas(_joined, RECORDS))
