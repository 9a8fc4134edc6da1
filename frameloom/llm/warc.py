r"""WARC archives as a chunked record table: archives and what is read from them hold no payload in one row unless it is small.

Every record is a row of text and the archive is those rows, so Spark's own text writer and reader make and split the files on
any store. A payload of more than CHUNK bytes becomes a response segment and continuation segments, the standard's own form of
(record identifier, chunk number) rows. A payload is also cut inside each "WARC/1.1" that it holds; so that text only ever stands
at the start of a record, and reading with the separator CR LF CR LF WARC/1.1 CR LF finds exactly the records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import own_folder

#: Payload bytes of a segment at most.
CHUNK = 64 << 10
#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SALTS = 16


def base32(hexa: Column) -> Column:
    """Base32 of forty hexadecimal digits, in JVM expressions: each five digits make four letters."""
    letters = []
    for i in range(8):
        five = F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _records(pages: DataFrame, least_revisit: int) -> DataFrame:
    """page_id, url, html and what each record is to be. Pages of one payload get their response by a salted join of
    identifiers and digests alone; payloads move once, by page_id and digest, so a common payload doesn't gather anywhere."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").withColumns({"digest": F.sha1(payload), "n_bytes": F.octet_length(payload).cast("long")})
    slim = rows.select("page_id", "digest", "n_bytes")
    keepers = slim.where(F.col("n_bytes") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    salted = keepers.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    revisits = (
        slim.where(F.col("n_bytes") >= least_revisit)
        .withColumn("salt", F.coalesce(F.pmod(F.col("page_id"), F.lit(_SALTS)), F.lit(0)).cast("int"))
        .join(salted, ["digest", "salt"])
        .where(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull())
        .select("page_id", "digest", "keeper")
        .distinct()  # a page that occurs several times
    )
    # null identifiers have a key of their own, so that the join's partitions serve the window too
    key = [F.coalesce("page_id", F.lit(0)).alias("key"), F.col("page_id").isNull().alias("no_page")]
    found = rows.select("*", *key).join(revisits.select(*key, "digest", "keeper"), ["key", "no_page", "digest"], "left")
    copy = F.row_number().over(Window.partitionBy("key", "no_page", "digest").orderBy("url")) - 1
    return found.select("page_id", "url", "html", "digest", "n_bytes", "keeper", copy.alias("copy"))


def write(pages: DataFrame, path: str, chunk: int = CHUNK, least_revisit: int = 0) -> None:
    """Write an archive record for each page (page_id, url, html); payload: the html in UTF-8, null as empty.

    Of pages with equal payloads of at least least_revisit bytes that with the largest page_id is a response and the others
    revisit it. Each row is a record, also where a page occurs several times with one payload; copies of the response are
    responses too. A null page_id never is the response of others.
    """
    def identity(page: Column, digest: Column, copy: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest, F.when(copy > 0, F.concat(F.lit(":"), copy)).otherwise(""), F.lit(">"))

    rows = _records(pages, least_revisit).withColumns({"b32": base32(F.col("digest")), "id": identity(F.col("page_id"), F.col("digest"), F.col("copy"))})
    # bytes are cut, not characters: a segment may end within one
    responses = rows.where("keeper is null").select("id", "url", "b32", "n_bytes", "html")
    text = F.coalesce("html", F.lit(""))
    pieces = F.when(text.contains("WARC/1.1"), F.split(text, r"(?<=W)(?=ARC/1\.1)")).otherwise(F.array(text))
    parts = F.flatten(
        F.transform(
            F.transform(pieces, lambda x: x.cast("binary")),
            lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(x) - 1, F.lit(0)) / chunk).cast("int")), lambda i: F.substr(x, i * chunk + 1, F.lit(chunk))),
        )
    )
    segments = responses.withColumn("parts", parts).withColumn("n_parts", F.size("parts")).select("id", "url", "b32", "n_bytes", "n_parts", F.posexplode("parts").alias("k", "block"))
    first, single, last = F.col("k") == 0, F.col("n_parts") == 1, F.col("k") == F.col("n_parts") - 1
    head = F.concat(
        F.lit(VERSION),
        F.when(first, F.concat(F.lit("WARC-Type: response\r\nWARC-Record-ID: "), "id", F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "), F.lit("\r\nWARC-Payload-Digest: sha1:"), "b32", F.lit("\r\nContent-Type: application/http; msgtype=response"))).otherwise(
            F.concat(F.lit("WARC-Type: continuation\r\nWARC-Record-ID: "), F.regexp_replace("id", ">$", ""), F.lit(":"), F.col("k") + 1, F.lit(">\r\nWARC-Segment-Origin-ID: "), "id")
        ),
        F.when(single, "").otherwise(F.concat(F.lit("\r\nWARC-Segment-Number: "), F.col("k") + 1)),
        F.when(last & ~single, F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), F.col("n_bytes") + len(HTTP_HEAD))).otherwise(""),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: "),
        F.octet_length("block") + F.when(first, len(HTTP_HEAD)).otherwise(0),
        F.lit(END),
        F.when(first, HTTP_HEAD).otherwise(""),
    )
    full = segments.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    revisit = rows.where("keeper is not null").select(
        F.concat(
            F.lit(VERSION + "WARC-Type: revisit\r\nWARC-Record-ID: "), "id",
            F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "),
            F.lit("\r\nWARC-Refers-To: "), identity(F.col("keeper"), F.col("digest"), F.lit(0)), F.lit("\r\nWARC-Payload-Digest: sha1:"), "b32",
            F.lit("\r\nPayload-Length: "), F.col("n_bytes"),
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: 0" + END),
        ).alias("value")
    )
    full.unionByName(revisit).write.option("lineSep", END).option("compression", "gzip").text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: record_id, chunk (from 1), chunks (null until the last one), record_type, refers_to, payload_digest and payload_bytes as the headers say, and the chunk's payload bytes."""
    raw = spark.read.option("lineSep", END + VERSION).text(path).withColumn("head", F.substring_index("value", END, 1))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    size = field("Content-Length").cast("int")
    after = F.octet_length("head") + 5
    block = F.substr(F.col("value").cast("binary"), after, size)
    kind = field("WARC-Type")
    return raw.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk"),
        (field("WARC-Segment-Number").isNull()).alias("whole"),
        field("WARC-Segment-Total-Length").cast("long").alias("total"),
        kind.alias("kind"),
        field("WARC-Refers-To").alias("refers"),
        F.regexp_extract("head", r"WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("said_digest"),
        field("Payload-Length").cast("long").alias("said_bytes"),
        F.when(kind == "response", F.substr(block, F.lit(len(HTTP_HEAD) + 1))).otherwise(block).alias("block"),
    )


def _digests(batches):
    """Rows sorted by record_id and chunk: one running digest per record, whatever the record's size."""
    record, state, size, seen = None, None, 0, 0
    for batch in batches:
        out = []
        for name, chunk, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if name != record:
                if record is not None:
                    out.append((record, size, state))
                record, state, size, seen = name, hashlib.sha1(), 0, 0
            if chunk > seen:  # else a repeat
                data = block.as_buffer()
                state.update(data)
                size, seen = size + data.size, chunk
        if out:
            yield _rows(out)
    if record is not None:
        yield _rows([(record, size, state)])


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64()), pa.array([base64.b32encode(x[2].digest()).decode() for x in out])], ["record_id", "payload_bytes", "payload_digest"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of responses are computed from the payload as read. Whole records are digested where they are read;
    the chunks of larger ones are dealt out by record, sorted, and streamed through one running digest.
    """
    rows = chunks(spark, path)
    plain = rows.where("whole")
    known = plain.select(
        "record_id",
        F.when(F.col("kind") == "revisit", F.col("said_bytes")).otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("said_digest")).otherwise(base32(F.sha1("block"))).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.regexp_extract("refers", r"urn:page:(-?\d+):", 1).cast("long")).alias("refers_to"),
    )
    parted = rows.where("not whole").select("record_id", "chunk", "block").repartition("record_id").sortWithinPartitions("record_id", "chunk")
    joined = parted.mapInArrow(_digests, "record_id string, payload_bytes long, payload_digest string").select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    page = F.regexp_extract("record_id", r"urn:page:(-?\d+):", 1)
    return known.unionByName(joined).select(F.when(page != "", page.cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, chunk: int = CHUNK, least_revisit: int = 0) -> DataFrame:
    """write() to the shared folder, then read()."""
    spark = pages.sparkSession
    path = f"{own_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, chunk, least_revisit)
    return read(spark, path)
