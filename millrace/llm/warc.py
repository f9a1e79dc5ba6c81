"""WARC archives: writing captures, reading records, and transaction assembly.

A capture is written as three records: the request, the response (or a revisit, if an earlier record has the same payload) and a metadata
record. Request and metadata name the response in ``WARC-Concurrent-To``. Reading gives one row per record; assembly joins
the records of a transaction through those identifiers into one nested row per capture.

Archives are gzipped WARC/1.1 files. Records are text, so Spark's text writer makes the files:
a record is one row, and the line separator is the blank lines that end it. Files of long payloads hold fewer records, so that a file stays below some hundred
megabytes unless one record is longer. They come through Spark's own file access, are unpacked piece by piece and cut by ``Content-Length``, never by what a
payload holds; a task holds a packed file, one record and a bounded batch of records.

Defined results: a null payload is empty; a null url leaves out ``WARC-Target-URI``, line breaks and blanks in urls are
percent-encoded. A row with a null key is a capture without the ``capture`` field, under identifiers made from the digest of its url and payload,
and comes after all keys when the first of equal payloads is picked. Repeated ids are written again, each as a capture of its own. A request or metadata record whose partner is missing is
in no capture; a response without partners has null ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_RECORDS = 1_000  # of payloads up to SMALL bytes; an eighth of it for payloads up to eight times as long, and so on
SMALL = 1 << 18
PIECE = 1 << 16
BATCH_BYTES = 1 << 25
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, content_type string, headers string, payload binary, fields map<string,string>"
)
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the payload's bytes: five hex digits make four characters."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), PLAIN, BASE32)


def _record(kind: str, record_id: Column, extra: list[tuple[str, Column]], content_type: str, body: Column) -> Column:
    """Text of a record up to the blank lines that end it; headers with a null value are left out."""
    head = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *extra]
    head += [("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(body).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in head]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit(END), body)


def write_warc(df: DataFrame, path: str, url: str = "url", payload: str = "html", key: str = "page_id", least: int = 0) -> None:
    """Write request, response or revisit, and metadata records of every row below ``path``.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest key is the response, the others revisit
    it; smaller payloads are all responses. The first of each payload is found by an aggregate over digests and joined back, so a
    payload that fills a third of the table is no burden. Payloads are written by class of length, each with its own number of records per file; one
    aggregate over the lengths tells which classes occur.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    unkeyed = F.when(F.col(key).isNull(), F.sha1(F.concat(F.coalesce(F.concat(F.lit("<"), uri, F.lit(">")), F.lit("")), body)))
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(key).alias("_order"), uri.alias("uri"), body.alias("body"), unkeyed.alias("unkeyed"))
    rows = rows.withColumn("digest", payload_digest(F.col("body"))).withColumn("bytes", F.octet_length("body").cast("long"))
    marks = df.select(F.col(key).alias("_order"), payload_digest(body).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"), unkeyed.alias("_unkeyed"))
    firsts = marks.where(F.col("_bytes") >= least).groupBy("_digest", "_bytes")
    firsts = firsts.agg(F.min("_order").alias("first"), F.min("_unkeyed").alias("first_unkeyed"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes"))
    later = F.when(F.col("_order").isNotNull(), F.col("first") < F.col("_order"))
    later = later.otherwise(F.col("first").isNotNull() | (F.col("first_unkeyed") < F.col("unkeyed")))
    rows = rows.join(firsts, same, "left").withColumn("revisit", F.coalesce(later, F.lit(False)))

    def name(kind: str, of: Column, unkeyed: Column) -> Column:
        of = F.coalesce(F.concat(F.lit("<urn:capture:"), of), F.concat(F.lit("<urn:unkeyed:"), unkeyed))
        return F.concat(of, F.lit(f":{kind}>"))

    def own(kind: str) -> Column:
        return name(kind, F.col("key"), F.col("unkeyed"))

    target = ("WARC-Target-URI", F.col("uri"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    concurrent = ("WARC-Concurrent-To", own("response"))
    place = F.regexp_extract(F.coalesce("uri", F.lit("")), "^[a-z]+://[^/]*(.*)$", 1)
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), "^[a-z]+://([^/]*)", 1)
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    asked = F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    answer = F.concat(F.lit(status + "Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    http = "application/http; msgtype="
    response = _record("response", own("response"), [target, digest], http + "response", F.concat(answer, F.col("body")))
    refers = [target, digest, ("WARC-Refers-To", name("response", F.col("first").cast("string"), F.col("first_unkeyed"))), ("WARC-Profile", F.lit(PROFILE))]
    revisit = _record("revisit", own("response"), refers, http + "response", answer)
    request = _record("request", own("request"), [target, concurrent], http + "request", asked)
    facts = F.concat(F.coalesce(F.concat(F.lit("capture: "), F.col("key"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", own("metadata"), [target, concurrent], "application/warc-fields", facts)
    size = F.octet_length(body)
    grade = sum((F.when(size > SMALL * 8**i, 1).otherwise(0) for i in range(4)), F.lit(0))
    found = {r[0] for r in df.select(grade).distinct().collect()} or {0}
    size = F.col("bytes")
    for at in sorted(found):
        part = rows.where((size > (SMALL * 8 ** (at - 1) if at else -1)) & (size <= SMALL * 8**at if at < 4 else F.lit(True))) if len(found) > 1 else rows
        records = part.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))
        writer = records.write.mode("append" if at > min(found) else "errorifexists")
        writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(3, FILE_RECORDS // 8**at)).text(path)


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces, whether compressed as one member, as one per record, or not at all."""
    packed, member = data[:2] == b"\x1f\x8b", None
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        if not packed:
            yield piece
            continue
        while piece:
            if member is None:
                piece = piece.lstrip(b"\0")  # padding between members
                member = zlib.decompressobj(31) if piece else None
                continue
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = None


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of an archive that comes in pieces; only the record in hand is held."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            seen = len(held)
            if not more():
                if held:
                    raise ValueError(f"the archive ends within a record: {bytes(held[:80])!r}")
                return
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        begin = end + 4
        stop = begin + int(head["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError(f"the archive ends within a record: {lines[0][:80]!r}")
        body, headers, fields = bytes(held[begin:stop]), None, None
        if head.get("content-type", "").startswith("application/http"):
            cut = body.index(b"\r\n\r\n") + 4
            headers, body = body[:cut].decode("utf-8", "replace"), body[cut:]
        elif head.get("content-type") == "application/warc-fields":
            fields = [tuple(line.split(": ", 1)) for line in body.decode("utf-8", "replace").split("\r\n") if ": " in line]
        names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type")
        yield (*map(head.get, names), headers, body, fields)
        while len(held) < stop + 4 and more():
            pass
        del held[: stop + 4]


def _batches(records: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Records in lists of at most ``FILE_RECORDS`` records and, but for the last of each, ``BATCH_BYTES`` of payload."""
    out, size = [], 0
    for record in records:
        out.append(record)
        size += len(record[9])
        if size >= BATCH_BYTES or len(out) >= FILE_RECORDS:
            yield out
            out, size = [], 0
    if out:
        yield out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; HTTP headers and payload are apart."""
    spark_kinds = spark.createDataFrame([], RECORD).schema
    names = spark_kinds.names
    kinds = [pa.string()] * 9 + [pa.binary(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for records in _batches(_parse(_plain(data.as_py()))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*records), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, spark_kinds)


def payload_sha1(records: DataFrame) -> DataFrame:
    """Replace ``payload`` by ``payload_bytes`` and ``payload_sha1`` (base32), taken from the bytes read."""
    return records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_sha1", payload_digest(F.col("payload"))).drop("payload")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, ``response``, ``request`` and ``metadata``.

    Requests and metadata find their response or revisit through ``concurrent_to``. Of several of a kind the one with the smallest
    identifier counts. All sides are keyed by the response's identifier, one transaction each, so no key is hot.
    """
    whole = F.struct(*records.columns)
    answers = records.where(F.col("type").isin("response", "revisit")).select("record_id", whole.alias("response"))
    partners = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    of = [
        F.min_by(F.when(F.col("type") == kind, whole), F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)
        for kind in ("request", "metadata")
    ]
    partners = partners.groupBy(F.col("concurrent_to").alias("record_id")).agg(*of)
    return answers.join(partners, "record_id", "left")
