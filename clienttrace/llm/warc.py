"""WARC archives of pages, deduplicated by revisit records.

Pages are written as ``response`` records by Spark's text writer, whose line
separator is the record separator of the format; archives are read back as
binary files and cut into records by their lengths. Only headers are shuffled by
payload digest: the smallest id of each digest is combined map side, so a payload that
a third of the pages share is no hot group. Records whose payload is that of
another become ``revisit`` records that refer to it, and new archives are
written with fresh headers. Everything lies in the shared folder.

An archive holds at most ``ARCHIVE_BYTES`` of payload, or one record: records are
written in classes of payload size (``CLASSES``), a folder each, and a class has as
many records per archive as fit if all have its largest size. Archives are
inflated piece by piece, so a task holds one compressed archive and a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, written
from clienttrace.session import shared_folder

DATE = "2024-01-01T00:00:00Z"
#: Payload of an archive at most, unless it holds a single record.
ARCHIVE_BYTES = 1 << 27
#: Largest payload of each class of records but the last; those above it have an archive each.
CLASSES = (1 << 14, 1 << 17, 1 << 20, 1 << 23, 1 << 26)
#: Compressed bytes inflated at a time, to at most about a thousand times as many.
PIECE = 1 << 16
# The separator of records and the profile of revisits by digest.
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI", "id": "X-Page-ID",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "X-Refers-To-Page-ID"}


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hex digits are four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    four = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends in a value would end the header, so they are escaped."""
    escaped = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), escaped, F.lit("\r\n")), F.lit(""))


def record() -> Column:
    """The text of a record from the columns that ``HEADERS`` names, ``payload_bytes`` and ``payload``.

    A revisit's block ends after the HTTP header, which still tells the length of the payload.
    """
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(SEPARATOR))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    values = {n: F.concat(F.lit("sha1:"), F.col(n)) if n == "payload_digest" else F.col(n) for n in HEADERS}
    return F.concat(
        F.lit("WARC/1.1\r\n"), *(_line(HEADERS[n], v) for n, v in values.items()), _line("WARC-Date", F.lit(DATE)),
        F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)


def size_class(payload_bytes: Column) -> Column:
    """The number of the class in ``CLASSES`` that payloads of so many bytes belong to."""
    return F.coalesce(*(F.when(payload_bytes <= most, F.lit(k)) for k, most in enumerate(CLASSES)), F.lit(len(CLASSES)))


def write_archives(records: DataFrame, path: str, kind: int) -> None:
    """Writes records of one class below ``path``, which may hold other classes already."""
    most = max(1, ARCHIVE_BYTES // CLASSES[kind]) if kind < len(CLASSES) else 1
    records.select(record().alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").option(
        "maxRecordsPerFile", most).text(f"{path}/class-{kind}")


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces; plain, or of any number of gzip members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a member")
            piece = view[at:at + PIECE]
            at += len(piece)
            yield member.decompress(piece)
        at -= len(member.unused_data)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every record of an archive, one after another."""
    held, wanted, header = bytearray(), 0, None
    for piece in _inflated(content):
        held += piece
        while len(held) >= wanted:
            if header is None:
                # The separator of the record before may still lead.
                end = held.find(b"\r\n\r\n")
                if end == 0:
                    del held[:4]
                    continue
                if end < 0:
                    break
                lines = held[:end].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record begins with {lines[0][:40]!r}")
                header = dict(line.split(": ", 1) for line in lines[1:])
                del held[:end + 4]
                wanted = int(header["Content-Length"])
            else:
                yield header, bytes(held[:wanted])
                del held[:wanted]
                wanted, header = 0, None
    if header is not None or held.strip(b"\r\n"):
        raise ValueError("archive ends inside a record")


def read_archives(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """The records of all archives below ``path``: the columns of ``HEADERS``, ``payload_bytes``, ``payload`` if asked for.

    A response whose payload does not have its digest or length raises an error.
    """
    names = [*HEADERS, "payload_bytes", *(["payload"] if payloads else [])]
    types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.string()][:len(names) - len(HEADERS)]

    def rows(content: bytes) -> Iterator[tuple]:
        for header, block in _records(content):
            end = block.index(b"\r\n\r\n")
            size = int(dict(x.split(b": ", 1) for x in block[:end].split(b"\r\n")[1:])[b"Content-Length"])
            payload, given = block[end + 4:], header["WARC-Payload-Digest"].removeprefix("sha1:")
            if header["WARC-Type"] == "response":
                real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if real != given or len(payload) != size:
                    raise ValueError(f"{header['WARC-Record-ID']} is damaged")
            found = {n: header.get(h) for n, h in HEADERS.items()} | {"payload_digest": given}
            yield (*found.values(), size, *([payload.decode("utf-8")] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += 200 + row[6]
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types))
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option(
        "recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def archive(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
            least_bytes: int = 0) -> tuple[str, str]:
    """Writes ``pages`` as archives, and again with revisits; the folders of both.

    Of records with equal payloads of at least ``least_bytes`` bytes the one
    with the smallest id stays a response (null ids come last, of equal ids the
    smallest record id decides), the others refer to it. A null html is the empty
    payload; null ids and URLs have no header line. An empty table gives empty archives.
    """
    spark, kind = pages.sparkSession, pages.schema[id_column].dataType
    whole, slim = shared_folder(spark, "warc"), shared_folder(spark, "warc-revisits")
    payload = F.coalesce("html", F.lit(""))
    rows = columns(pages, id_column, url_column, html_column).toDF("id", "uri", "html")
    size = F.octet_length(payload)
    classes = sorted(r[0] for r in rows.select(size_class(size)).distinct().collect()) or [0]
    # Record ids are drawn once: from here on they are read from the written archives.
    for k in classes:
        write_archives(rows.where(size_class(size) == k).select(
            F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"),
            F.lit("response").alias("record_type"), "uri", F.col("id").cast("string"),
            digest(payload).alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"),
            size.cast("long").alias("payload_bytes"), payload.alias("payload")), whole, k)
    headers = read_archives(spark, whole, payloads=False).where(F.col("payload_bytes") >= least_bytes).select(
        "record_id", "payload_digest", "payload_bytes", F.col("id").cast(kind).alias("id"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "record_id")
    first = headers.groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    again = headers.join(first.where("n > 1"), ["payload_digest", "payload_bytes"]).where(
        "record_id != first.record_id").select("record_id", F.col("first.id").cast("string").alias("original"),
                                               F.lit(True).alias("again"))
    if len(classes) > 1:
        again = written(again, "warc-again")
    for k in classes:
        records = read_archives(spark, f"{whole}/class-{k}", payloads=True).join(again, "record_id", "left")
        write_archives(records.withColumn("record_type", F.when(F.col("again"), "revisit").otherwise("response"))
                       .withColumn("refers_to", F.col("original")), slim, k)
    return whole, slim
