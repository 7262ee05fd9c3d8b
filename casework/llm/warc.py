"""WARC archives of pages, written and read as chunked record tables.

A payload is a run of rows (record, chunk number, bytes), so that no step past the page table holds a whole
one: oversized payloads become WARC segments, a first record and its continuations. Digests go along
incrementally: the hash of a payload takes chunk after chunk. The version line is what parts records when
archives are read, so a payload that holds it is cut inside of it. Archives are gzip files, each written and read
by one task, a record at a time.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.session import scratch_path

#: Bytes of a chunk, and bytes from which equal payloads are kept once.
CHUNK, LEAST_SHARED = 1 << 20, 100
DATE = "2000-01-01T00:00:00Z"

# The format's version line and line end.
VERSION, END = b"WARC/1.1\r\n", b"\r\n"


def record_id(page: int | None, digest: str) -> str:
    """The same id wherever a page's record is named."""
    name = hashlib.sha256(f"{page} {digest}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def pieces(chunk: bytes) -> list[bytes]:
    """A chunk cut inside every version line that it holds."""
    out, start = [], 0
    while (at := chunk.find(VERSION, start)) >= 0:
        out.append(chunk[start : at + 4])
        start = at + 4
    return [*out, chunk[start:]]


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for the line feed it ends with, which the writer adds."""
    lines = [f"{name}: {value}".encode() for name, value in headers if value is not None]
    lines.append(f"Content-Length: {len(block)}".encode())
    return VERSION + END.join(lines) + END + END + block + END + b"\r"


def _format(batches):
    """Records of chunk rows: page, url, digest, size, first, row, chunk, data; a page's chunks in order."""
    segment, last = 0, None
    for batch in batches:
        out = []
        for page, url, digest, size, first, row, chunk, data in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            target = url and url.replace("\r", "%0D").replace("\n", "%0A")
            own = record_id(page, digest)
            shared = [
                ("WARC-Date", DATE), ("WARC-Target-URI", target), ("X-Page-ID", page), ("X-Row", row),
                ("WARC-Payload-Digest", f"sha256:{digest}"),
            ]
            if first is not None:
                headers = [
                    ("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared,
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", first),
                    ("X-Payload-Length", size),
                ]
                out.append(_record(headers, b""))
                continue
            if row != last:
                segment, last = 0, row
            cut = pieces(data)
            whole = size == len(data) and len(cut) == 1
            for at, piece in enumerate(cut):
                segment += 1
                kind = "response" if segment == 1 else "continuation"
                name = own if segment == 1 else record_id(page, f"{digest} {row} {segment}")
                headers = [
                    ("WARC-Type", kind), ("WARC-Record-ID", name), *shared,
                    ("WARC-Block-Digest", f"sha256:{hashlib.sha256(piece).hexdigest()}"),
                    ("WARC-Segment-Number", None if whole else segment),
                    ("WARC-Segment-Origin-ID", own if segment > 1 else None), ("X-Payload-Length", size),
                ]
                out.append(_record(headers, piece))
                if len(out) >= 64:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                    out = []
        yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])


def write_archives(
    pages: DataFrame,
    path: str,
    chunk: int = CHUNK,
    least: int = LEAST_SHARED,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> None:
    """Write one WARC record per page to gzipped archives below ``path``.

    The payload is ``html`` in UTF-8, null is empty. Of equal payloads of at least ``least`` bytes the page
    with the smallest key is the response and the others revisit it; rows that repeat with that key are
    responses too, and a row without a key revisits it if any of the others has one. Further columns are
    ignored; an empty table gives archives without records.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("page"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # Only digests move to find equal payloads, combined on the map side.
    equal = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    equal = equal.where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(equal, "digest", "left")
    first = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.withColumn("first", first).withColumn("row", F.monotonically_increasing_id())
    last = F.when(F.col("first").isNull(), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / chunk))).otherwise(0)
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    data = F.when(F.col("first").isNull(), F.expr(f"substring(payload, cast(chunk * {chunk} + 1 as int), {chunk})"))
    chunks = chunks.select("page", "url", "digest", "size", "first", "row", "chunk", data.alias("data"))
    records = chunks.mapInArrow(_format, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\n").option("compression", "gzip").text(path)


CHUNKS = "page long, row long, kind string, refers long, size long, told string, segment long, data binary"


def _parse(batches):
    """Chunk rows of record texts that follow a version line; every length and block digest is checked."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            head, _, rest = text.partition(END + END)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
            length = int(fields["Content-Length"])
            if rest[length:] != END + END:
                raise ValueError(f"record {fields['WARC-Record-ID']} is not {length} bytes long")
            block = rest[:length]
            told = fields.get("WARC-Block-Digest")
            if told and told != f"sha256:{hashlib.sha256(block).hexdigest()}":
                raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
            number = {k: int(fields[n]) if n in fields else None for k, n in _NUMBERS.items()}
            kind = "revisit" if fields["WARC-Type"] == "revisit" else "response"
            number |= {"kind": kind, "told": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "data": block}
            out.append(number)
        schema = pa.schema(
            [("page", pa.int64()), ("row", pa.int64()), ("kind", pa.string()), ("refers", pa.int64()),
             ("size", pa.int64()), ("told", pa.string()), ("segment", pa.int64()), ("data", pa.binary())]
        )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_NUMBERS = {
    "page": "X-Page-ID", "row": "X-Row", "refers": "X-Refers-To-Page", "size": "X-Payload-Length",
    "segment": "WARC-Segment-Number",
}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: a row for each record, with its segment number if it is parted."""
    texts = spark.read.option("lineSep", VERSION.decode()).text(path)
    # What stands before the first version line of an archive is empty.
    return texts.where("value != ''").select(F.col("value").cast("binary")).mapInArrow(_parse, CHUNKS)


def _whole(page, row, kind, refers, size, told, length, digest):
    if kind == "response" and (length != size or digest != told):
        raise ValueError(f"page {page} came back with {length} bytes, {size} were written")
    return {"page": page, "payload_bytes": size, "payload_digest": told if digest is None else digest,
            "record_type": kind, "refers_to": refers}


_OUT = pa.schema(
    [("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _digest(batches):
    """One row for each record of chunk rows that come in order; a digest takes chunk after chunk."""
    now = length = digest = None

    def done():
        told = digest.hexdigest() if now[3] == "response" else None
        return _whole(now[1], now[2], now[3], now[4], now[5], now[6], length, told)

    for batch in batches:
        out = []
        for page, row, kind, refers, size, told, segment, data in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if segment is None or segment == 1:
                if now is not None:
                    out.append(done())
                now, length, digest, expected = (row, page, row, kind, refers, size, told), 0, hashlib.sha256(), 1
            if (row, segment or 1) != (now[0], expected):
                raise ValueError(f"page {page} lacks segment {expected}")
            digest.update(data)
            length, expected = length + len(data), expected + 1
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=_OUT)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page, payload_bytes, payload_digest, record_type, refers_to`` of archives, digests worked out anew.

    Records in one piece are digested where they are read; only parted ones move, to be put in order.
    """
    schema = "page long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    chunks = read_chunks(spark, path)
    parted = chunks.where("segment is not null").repartition("row").sortWithinPartitions("row", "segment")
    return chunks.where("segment is null").mapInArrow(_digest, schema).unionAll(parted.mapInArrow(_digest, schema))


def round_trip(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST_SHARED, **columns: str) -> DataFrame:
    """Pages written to archives in the shared folder and read back from them: see both for the rows."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, chunk, least, **columns)
    return read_pages(spark, path)
