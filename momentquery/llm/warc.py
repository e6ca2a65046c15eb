"""WARC archives: writing, reading and revisit resolution.

Archives are written by Spark's own text writer, whose record separator is the one that ends a WARC record, so
they go to any file system that Spark reaches and appear only when their task commits. Files hold at most
`per_file` records. A reader holds a file as it is compressed, and inflates it in pieces, of which it keeps one
record and a batch of bounded bytes. Payloads are split off by Content-Length, so they may hold anything, record
separators included.

Revisit resolution shuffles headers only: per payload digest, the largest record id is the original, and the
others become revisit records that refer to it. Payloads below `min_bytes` are never made revisits.

Nulls: a null payload is empty, a null url leaves the target out, a null record id is smaller than any other.
Rows that repeat the original's id are originals too. An empty table writes archives without records. Extra
columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000
PER_FILE = 2000
#: Bytes that a reader inflates at once, and of records that it hands on together.
PIECE = 1 << 20
CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id long, url string, payload string, payload_digest string"
READ = "record_id long, record_type string, url string, payload_digest string, refers_to long, payload binary"


def digest(payload: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(payload, F.lit("")), "UTF-8"))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers(record_id, payload_digest, payload_bytes, ...) with record_type and refers_to.

    One partial aggregate per digest, then a join back; a digest with a third of the rows is a skewed join key,
    which adaptive execution splits.
    """
    long_enough = F.col("payload_bytes") >= min_bytes
    originals = (
        headers.filter(long_enough)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.max("record_id").alias("_original"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    joined = headers.join(originals, long_enough & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("_original"))
    return joined.withColumns(
        {
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("_original")),
        }
    ).drop("_digest", "_original")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Line ends in a value would end the header."""
    clean = F.regexp_replace(value, "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date: str) -> Column:
    """One record, without the separator that ends it, from record_id, record_type, refers_to, url, payload and
    payload_digest."""
    payload = F.coalesce("payload", F.lit(""))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(payload))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = PER_FILE) -> None:
    """records(record_id, record_type, refers_to, url, payload, payload_digest) as gzip-compressed archives."""
    (
        records.select(record_text(date).alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", per_file)
        .option("compression", "gzip")
        .text(path)
    )


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive that comes in pieces; no more than one
    record and one piece is held."""
    pieces, held, at = iter(pieces), bytearray(), 0

    def more(n: int) -> bool:
        """Whether the archive has n bytes from the current record on; reads as far as that."""
        nonlocal at
        while len(held) - at < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            del held[:at]
            held.extend(piece)
            at = 0
        return True

    done = 0
    while more(1):
        size, found = 1, -1
        while found < 0:
            if not more(size):
                raise ValueError(f"the record at byte {done} has no end of its header")
            found = held.find(b"\r\n\r\n", at + max(0, size - 4))
            size = len(held) - at + 1 if found < 0 else size
        head = found - at
        lines = held[at : at + head].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {done}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        end = head + 4 + int(fields["content-length"])
        if not more(end + 4) or held[at + end : at + end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} does not end where its length says")
        yield fields, bytes(held[at + head + 4 : at + end])
        at += end + 4
        done += end + 4


def inflated(data: bytes) -> Iterator[bytes]:
    """The plain bytes of an archive of one gzip member or more, in pieces."""
    import zlib

    unzip, rest = zlib.decompressobj(31), data
    while data:
        piece = unzip.decompress(rest, PIECE)
        if piece:
            yield piece
        rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
        if unzip.eof:
            if not rest:
                return
            unzip = zlib.decompressobj(31)
        elif not rest and not piece:
            raise ValueError("the archive ends within a gzip member")


def _number(urn: str | None) -> int | None:
    """The record id in <urn:record:7>; None for other or no ids."""
    found = (urn or "").removeprefix("<urn:record:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("record_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for fields, block in parsed(inflated(content.as_py())):
                kind = fields["warc-type"]
                body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                rows.append(
                    (_number(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(fields.get("warc-refers-to")), body)
                )
                size += len(block)
                if size > PIECE:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below path; payload is null for revisits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, READ)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records of read_warc() where revisits get the payload's size from the original they refer to."""
    own = records.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "_sha1": F.sha1("payload")}
    ).drop("payload")
    originals = (
        own.filter("record_type = 'response' and payload_bytes is not null")
        .groupBy(F.col("record_id").alias("_id"), F.col("_sha1").alias("_their"))
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    match = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_their"))
    return (
        own.join(originals, match, "left")
        .withColumns(
            {
                "payload_bytes": F.coalesce("payload_bytes", "_bytes"),
                "payload_digest": F.coalesce("_sha1", "_their"),
            }
        )
        .drop("_sha1", "_id", "_their", "_bytes")
    )


def deduplicated(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, **how) -> DataFrame:
    """Archives at source, rewritten at target with one response per payload and fresh headers for the rest.

    Revisits that the source already has take part with their original's size and digest, and their payload is
    never needed: they can only become revisits of a response, or stay what they are."""
    records = read_warc(spark, source)
    known = with_payloads(records)
    resolved = resolve_revisits(known, min_bytes).drop("url")
    bodies = records.filter("record_type = 'response'").select(
        F.col("payload_digest").alias("_digest"), F.col("record_id").alias("_id"), F.col("payload").cast("string").alias("payload")
    )
    # A payload is needed where a record stays or becomes a response; one of its copies is enough.
    one = bodies.groupBy("_digest").agg(F.max_by("payload", F.coalesce("_id", F.lit(-1))).alias("payload"))
    urls = records.select(F.col("record_id").alias("_rid"), "url").groupBy("_rid").agg(F.max("url").alias("url"))
    full = (
        resolved.join(one, (F.col("payload_digest") == F.col("_digest")) & (F.col("record_type") == "response"), "left")
        .join(urls, F.col("record_id").eqNullSafe(F.col("_rid")), "left")
    )
    write_warc(full, target, **how)
    return read_warc(spark, target)
