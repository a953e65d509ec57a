"""WARC archives: written by Spark, read back by a salvage reader.

Records are built as text, each closed by two line breaks and compressed as a gzip member of its own, so that damage costs no other record.  Spark's own
text writer writes the members one after the other, so they land on whatever store the path names and failed tasks leave nothing behind.  Equal payloads are found by their SHA-1; the one
with the smallest page_id is a response, the others revisits that refer to it and hold no payload.

The reader takes an archive as bytes, plain or in gzip members.  Where a check fails (magic or version line, header, length, record end,
payload digest, gzip stream) it goes on at the next gzip member or version line, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CRLF = "\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS_A_FILE = 2000
#: Plain bytes of a member, below 2**24: the last byte of a member is then 0.
MEMBER = 8 << 20
#: Compressed bytes fed at a time, and where a step failed.
STEP, SMALL = 65536, 1
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")

READ = (
    "file string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, "
    "gap_start long, gap_end long, gap_reason string"
)


def base32(hexed: Column) -> Column:
    """Base 32 of 40 hexadecimal digits, five of them to four letters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def uri(url: Column) -> Column:
    """A URL as a header value: its line breaks are escaped."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def header(name: str, value: Column) -> Column:
    """A header line, none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def record_id(page_id: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add payload, payload_bytes, sha1, record_type and the response a revisit refers to.

    Payloads of fewer than ``least_bytes`` bytes are responses each.  Rows that share the smallest page_id and url are all responses;
    a null page_id comes after all others.
    """
    payload = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    first = p.groupBy("sha1").agg(F.min(order).alias("_o")).select("sha1", F.col("_o.page_id").alias("_id"), F.col("_o.url").alias("_url"))
    p = p.join(first, "sha1")
    revisit = ~(F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))) & (F.col("payload_bytes") >= least_bytes)
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record per page, as text."""
    p = with_types(pages, least_bytes)
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    lines = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"))),
        F.lit(f"WARC-Date: {DATE}{CRLF}"), header("WARC-Target-URI", uri(F.col("url"))), header("WARC-Page-ID", F.col("page_id")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))), header("WARC-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"), header("WARC-Refers-To", record_id(F.col("_id"), F.col("_url"))),
            header("WARC-Refers-To-Target-URI", uri(F.col("_url"))), header("WARC-Refers-To-Page-ID", F.col("_id")),
        )).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )
    return p.select(lines.alias("value"))


def members(record: bytes) -> bytes:
    """A record as a gzip member; a large one as several, each of MEMBER plain bytes at most."""
    out = []
    for at in range(0, len(record), MEMBER):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(c.compress(record[at : at + MEMBER]) + c.flush())
    return b"".join(out)


def zipped(batches):
    for batch in batches:
        values = [members(x.as_py().encode() + END) for x in batch.column("value")]
        yield pa.RecordBatch.from_arrays([pa.array([v[:-1] for v in values], pa.binary())], ["value"])


def write(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write archives of at most ``RECORDS_A_FILE`` records into a folder, by gzip members or plain ("none")."""
    out, end = records(pages, least_bytes), CRLF * 2
    if compression == "gzip":
        # A member's last byte is 0; the writer sets it as the end of the line, and has nothing else to put between members.
        out, end = out.mapInArrow(zipped, "value binary").select(F.col("value").cast("string")), "\0"
        compression = "none"
    out.write.option("lineSep", end).option("compression", compression).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def follows(data: bytes, at: int) -> bool:
    """Whether a member that can be read begins here."""
    if data[at : at + 3] != MAGIC:
        return False
    try:
        return bool(zlib.decompressobj(31).decompress(data[at : at + 4096], 16))
    except zlib.error:
        return False


def next_member(data: bytes, at: int) -> int:
    """Where the next member begins, the end of the data if none does."""
    at = data.find(MAGIC, at)
    while at >= 0 and not follows(data, at):
        at = data.find(MAGIC, at + 1)
    return len(data) if at < 0 else at


def fed(member, part: bytes, out: list[bytes]) -> str:
    """Decompress a step; where it fails, again in small pieces, so that all that comes before the damage is kept.  What was wrong, or nothing."""
    before = member.copy()
    try:
        out.append(member.decompress(part))
        return ""
    except zlib.error:
        try:
            for i in range(0, len(part), SMALL):
                out.append(before.decompress(part[i : i + SMALL]))
        except zlib.error as e:
            return f"member is damaged: {e}"
    return "member is damaged"


def inflate(data: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, str] | None]]:
    """Stretches of plain bytes with their offset, and the gap of the compressed bytes after each.

    Members that follow each other whole and hold parts of one record are one stretch.
    """
    at = 0
    first, held = 0, []  # members whose record goes on in the next
    while at < len(data):
        if data[at : at + 3] != MAGIC:
            if held:
                yield first, b"".join(held), None
                held = []
            stop = data.find(MAGIC, at)
            version = VERSION.search(data, at)
            if version and (stop < 0 or version.start() < stop):
                yield at, data[at:], None
                return
            yield at, b"", (at, len(data) if stop < 0 else stop, "no member and no version line")
            at = len(data) if stop < 0 else stop
            continue
        member, out, pos, why = zlib.decompressobj(31), [], at, ""
        while pos < len(data) and not member.eof and not why:
            part = data[pos : pos + STEP]
            why = fed(member, part, out)
            pos += len(part)
        plain = b"".join(out)
        if not held:
            first = at
        held.append(plain)
        if member.eof and not why:
            at = pos - len(member.unused_data)
            # Only a member as long as write() makes them can go on in the next.
            if len(plain) == MEMBER:
                continue
            yield first, b"".join(held), None
        else:
            stop = next_member(data, at + 1)
            yield first, b"".join(held), (at, stop, why or "member is cut off")
            at = stop
        held = []
    if held:
        yield first, b"".join(held), None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | tuple[int, int, str]]:
    """Records as (headers, block), and gaps as (start, end, reason)."""
    at = 0
    while at < len(data):
        why = ""
        start = VERSION.match(data, at)
        stop = data.find(END, at)
        if not start:
            why = "no version line"
        elif stop < 0:
            why = "header has no end"
        else:
            lines = data[start.end() : stop].decode("utf-8", "replace").split(CRLF)
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = fields.get("content-length", "")
            if not size.isdecimal():
                why = "no length"
            else:
                first, last = stop + len(END), stop + len(END) + int(size)
                if last > len(data):
                    why = "block is cut off"
                elif data[last : last + 4] != END and last != len(data):
                    why = "no record end"
                else:
                    block = data[first:last]
                    digest = fields.get("warc-payload-digest", "")
                    if fields.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest[5:] != sha1(payload(block)):
                        why = "payload digest differs"
                    else:
                        yield fields, block
                        at = last + 4
                        continue
        after = VERSION.search(data, at + 1)
        yield at, (after.start() if after else len(data)), why
        at = after.start() if after else len(data)


def payload(block: bytes) -> bytes:
    return block.partition(END)[2]


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def salvage(file: str, data: bytes, with_payload: bool = False) -> Iterator[tuple]:
    """Rows of ``READ`` of one archive."""
    number = lambda x: int(x) if x and re.fullmatch(r"-?\d+", x) else None
    for offset, plain, gap in inflate(data):
        compressed = data[offset : offset + 3] == MAGIC
        for x in parse(plain):
            if len(x) == 3:
                # In a member, gaps count in its plain bytes, after the member's own offset.
                yield (file, *[None] * 7, offset + x[0], offset + x[1], ("in the member here: " if compressed else "") + x[2])
                continue
            fields, block = x
            body = payload(block)
            again = fields.get("warc-type") == "revisit"
            size, digest = (number(fields.get("warc-payload-length")), fields.get("warc-payload-digest", "").removeprefix("sha1:")) if again else (len(body), sha1(body))
            ids = number(fields.get("warc-page-id")), number(fields.get("warc-refers-to-page-id")) if again else None
            yield file, ids[0], fields.get("warc-target-uri"), fields.get("warc-type"), size, digest, ids[1], body if with_payload else None, None, None, None
        if gap:
            yield (file, *[None] * 7, *gap)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of all archives of a folder: records, and quarantined gaps (gap_reason not null)."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for row in salvage(file, data.as_py(), with_payload):
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def whole(rows: DataFrame) -> DataFrame:
    """The records that were read; fails at a gap."""
    said = F.concat(F.lit("gap in "), "file", F.lit(" at "), F.col("gap_start").cast("string"), F.lit(": "), "gap_reason")
    return rows.filter(F.when(F.col("gap_reason").isNull(), True).otherwise(F.raise_error(said).cast("boolean")))


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages to archives in ``path`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null html is an empty payload.  Null ids and urls stay null.  Repeated rows are written and read repeated.  An empty table gives no rows.
    Other columns are ignored.  What was just written must come back whole: a gap fails the query; ``read`` returns gaps as rows.
    """
    write(pages, path)
    return whole(read(pages.sparkSession, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
