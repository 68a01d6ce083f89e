"""Web archives: legacy ARC files converted to WARC.

ARC files begin with a version block, `filedesc://...`, whose version says how the header lines of the records are
laid out: version 1 has URL, IP address, date, content type and length; version 2 adds result code, checksum,
location, offset and file name before the length. Records are cut by their declared lengths. For each the converter
makes up what a WARC record needs: an identifier from the record's content, an ISO timestamp, a type, and SHA-1 digests
of block and payload. A version block becomes a warcinfo record, an HTTP message a response, anything else (dns and
the like) a resource; responses with equal payloads become revisits of one of them. IP addresses are kept.

Archives are gzipped member by member, a record each, in files of bounded size. A file is one row of the text writer,
so archives go to any file system that Spark writes to, with its commit of finished tasks; they are read back as whole
files and inflated piece by piece.

Defined cases. A null html is an empty payload. A page without url has the target `urn:page:<id>`; without id the id
is left out of its record, and comes back as null. Pages that share the largest page_id of equal payloads are all
responses; a null id counts as the smallest. White space in a url is written as %20. An empty table gives archives
of no record. Extra columns are not archived. What can't be read (a line that is no header line, an unknown version, a
record that is cut off, a broken gzip member) is left out, reported by `rejects`, and ends no job.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm.common import bound_batches, sized, stage, staged_path

#: The header fields of the two ARC versions, in order, and their names in a version block.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_IP = ("", "-", "0.0.0.0")
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: The table has no capture time; one is given.
CAPTURED = "20240101000000"
#: A file is closed at so many bytes. Of a gzip member at most so much: the last byte of its length is zero then.
FILE_BYTES, MEMBER_BYTES = 32 << 20, 8 << 20


# --------------------------------------------------------------------------- files


def member(record: bytes) -> bytes:
    """A record as a gzip member; a very long one as several."""
    out = []
    for at in range(0, max(1, len(record)), MEMBER_BYTES):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [press.compress(record[at : at + MEMBER_BYTES]), press.flush()]
    return b"".join(out)


def files(groups: Iterator[tuple[bytes, Iterator[bytes]]], most: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """One row for each file: a head, then records until it has `most` bytes.

    The last byte of a gzip member, which is zero, is left to the writer's line separator.
    """
    for head, records in groups:
        held, size = [], 0
        for record in records:
            held.append(member(record))
            size += len(held[-1])
            if size >= most:
                yield _file(head, held)
                held, size = [], 0
        if held:
            yield _file(head, held)


def _file(head: bytes, members: list[bytes]) -> pa.RecordBatch:
    whole = b"".join([member(head), *members] if head else members)
    return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["value"])


def write_files(rows: DataFrame, path: str) -> None:
    """Rows of bytes, a file each."""
    plain = rows.select(F.col("value").cast("string").alias("value"))  # the bytes as they are: nothing is decoded
    plain.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The files below `path`, one row each: their bytes."""
    bound_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of an archive, member after member if it is gzipped, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, open_member = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view) or open_member.unconsumed_tail:
        piece = open_member.unconsumed_tail or view[at : at + step]
        if not open_member.unconsumed_tail:
            at += len(piece)
        yield open_member.decompress(piece, 4 * step)
        if open_member.eof:
            at -= len(open_member.unused_data)
            if at >= len(view):
                return
            # A member is small as a rule: no more of the file is handed over than it may need.
            step = 1 << 13
            open_member = zlib.decompressobj(31)


class Reader:
    """Lines and lengths from pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += piece
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self.more():
                end = len(self.held)
                if end == self.at:
                    return None
                break
        out = bytes(self.held[self.at : end]).rstrip(b"\r")
        self.at = min(end + 1, len(self.held))
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of a cut-off archive."""
        while len(self.held) - self.at < n and self.more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


# --------------------------------------------------------------------------- ARC


def http_block(page_id: int | None, payload: bytes) -> bytes:
    """The HTTP response that an archive holds for a page."""
    number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def version_block(version: int, name: str) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 sluicebox\n{ARC_NAMES[version]}\n"
    tail = {1: f"text/plain {len(body)}", 2: f"text/plain 200 - - 0 {name} {len(body)}"}[version]
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} {tail}\n{body}\n".encode()


def arc_record(version: int, name: str, target: str, kind: str, block: bytes, ip: str = "0.0.0.0", date: str = CAPTURED) -> bytes:
    """A record: its header line, its block, and the line end that parts records."""
    middle = {1: "", 2: f"200 - - 0 {name} "}[version]
    return f"{target} {ip} {date} {kind} {middle}{len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, path: str, version: int = 1, page: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages to ARC files below `path`, each begun by its version block."""
    target = F.coalesce(F.regexp_replace(F.trim(F.col(url)), r"\s", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("-"))))
    rows = pages.select(F.col(page).cast("long").alias("page"), target.alias("target"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId()}.arc"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for number, address, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    yield arc_record(version, name, address, "text/html", http_block(number, payload))

        yield from files(iter([(version_block(version, name), records())]))

    bound_batches(pages.sparkSession)
    write_files(rows.mapInArrow(run, "value binary"), path)


@dataclass
class ArcRecord:
    """The header fields of an ARC record by name, and its block; or what is wrong with what was read."""

    fields: dict[str, str]
    block: bytes
    error: str = ""


def header(line: bytes, version: int) -> dict[str, str] | None:
    """The fields of a header line, counted from the end, so that a url may hold spaces; None for any other line."""
    parts, names = line.decode("utf-8", "replace").split(" "), ARC_FIELDS[version]
    extra = len(parts) - len(names)
    if extra < 0 or not parts[-1].isdigit():
        return None
    fields = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]))
    return fields if fields["date"].isdigit() else None


def read_arc(pieces: Iterator[bytes]) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first, which says how the other header lines are read.

    Without a version block version 1 holds. After a line that is no header line the next one is looked for.
    """
    reader, version, lost = Reader(pieces), 1, 0
    try:
        while (line := reader.line()) is not None:
            if not line.strip():
                continue
            described = line.startswith(b"filedesc://")
            fields = header(line, 2 if described and len(line.split(b" ")) >= len(ARC_FIELDS[2]) else 1 if described else version)
            if fields is None:
                if not lost:  # of a stretch of such lines the first
                    yield ArcRecord({}, line, f"no header line of ARC version {version}")
                lost += 1
                continue
            lost, length = 0, int(fields["length"])
            block = reader.take(length)
            if len(block) < length:
                yield ArcRecord(fields, block, f"cut off: {len(block)} of {length} bytes")
                continue
            if described:
                said = block.split(b" ", 1)[0]
                if not said.isdigit() or int(said) not in ARC_FIELDS:
                    yield ArcRecord(fields, block, f"unknown ARC version {said[:20]!r}")
                    continue
                version = int(said)
            yield ArcRecord(fields, block)
    except zlib.error as error:
        yield ArcRecord({}, b"", f"broken gzip member: {error}")


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of an HTTP message, names in lower case, and its payload."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not sep:
        return {}, block
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, payload


# --------------------------------------------------------------------------- converting


def iso_date(date: str) -> str:
    """A WARC date from the 14 digits of an ARC date; of shorter ones the missing digits are the earliest."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else CAPTURED
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    """An identifier that follows from a record's content."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(10).join(parts).encode()).digest()[:16], version=4)}"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


CONVERTED = (
    "kind string, id string, target string, date string, ip string, type string, info string, page_id long, "
    "payload_bytes long, payload_digest binary, error string"
)
_KINDS = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.binary(), pa.string(), pa.binary()]
_NAMES = [*(x.split()[0] for x in CONVERTED.split(", ")), "block"]


def _convert(with_block: bool):
    """Archives to what becomes of their records; with their blocks, or without and with what could not be read."""
    names, kinds = (_NAMES, _KINDS) if with_block else (_NAMES[:-1], _KINDS[:-1])

    def converted(record: ArcRecord, info: str) -> tuple:
        fields = record.fields
        if record.error:
            return ("rejected", None, fields.get("url"), None, None, None, info, None, len(record.block), None, record.error, record.block)
        date, digest = iso_date(fields["date"]), hashlib.sha1(record.block).digest()
        name = record_id(fields["url"], fields["date"], digest.hex())
        if fields["url"].startswith("filedesc://"):
            return ("warcinfo", info, fields["url"].removeprefix("filedesc://"), date, None, None, None, None, len(record.block), digest, None, record.block)
        heads, payload = http_parts(record.block)
        kind = "response" if heads or record.block.startswith(b"HTTP/") else "resource"
        number = heads.get("x-page-id", "")
        return (
            kind, name, fields["url"], date, None if fields["ip"] in NO_IP else fields["ip"], fields["type"], info,
            int(number) if number.lstrip("-").isdigit() else None, len(payload), hashlib.sha1(payload).digest(), None, record.block,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held, info = [], 0, None
                for record in read_arc(inflate(content.as_py())):
                    if record.fields.get("url", "").startswith("filedesc://") and not record.error:
                        info = record_id(record.fields["url"], record.fields["date"], hashlib.sha1(record.block).hexdigest())
                    row = converted(record, info)
                    if with_block and row[0] == "rejected":
                        continue
                    rows.append(row if with_block else row[:-1])
                    held += len(record.block) * with_block
                    if len(rows) == 4000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def warc_record(row: dict) -> bytes:
    """The WARC record of a converted one, with the columns of the record that it repeats, if any."""
    block, kind = row["block"], row["kind"]
    if row["repeats"]:
        kind, block = "revisit", block[: block.find(b"\r\n\r\n") + 4]
    if kind == "warcinfo":
        version = block.split(b" ", 1)[0].decode("ascii", "replace")
        block = f"software: sluicebox\r\nformat: WARC File Format 1.1\r\nconverted-from: {row['target']}\r\narc-version: {version}\r\n".encode()
    mime = {"warcinfo": "application/warc-fields", "resource": row["type"]}.get(kind, "application/http; msgtype=response")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{row['id']}>", "WARC-Date": row["date"], "WARC-Block-Digest": base32(hashlib.sha1(block).digest()),
        "Content-Type": mime, "Content-Length": len(block),
    }
    if kind == "warcinfo":
        fields["WARC-Filename"] = row["target"]
    else:
        fields |= {
            "WARC-Target-URI": row["target"], "WARC-IP-Address": row["ip"], "WARC-Payload-Digest": base32(row["payload_digest"]),
            "WARC-Warcinfo-ID": row["info"] and f"<{row['info']}>", "X-Page-Id": row["page_id"], "X-Payload-Length": row["payload_bytes"],
        }
    if kind == "revisit":
        fields |= {
            "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{row['first_record']}>", "WARC-Refers-To-Target-URI": row["first_target"],
            "WARC-Refers-To-Date": row["first_date"], "X-Refers-To-Page": row["first_id"],
        }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                yield warc_record(dict(zip(batch.schema.names, values)))

    yield from files(iter([(b"", records())]))


def rejects(spark: SparkSession, arc_path: str) -> DataFrame:
    """(target, payload_bytes, error) of what can't be read in the ARC files below `arc_path`."""
    rows = archives(spark, arc_path).mapInArrow(_convert(False), CONVERTED)
    return rows.where("kind = 'rejected'").select("target", "payload_bytes", "error")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the records of the ARC files below `arc_path` as WARC files below `warc_path`.

    A first pass gathers digests alone, and names for each payload that occurs more than once the record that keeps
    it: of the largest page id, of equal ids all. The second pass writes.
    """
    slim = archives(spark, arc_path).mapInArrow(_convert(False), CONVERTED)
    shared = (
        slim.where((F.col("kind") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES))
        .groupBy(F.col("payload_digest").alias("shared_digest"))
        .agg(F.count("*").alias("n"), F.max("page_id").alias("first_id"), F.max(F.struct("page_id", "id", "target", "date")).alias("first"))
        .where("n > 1")
        .select("shared_digest", "first_id", F.col("first.id").alias("first_record"), F.col("first.target").alias("first_target"), F.col("first.date").alias("first_date"))
    )
    rows = archives(spark, arc_path).mapInArrow(_convert(True), CONVERTED + ", block binary").join(
        sized(stage(shared, "shared-payloads")), (F.col("payload_digest") == F.col("shared_digest")) & (F.col("kind") == "response"), "left"
    )
    repeats = F.col("shared_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    write_files(rows.withColumn("repeats", repeats).drop("shared_digest", "error").mapInArrow(_warc, "value binary"), warc_path)


# --------------------------------------------------------------------------- reading WARC


def read_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, names in lower case, and the block of each WARC record."""
    reader = Reader(pieces)
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        while line := reader.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, reader.take(int(fields["content-length"]))


LISTED = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, "
    "target string, date string, ip string, refers_to_record string"
)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(text: str | None) -> int | None:
        return int(text) if text else None

    names = [x.split()[0] for x in LISTED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in read_warc(inflate(content.as_py())):
                kind = fields["warc-type"]
                if kind == "revisit":
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = number(fields.get("x-payload-length"))
                else:
                    payload = http_parts(block)[1] if kind == "response" else block
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                rows.append((
                    number(fields.get("x-page-id")), size, digest, kind, number(fields.get("x-refers-to-page")),
                    fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-ip-address"),
                    fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                ))
                if len(rows) == 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def listing(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row for each record of the WARC files below `warc_path`; responses and resources are digested anew."""
    return archives(spark, warc_path).mapInArrow(_list, LISTED)


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages written as ARC, converted to WARC, and listed from there."""
    spark = pages.sparkSession
    arc, warc = staged_path(spark, "arc"), staged_path(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc)
    return listing(spark, warc).where(F.col("record_type").isin("response", "revisit"))
