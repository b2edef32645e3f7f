"""Web archives: a converter of legacy ARC files (versions 1 and 2) to WARC, and a reader of WARC.

ARC records are found by their header line, whose fields depend on the version that the file's first record
declares, and by the length at the line's end.  Each record becomes a WARC record with a synthesised
identifier (a name-based UUID), date, type, and payload digest.  Of records with equal payloads of
REVISIT_FROM bytes or more, the one with the largest page id stays a response, the others become revisits.

Files are written by Spark's text writer, one record a row with the format's separator between rows, gzipped,
into the shared folder; they are read back as whole files by Spark and parsed as a stream.

Cases: a null html is an empty payload; a null url has no target URI; a null page id sorts first and is not
written; rows that repeat the largest page id are all responses; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, new_folder, staged

REVISIT_FROM = 1000
ARC_DATE, ARC_IP, NO_URL = "20200101000000", "0.0.0.0", "urn:x-no-url"
#: Records of an archive file at most: a file is parsed by one task.
FILE_RECORDS = 20_000
#: Winners of more payloads than this are joined by shuffling.
BROADCAST_ROWS = 200_000
_URL_SAFE = "/:?#[]@!$&'()*+,;=%~-._"
_ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, from RFC 4122


def arc_version_block(version: int, name: str) -> str:
    body = f"{version} 0 tarnwick\n{_ARC_FIELDS[version]}\n"
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} {ARC_IP} {ARC_DATE} text/plain{middle} {len(body)}\n{body}"


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None, name: str = "pages.arc") -> str:
    """One ARC record: a header line and an HTTP response of the declared length (a page id travels as an HTTP header)."""
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n" + (html or "")
    size = len(body.encode("utf-8", "replace"))
    middle = "" if version == 1 else f" 200 {hashlib.md5(body.encode('utf-8', 'replace')).hexdigest()} - 0 {name}"
    return f"{quote(url, safe=_URL_SAFE) if url else NO_URL} {ARC_IP} {ARC_DATE} text/html{middle} {size}\n{body}"


#: Columns of the tables in between, with their types.
META = {"digest": "string", "size": "long", "page_id": "long", "url": "string"}
CUT = {"page_id": "long", "url": "string", "ip": "string", "date": "string", "mime": "string", "version": "int", "head": "binary", "payload": "binary", "digest": "string", "size": "long"}
FOUND = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "record_id": "string", "warc_date": "string"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, t in enumerate(columns.values())], names=list(columns))


def _values(rows: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])


class Stream:
    """Bytes of a gzipped (any number of members) or plain file, decompressed as they are read."""

    def __init__(self, content: bytes):
        self.content, self.at, self.have = memoryview(content), 0, bytearray()
        self.pos = 0
        self.gz = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = bytes(self.content[self.at : self.at + (1 << 20)])
        self.at += len(piece)
        if self.pos > (1 << 22):
            del self.have[: self.pos]
            self.pos = 0
        while self.gz is not None and piece:
            self.have += self.gz.decompress(piece)
            piece = self.gz.unused_data
            if piece:
                self.gz = zlib.decompressobj(31)
        self.have += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed over; None at the end."""
        seen = self.pos
        while (end := self.have.find(mark, seen)) < 0:
            back = len(self.have) - self.pos
            if not self._more():
                return None
            seen = self.pos + max(0, back - len(mark))
        out = bytes(self.have[self.pos : end])
        self.pos = end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) - self.pos < n:
            if not self._more():
                raise ValueError("a record is shorter than its declared length")
        out = bytes(self.have[self.pos : self.pos + n])
        self.pos += n
        return out


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of one ARC file, without its version block."""
    stream, version = Stream(content), None
    while (line := stream.until(b"\n")) is not None:
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").rsplit(" ", len(_ARC_FIELDS[version or 1].split()) - 1)
        body = stream.take(int(fields[-1]))
        if version is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("an ARC file must begin with its version block")
            version = int(body.split(b" ", 1)[0])
            if version not in _ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        head, _, payload = body.partition(b"\r\n\r\n")
        page = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
        yield {
            "page_id": int(page[0]) if page else None, "url": fields[0], "ip": fields[1], "date": fields[2], "mime": fields[3], "version": version,
            "head": head, "payload": payload, "digest": hashlib.sha1(payload).hexdigest(), "size": len(payload),
        }


def record_id(url: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{url} {page_id} {digest}')}>"


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: dict, winner: tuple[int, str] | None) -> str:
    """The WARC record of an ARC record, without the blank lines at its end; winner: the (page_id, url) that a revisit refers to."""
    block = r["head"] + b"\r\n\r\n" + (b"" if winner else r["payload"])
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if winner else 'response'}", f"WARC-Record-ID: {record_id(r['url'], r['page_id'], r['digest'])}", f"WARC-Date: {_iso(r['date'])}",
        f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: {_base32(r['digest'])}", f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {r['size']}", f"X-Arc-Version: {r['version']}",
    ]
    if r["url"] != NO_URL:
        lines.insert(3, f"WARC-Target-URI: {r['url']}")
    if winner:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(winner[1], winner[0], r['digest'])}", f"X-Refers-To-Page-Id: {winner[0]}"]
        lines += [f"WARC-Refers-To-Target-URI: {winner[1]}", f"WARC-Refers-To-Date: {_iso(r['date'])}", f"WARC-Truncated: length"] if winner[1] != NO_URL else []
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]) + block.decode("utf-8", "replace")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of one WARC file; digests of responses are checked."""
    stream = Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.strip():
            continue
        first, *lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield headers, stream.take(int(headers["content-length"]))


def write_arc(pages: DataFrame, folder: str) -> None:
    """pages(page_id, url, html) as ARC files, of version 1 or 2 by the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name, held = part % 2 + 1, f"pages-{part:05d}.arc", 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held % FILE_RECORDS == 0:  # the writer begins a file after so many rows, and a file begins with its version block
                    out.append(arc_version_block(version, name))
                    held += 1
                out.append(arc_record(version, r["page_id"], r["url"], r["html"], name))
                held += 1
            yield _values(out)

    rows = in_batches(pages).select("page_id", "url", "html").mapInArrow(run, "value string")
    rows.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, revisit_from: int = REVISIT_FROM) -> None:
    """Read the ARC files, find the payloads that repeat, and write WARC files."""

    def metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                got = [(r["digest"], r["size"], r["page_id"], r["url"]) for r in arc_records(content) if r["size"] >= revisit_from]
                yield _batch(got, META)

    files = _files(spark, arc_folder)
    seen = files.mapInArrow(metadata, _ddl(META))
    order = F.struct(F.col("page_id").isNotNull(), "page_id", "url")
    winners = seen.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max_by(F.struct("page_id", "url"), order).alias("w")).filter("n > 1 and w.page_id is not null")
    winners = staged(winners.select("digest", F.col("w.page_id").alias("w_page"), F.col("w.url").alias("w_url")), "winners")

    def write(known: dict[str, tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content").to_pylist():
                    out = []
                    for r in arc_records(content):
                        w = known.get(r["digest"]) if r["size"] >= revisit_from else None
                        out.append(warc_record(r, w if w and w[0] != r["page_id"] else None))
                        if len(out) >= 500:
                            yield _values(out)
                            out = []
                    yield _values(out)

        return run

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                for r in arc_records(content):
                    yield _batch([tuple(r[c] for c in CUT)], CUT)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                w = (r["w_page"], r["w_url"]) if r["w_page"] is not None else None
                out.append(warc_record(r, w if w and w[0] != r["page_id"] else None))
            yield _values(out)

    if winners.count() <= BROADCAST_ROWS:
        rows = files.mapInArrow(write({r.digest: (r.w_page, r.w_url) for r in winners.collect()}), "value string")
    else:  # more repeated payloads than may be sent to every task
        cut = files.mapInArrow(split, _ddl(CUT))
        rows = cut.join(winners, "digest", "left").mapInArrow(assemble, "value string")
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(warc_folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, warc_date of every record; digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = []
                for h, block in warc_records(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    page = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
                    digest, kind, size = base64.b32decode(h["warc-payload-digest"].split(":")[1]).hex(), h["warc-type"], int(h["x-payload-length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
                    refers = h.get("x-refers-to-page-id")
                    out.append((int(page[0]) if page else None, h.get("warc-target-uri"), size, digest, kind, int(refers) if refers else None, h["warc-record-id"], h["warc-date"]))
                yield _batch(out, FOUND)

    return _files(spark, folder).mapInArrow(run, _ddl(FOUND))


def archived(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what a reader finds in these, a row for each row of pages."""
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
