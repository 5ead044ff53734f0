"""Legacy archive converter: ARC files to WARC files, and both ways of reading.

An ARC file opens with a version block that says how its header lines are
laid out (version 1: five fields, version 2: ten) and then holds documents,
each behind a header line that declares its length.  The converter follows
these lengths and synthesises what WARC asks for beyond them: record
identifiers, ISO timestamps, record types, content types and SHA-1 digests.

Spark reads and writes every archive, so archives can be in any store it
reaches: an archive is a file of its own, gzip-compressed, and bounded by
``ARCHIVE_BYTES`` and by its largest document.

Duplicates: a first reading lists each record's payload digest and length.
Digests are grouped (pre-aggregated in every task), and what must become a
revisit goes back to its archive by name; payloads are never shuffled by digest.

Defined results: null html counts as empty; a null page_id is written without
its header line, sorts below any other and is null when read back; of rows
equal in page_id and payload one is the response; null urls become
``urn:page:<page_id>``; blanks in urls are percent-encoded; an empty table
writes nothing and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import map_frames, session, stage
from blocklens.session import scratch_path

ARCHIVE_BYTES = 32 << 20
#: payloads below this are never turned into revisits
REVISIT_BYTES = 1000
CAPTURED = "20240101000000"

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


# --- ARC ------------------------------------------------------------------------


def arc_version_block(name: str, version: int, captured: str = CAPTURED) -> bytes:
    body = f"{version} 0 blocklens\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", captured, "text/plain", len(body), name) + body


def arc_header(version: int, url: str, captured: str, kind: str, length: int, name: str,
               offset: int = 0) -> bytes:
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} 0.0.0.0 {captured} {kind}{middle} {length}\n".encode()


def arc_document(version: int, page_id, url: str | None, html: bytes, name: str, offset: int,
                 captured: str = CAPTURED) -> bytes:
    """One document as a crawler stores it: the HTTP response behind a header line."""
    known = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(html)}\r\n{known}\r\n").encode()
    if not url:
        url = f"urn:page:{page_id}"
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    return arc_header(version, url, captured, "text/html", len(head) + len(html), name,
                      offset) + head + html


@dataclass
class ArcDocument:
    """A document as its header line describes it."""
    url: str
    captured: str
    kind: str
    content: bytes
    archive: str
    offset: int
    version: int

    @property
    def record_id(self) -> str:
        key = f"{self.archive} {self.offset} {self.url} {self.captured}"
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}"

    @property
    def date(self) -> str:
        d = self.captured.ljust(14, "0")
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    @property
    def is_http(self) -> bool:
        return self.content.startswith(b"HTTP/")

    def split(self) -> tuple[bytes, bytes]:
        """(HTTP head, payload); without an HTTP head the content is the payload."""
        if not self.is_http:
            return b"", self.content
        head, mark, payload = self.content.partition(b"\r\n\r\n")
        return head + mark, payload


def read_arc(data: bytes) -> Iterator[ArcDocument]:
    """The documents of an ARC file, its version blocks (``filedesc:``) included."""
    at, version, archive = 0, 0, ""
    while at < len(data):
        if data[at:at + 1] == b"\n":        # the separator before a document
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if line.startswith("filedesc://"):
            version = int(data[end + 1:data.index(b"\n", end + 1)].split()[0])
            archive = line[len("filedesc://"):].split(" ", 1)[0]
        if version not in ARC_FIELDS:
            raise ValueError(f"no known ARC version before offset {at}")
        # the url may hold blanks, the other fields do not
        fields = line.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
        if line.startswith("filedesc://") and not fields[-1].isdigit() or len(fields) < 5:
            raise ValueError(f"malformed ARC header at offset {at}: {line[:200]!r}")
        length = int(fields[-1])
        if end + 1 + length > len(data):
            raise ValueError(f"the document at offset {at} ends after its archive")
        yield ArcDocument(fields[0], fields[2], fields[3], data[end + 1:end + 1 + length],
                          archive, at, version)
        at = end + 1 + length


def _write_archives(frame: DataFrame, path: str, separator: str) -> None:
    """One file for each row; ``separator`` closes it."""
    (frame.select(F.col("archive").cast("string")).write
     .option("maxRecordsPerFile", 1).option("lineSep", separator)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive file below ``path``, still compressed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(
        "path", "content")


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as ARC files, versions 1 and 2 in turn."""
    session(pages)

    def run(frames):
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for frame in frames:
            for page_id, url, html in zip(frame["page_id"], frame["url"], frame["html"]):
                version = 1 + (task + number) % 2
                name = f"pages-{task:06d}-{number:06d}.arc"
                if not held:
                    held = [arc_version_block(name, version)]
                    size = len(held[0]) + 1
                own = arc_document(version, None if pd.isna(page_id) else int(page_id), url,
                                   html.encode(), name, size)
                held.append(own)
                size += len(own) + 1
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [b"\n".join(held)]})
                    held, number = [], number + 1
        if held:
            yield pd.DataFrame({"archive": [b"\n".join(held)]})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    _write_archives(map_frames(rows, run, "archive binary"), path, "\n")


# --- WARC -----------------------------------------------------------------------


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without the blank lines that end it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def convert(document: ArcDocument, refers: dict | None = None) -> bytes:
    """The WARC record that is equivalent to an ARC document.

    ``refers`` (record_id, url, date) makes it a revisit of that record.
    """
    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<{document.record_id}>",
              "WARC-Date": document.date}
    if document.url.startswith("filedesc://"):
        fields |= {"WARC-Type": "warcinfo", "WARC-Filename": document.archive + ".warc",
                   "Content-Type": "application/warc-fields"}
        return warc_record(fields, f"software: blocklens\r\nformat: WARC File Format 1.1\r\n"
                                   f"description: converted from ARC version {document.version}\r\n"
                           .encode())
    head, payload = document.split()
    fields |= {"WARC-Target-URI": document.url, "WARC-Payload-Digest": sha1_label(payload)}
    block = document.content
    if refers:
        block = head
        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE,
                   "WARC-Refers-To": f"<{refers['record_id']}>",
                   "WARC-Refers-To-Target-URI": refers["url"],
                   "WARC-Refers-To-Date": refers["date"]}
    elif not document.is_http:
        fields["WARC-Type"] = "resource"
    fields["Content-Type"] = ("application/http; msgtype=response" if document.is_http
                              else document.kind)
    fields["WARC-Block-Digest"] = sha1_label(block)
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length


def _page_id(head: bytes) -> int | None:
    for line in head.decode("latin-1").split("\r\n"):
        if line.startswith(PAGE_HEADER + ": "):
            return int(line.split(": ", 1)[1])
    return None


_LISTED = ("path string, record_id string, url string, date string, page_id long, "
           "payload_bytes long, digest string")


def _list_documents(frames):
    """Archives -> one row for each document: its identity, payload length and digest."""
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            rows = []
            for d in read_arc(gzip.decompress(content)):
                if not d.url.startswith("filedesc://"):
                    head, payload = d.split()
                    rows.append((path, d.record_id, d.url, d.date, _page_id(head), len(payload),
                                 hashlib.sha1(payload).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "record_id", "url", "date", "page_id",
                                              "payload_bytes", "digest"], dtype=object)


def _convert_archives(frames):
    for frame in frames:
        for content, revisits in zip(frame["content"], frame["revisits"]):
            known = {r["own"]: r for r in (revisits if revisits is not None else ())}
            yield pd.DataFrame({"archive": [b"\r\n\r\n".join(
                [convert(d, known.get(d.record_id)) for d in read_arc(gzip.decompress(content))])]})


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str,
                revisit_bytes: int = REVISIT_BYTES) -> None:
    """Convert every ARC file below ``arc_path``; equal payloads become revisits."""
    listed = stage(map_frames(read_archives(spark, arc_path), _list_documents, _LISTED), "arc-list")
    large = listed.where(F.col("payload_bytes") >= revisit_bytes)
    last = F.max(F.struct("page_id", "record_id", "url", "date")).alias("last")
    groups = stage(large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), last)
                   .where("n > 1").select("digest", "last"), "arc-groups")
    again = large.join(groups.hint("merge"), "digest").where(
        F.col("record_id") != F.col("last.record_id"))
    per_file = again.groupBy("path").agg(F.collect_list(F.struct(
        F.col("record_id").alias("own"), F.col("last.record_id").alias("record_id"),
        F.col("last.url").alias("url"), F.col("last.date").alias("date"))).alias("revisits"))
    archives = read_archives(spark, arc_path).join(stage(per_file, "arc-revisits"), "path", "left")
    _write_archives(archives.select("content", "revisits").mapInPandas(
        _convert_archives, "archive binary"), warc_path, "\r\n\r\n")


_RECORDS = ("record_id string, record_type string, url string, date string, page_id long, "
            "payload_bytes long, payload_digest string, refers_to_id string")


def _read_records(frames):
    """WARC files -> one row for each response, resource or revisit; checks digests."""
    for frame in frames:
        rows = []
        for content in frame["content"]:
            for fields, block in read_warc(gzip.decompress(content)):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                head, mark, payload = block.partition(b"\r\n\r\n")
                if not block.startswith(b"HTTP/"):
                    head, payload = b"", block
                digest = fields["WARC-Payload-Digest"]
                if fields["WARC-Type"] == "revisit":
                    declared = [line.split(b": ", 1)[1] for line in head.split(b"\r\n")
                                if line.startswith(b"Content-Length: ")]
                    size = int(declared[0]) if declared else None
                else:
                    size = len(payload)
                    if sha1_label(payload) != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not that "
                                         "of its digest")
                rows.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"],
                             fields["WARC-Target-URI"], fields["WARC-Date"], _page_id(head), size,
                             base64.b32decode(digest.split(":")[1]).hex(),
                             fields.get("WARC-Refers-To", "<>")[1:-1] or None))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORDS.split(", ")], dtype=object)


def read_warc_records(spark: SparkSession, path: str) -> DataFrame:
    return map_frames(read_archives(spark, path), _read_records, _RECORDS)


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES,
                  revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC read back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to, record_id, url), one row per page."""
    spark = session(pages)
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, archive_bytes)
    if pages.isEmpty():
        records = spark.createDataFrame([], _RECORDS)
    else:
        arc_to_warc(spark, arc, warc, revisit_bytes)
        records = stage(read_warc_records(spark, warc), "warc-records")
    targets = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(targets, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url")
