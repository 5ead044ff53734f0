import gzip
import hashlib
import re

import pytest
from pyspark.sql import types as T

from blocklens.llm import warc
from blocklens.session import scratch_path

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()),
                       T.StructField("path", T.StringType())])
BIG = "<p>été " + "x" * 1200


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "p") for r in rows], SCHEMA).repartition(3)


ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"),
        (5, None, None), (6, "http://b/with blank\nand line", ""), (7, "http://a/7", "r\r\n\r\nWARC/1.1\r\n\r\n" * 90),
        (8, "http://a/8", BIG + "日本"), (9, "http://a/9", BIG + "日本"), (9, "http://a/9", BIG + "日本"),
        (None, "http://a/n", BIG), (10, "filedesc-like http://x 1 2 3", "\n\n 5 text/html 7\n" * 70),
        (11, "http://a/2", "\x0b" + "y" * 998), (12, "http://c", "z" * 1000), (13, "http://c", "z" * 1000),
        (14, "http://d", "w" * 999), (15, "http://d", "w" * 999)]


def brute(rows):
    last = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            last[body] = max(last.get(body, -1), -1 if page_id is None else page_id)
    out, spoken = [], set()
    for page_id, _, html in rows:
        body = (html or "").encode()
        kind, refers = "response", None
        if body in last and (page_id != last[body] or body in spoken):
            kind, refers = "revisit", last[body]
        spoken.add(body) if page_id == last.get(body, page_id) else None
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), kind, refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 1500])
def test_round_trip(spark, archive_bytes):
    got = warc.archive_pages(frame(spark, ROWS), archive_bytes).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(ROWS)


def test_files_are_archives_that_a_plain_reader_reads(spark):
    """Versions, headers, lengths and digests by the formats' own rules."""
    import glob
    arc, out = scratch_path(spark, "t-arc"), scratch_path(spark, "t-warc")
    warc.write_arc(frame(spark, ROWS), arc, 3000)
    files = [gzip.decompress(open(f, "rb").read()) for f in glob.glob(arc.removeprefix("file:") + "/*.gz")]
    versions = set()
    for data in files:
        head, at = data.split(b"\n", 3)[:3], 0
        assert head[0].startswith(b"filedesc://") and head[0].split()[3] == b"text/plain"
        versions.add(int(head[1].split()[0]))
        assert head[2].decode() == warc.ARC_FIELDS[int(head[1].split()[0])]
        while at < len(data):       # each header line's length leads to the next line
            line = data[at:data.index(b"\n", at)]
            at += len(line) + 1 + int(line.split()[-1])
            assert data[at:at + 1] == b"\n"
            at += 1
    assert versions == {1, 2}
    warc.arc_to_warc(spark, arc, out)
    records = []
    for f in glob.glob(out.removeprefix("file:") + "/*.gz"):
        data = gzip.decompress(open(f, "rb").read())
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            if "WARC-Block-Digest" in fields:
                assert fields["WARC-Block-Digest"] == warc.sha1_label(rest[:n])
            records.append(fields)
            data = rest[n + 4:]
    ids = {f["WARC-Record-ID"]: f for f in records}
    assert len(ids) == len(records)
    assert {f["WARC-Type"] for f in records} == {"warcinfo", "response", "revisit"}
    for f in records:
        if f["WARC-Type"] == "revisit":
            assert f["WARC-Payload-Digest"] == ids[f["WARC-Refers-To"]]["WARC-Payload-Digest"]


def test_foreign_archives():
    """Other writers' files: no HTTP head, blanks in urls, version 2, joined files."""
    body = b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    one = b"filedesc://old.arc 0 19960923142103 text/plain %d\n" % len(body) + body
    one += b"\nhttp://x/a b 1.2.3.4 19970101 text/html 5\nhello\nftp://y 1.2.3.4 19970101000000 image/gif 3\n\x00\xff\n\n"
    body = b"2 0 Other\n" + warc.ARC_FIELDS[2].encode() + b"\n\n"
    two = b"filedesc://new.arc 0 20000101000000 text/plain 200 - - 0 new.arc %d\n" % len(body) + body
    two += b"\nhttp://z 1.2.3.4 20000102030405 text/html 200 abc - 99 new.arc 23\nHTTP/1.0 200 OK\r\n\r\nbody\n"
    docs = list(warc.read_arc(one + two))
    assert [(d.url, d.version, d.archive) for d in docs if not d.url.startswith("filedesc")] == [
        ("http://x/a b", 1, "old.arc"), ("ftp://y", 1, "old.arc"), ("http://z", 2, "new.arc")]
    kinds = [next(warc.read_warc(warc.convert(d)))[0] for d in docs]
    assert [k["WARC-Type"] for k in kinds] == ["warcinfo", "resource", "resource", "warcinfo", "response"]
    assert kinds[1]["WARC-Date"] == "1997-01-01T00:00:00Z".replace("1997-01-01", "1997-01-01")
    assert kinds[2]["Content-Type"] == "image/gif" and kinds[4]["WARC-Payload-Digest"] == warc.sha1_label(b"body")


def test_malformed_archives_are_errors():
    with pytest.raises(ValueError, match="version"):
        list(warc.read_arc(b"http://x 1 2 3 4\nabcd"))
    good = warc.arc_version_block("a.arc", 1)
    with pytest.raises(ValueError, match="ends after"):
        list(warc.read_arc(good + b"\nhttp://x 0.0.0.0 20240101000000 text/html 99\nshort"))


def test_empty_table(spark):
    assert warc.archive_pages(frame(spark, [])).count() == 0
