"""Header parsing, block ids and masking on hand-written HDFS-style lines."""
import re

import pytest
from pyspark.sql import functions as F

from blocklens.functions import parsing as P
from blocklens.operators.parse import parse_lines, parse_stats
from blocklens.operators.templates import with_masks

# (raw line, matches, block id, mask)
GOLDEN = [
    ("081109 203615 148 INFO svc.recv: recv block blk_-1608 src: /10.250.19.102:54106 "
     "dest: /10.250.19.102:50010", True, "blk_-1608",
     "recv block <BLOCK_ID> src: <IP> dest: <IP>"),
    ("081109 203615 148 INFO svc.store: wrote blk_1 blk_2 to 10.0.0.1:1 10.0.0.2:2, 10.0.0.3",
     True, "blk_1", "wrote <BLOCK_ID> <BLOCK_ID> to <IP>"),
    ("081109 203616 149 WARN svc.write: failed blk_7 java.io.IOException: reset by peer 42",
     True, "blk_7", "failed <BLOCK_ID> <EXCEPTION_DETAIL>"),
    ("081109 203616 149 WARN svc.write: failed blk_7 java.io.IOException while reading",
     True, "blk_7", "failed <BLOCK_ID> java.io.IOException while reading"),
    ("081109 203617 1 INFO svc.hb: heartbeat 5 ok x12", True, None, "heartbeat <NUM> ok x12"),
    ("081109 203617 1 INFO svc.list: hosts /1.1.1.1, /2.2.2.2", True, None, "hosts <IP>, <IP>"),
    ("081109 203617 1 INFO svc.recv recv block blk_9 src: /1.1.1.1:5 done", True, None,
     "<IP> done"),
    ("081109 203617 1 INFO svc.q: a/b 3.5 v2 10.0.0.1x 7ms", True, None,
     "a/b <NUM>.<NUM> v2 <IP>x 7ms"),
    ("081109 203617 1 INFO svc.x: ", True, None, ""),
    ("081109 203617 1 INFO svc.x:", False, None, None),
    ("81109 203617 1 INFO svc.x: short date", False, None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([(i + 1, g[0]) for i, g in enumerate(GOLDEN)],
                                  "line_id long, raw_content string")
    return {r["line_id"]: r for r in with_masks(parse_lines(lines)).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_line(parsed, i):
    raw, matches, blk, mask = GOLDEN[i]
    row = parsed.get(i + 1)
    assert (row is not None) == matches
    if matches:
        assert row["block_id"] == blk
        assert row["template"] == mask


def test_header_fields(parsed):
    r = parsed[1]
    assert (r["event_date"], r["event_time"], r["pid"], r["level"], r["component"]) == \
        ("081109", "203615", "148", "INFO", "svc.recv")
    assert r["event_ts"] is not None
    # greedy component: a line without ': ' after the component matches later
    assert parsed[7]["component"] == "svc.recv recv block blk_9 src"


def test_same_as_python_re(parsed):
    """The Java patterns give what Python's re gives on the golden lines."""
    head = re.compile(P.HEADER_PATTERN)
    for i, (raw, *_rest) in enumerate(GOLDEN):
        m = head.match(raw)
        assert (m is not None) == ((i + 1) in parsed)
        if m:
            content = m.group(6)
            masked = content
            for pat, tok in P.MASKS:
                masked = re.sub(pat, tok, masked)
            assert " ".join(masked.split()) == parsed[i + 1]["template"]


def test_parse_stats(spark):
    lines = spark.createDataFrame([(i + 1, g[0]) for i, g in enumerate(GOLDEN)],
                                  "line_id long, raw_content string")
    s = parse_stats(lines, with_templates=True).first()
    assert s["n_processed"] == 9 and s["n_unmatched"] == 2
    assert s["n_with_block"] == 4
    assert s["n_templates"] == 9


def test_block_id_first_occurrence(spark):
    df = spark.createDataFrame([("x blk_5 y blk_-6",), ("none",)], "c string")
    got = [r[0] for r in df.select(P.block_id(F.col("c"))).collect()]
    assert got == ["blk_5", None]


def test_limit_counts_matched_lines_only(spark):
    lines = spark.createDataFrame([(i + 1, g[0]) for i, g in enumerate(GOLDEN)],
                                  "line_id long, raw_content string")
    got = [r["line_id"] for r in parse_lines(lines, limit=3).collect()]
    assert sorted(got) == [1, 2, 3]
    # lines 10 and 11 do not match, so the last 9 matched lines are 1..9
    assert sorted(r["line_id"] for r in parse_lines(lines, limit=20).collect()) == \
        list(range(1, 10))
