"""Dense physical line numbers from the text source."""
import os

from blocklens.sources.rawlog import read_raw_log


def test_line_ids_and_endings(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.log")
    with open(p, "wb") as f:
        f.write(b"l1 a\r\nl2 \xff b\n\nl4 c\rl5 d\n")
    rows = read_raw_log(spark, p).orderBy("line_id").collect()
    assert [r["line_id"] for r in rows] == [1, 2, 4, 5]
    assert rows[0]["raw_content"] == "l1 a"
    assert "�" in rows[1]["raw_content"]
    assert rows[3]["raw_content"] == "l5 d"


def test_line_ids_across_many_splits(spark, tmp_dir):
    """A file cut into many byte ranges still gets exact line numbers."""
    p = os.path.join(tmp_dir, "big.log")
    lines = [("" if i % 17 == 0 else f"line {i} " + "x" * (i % 50)) for i in range(1, 5001)]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_raw_log(spark, p)
        assert df.rdd.getNumPartitions() > 10
        got = {r["line_id"]: r["raw_content"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {i: s for i, s in enumerate(lines, start=1) if s}
    assert got == want


def test_whitespace_only_lines_kept(spark, tmp_dir):
    p = os.path.join(tmp_dir, "w.log")
    with open(p, "w") as f:
        f.write("a\n   \n\nb\n")
    rows = read_raw_log(spark, p).orderBy("line_id").collect()
    assert [(r["line_id"], r["raw_content"]) for r in rows] == [(1, "a"), (2, "   "), (4, "b")]
