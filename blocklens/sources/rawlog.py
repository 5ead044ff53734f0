"""Raw log source (S1/S2): text lines with their physical line number.

``spark.read.text`` splits files into byte ranges that are read in parallel;
a range that starts mid-line skips to the next line start, so every physical
line belongs to exactly one range and a range is read contiguously by one
task.  Dense, 1-based line numbers then need no global sort:

1. tag every row with its range (file, range start) and a
   ``monotonically_increasing_id`` (consecutive inside a task);
2. per range: row count and smallest id -- a tiny table, one row per range;
3. prefix-sum the counts in (file, range) order (Spark broadcasts the result
   while its measured size is small, and shuffles beyond);
4. line number = lines before the range + (id - smallest id in range) + 1.

Numbers are assigned before empty lines are dropped, so they count every
physical line (``\\n``, ``\\r\\n`` and ``\\r`` all end a line).  Invalid UTF-8
is replaced by U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], drop_empty: bool = True) -> DataFrame:
    """``(line_id long, raw_content string)`` for every line of ``path``."""
    paths = [path] if isinstance(path, str) else list(path)
    scan = spark.read.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    ).withColumn("_mid", F.monotonically_increasing_id())
    ranges = scan.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # one row per byte range: a bounded table, so one window task is fine
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = scan.join(ranges.drop("_n"), ["_file", "_start"]).select(
        (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).alias("line_id"),
        F.make_valid_utf8("value").alias("raw_content"),
        F.col("_file").alias("source_file"),
    )
    if drop_empty:
        numbered = numbered.where(F.col("raw_content") != "")
    return numbered


def read_raw_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S1 with the reference's contract: ``(line_id, raw_content)``, empty
    lines skipped (whitespace-only lines kept).  Several files are numbered
    as one log, in path order; ``source_file`` tells them apart."""
    return read_lines(spark, path, drop_empty=True)


def load_head(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """The first ``limit`` non-empty lines (all when ``limit`` is None)."""
    return lines if limit is None else lines.orderBy("line_id").limit(limit)
