"""Label sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_COL, LABEL_COL = "BlockId", "Label"


class SchemaError(ValueError):
    pass


def load_labels(spark: SparkSession, path: str, key_col: str = KEY_COL,
                label_col: str = LABEL_COL) -> DataFrame:
    """S3: read a label CSV with a header; header names are stripped; the key
    and label columns must be present.  Returns ``(block_id, label)``.

    All columns are read as strings (no schema inference pass over the data).
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    renamed = raw.toDF(*[c.strip() for c in raw.columns])
    missing = {key_col, label_col} - set(renamed.columns)
    if missing:
        raise SchemaError(
            f"expected columns {sorted({key_col, label_col})}, found {renamed.columns}")
    return renamed.select(F.col(key_col).alias("block_id"), F.col(label_col).alias("label"))


def labels_lookup(rows: DataFrame, order_col: str) -> DataFrame:
    """One label per key, the row that comes *last* in ``order_col`` wins.

    ``max_by`` is a partial (map-side) aggregate, so a key repeated millions of
    times never gathers its rows in one place.
    """
    return rows.groupBy("block_id").agg(F.max_by("label", order_col).alias("label"))


def load_labels_with_order(spark: SparkSession, path: str, key_col: str = KEY_COL,
                           label_col: str = LABEL_COL) -> DataFrame:
    """Label rows plus their physical order (for :func:`labels_lookup`).

    The CSV reader takes quoted fields and each file's header; the order is that
    of files by path and of rows within them (the reader's own row ids).
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = [c.strip() for c in raw.columns]
    if key_col not in names or label_col not in names:
        raise SchemaError(f"expected columns {[key_col, label_col]}, found {names}")
    tagged = raw.toDF(*names).select(
        F.col(key_col).alias("block_id"), F.col(label_col).alias("label"),
        F.struct(F.input_file_name(), F.input_file_block_start(),
                 F.monotonically_increasing_id()).alias("row_order"))
    return tagged
