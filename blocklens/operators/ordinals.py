"""Dense 1-based ordinals without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Instead: range-partition on the (unique) order key, sort inside partitions,
tag each row with its partition id and a ``monotonically_increasing_id``,
count rows per partition (a tiny table, one row per partition), prefix-sum the
counts, broadcast the offsets back.  The offset table is bounded by the number
of partitions, which is what makes the broadcast safe.

The tagged rows are checkpointed (reliable checkpoint in the shared folder)
before the two uses: range bounds come from sampling, and a recomputed input
(e.g. an aggregation) could be cut differently the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _offsets(tagged: DataFrame, group_cols: list[str]) -> DataFrame:
    counts = tagged.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy(*group_cols).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def dense_ordinal(df: DataFrame, order_cols: list[str], out_col: str,
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based position of each row in ``order_cols`` order.

    ``order_cols`` must identify rows uniquely (ties would make the position
    depend on shuffle arrival order).
    """
    from blocklens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = (df.repartitionByRange(int(n), *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    offsets = _offsets(ranged, ["_pid"])
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_mid") - F.col("_m0") + 1)
            .drop("_pid", "_mid", "_n", "_m0", "_off"))
