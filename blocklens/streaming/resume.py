"""Resumable classification as a stream.

Blocks arrive as files; every micro-batch is answered and written to a folder
of its own, then the stream commits it.  A run that dies before its folder is
complete answers the batch again; one that dies between folder and commit finds
the folder complete and asks nothing twice.  So every block is answered once
over any number of restarts, and the answers are read while the stream runs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.plans.stages import is_complete


def answer_sink(out: str, classify, after=None):
    """``foreachBatch`` body: writes ``classify(batch)`` unless it is there.

    ``after(batch_id)`` runs between the answer and the commit."""
    def write(batch: DataFrame, batch_id: int) -> None:
        folder = os.path.join(out, f"batch_id={batch_id}")
        if is_complete(batch.sparkSession, folder):
            # answered by a run that died before its commit; the batch only moves the state on
            batch.write.format("noop").mode("overwrite").save()
        else:
            classify(batch).write.mode("overwrite").parquet(folder)
        if after:
            after(batch_id)
    return write


def classify_stream(blocks: DataFrame, out: str, checkpoint: str, classify, after=None, key: str = "block_id"):
    """Run the stream ``blocks`` to the end of what there is now; the query.

    A block that arrives again is not answered again: ids that were seen are
    kept as state of the stream.
    """
    return (blocks.dropDuplicates([key]).writeStream.outputMode("append")
            .foreachBatch(answer_sink(out, classify, after))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    """The answers of all complete batches."""
    return spark.read.parquet(out).drop("batch_id")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Files arriving in the folders of ``path`` as a stream of bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def in_parts(rows: DataFrame, parts: int, key: str = "block_id") -> DataFrame:
    """``rows`` dealt by key, so that they are written as ``parts`` files."""
    return rows.repartition(parts, F.col(key))
