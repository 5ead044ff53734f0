"""Text-model detector: prompt -> answer -> class, with retries.

The model is the caller's *backend*: ``backend(prompt: Column, temperature) ->
Column`` of raw answers (an Arrow-batched function that calls a service, or a
lookup).  Answers are parsed by JVM expressions.  Every attempt is a stage of
its own: its answers are written once, and only the blocks still without a
class are asked again at the next temperature.

Answers that were recorded before (block, attempt, text) need no backend:
:func:`classify_recorded` settles them in one aggregation.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.text import answer_fields, format_prompt
from blocklens.session import scratch_path

# --- fixed values -------------------------------------------------------------
TEMPERATURES = (0.0, 0.3, 0.5)
# -----------------------------------------------------------------------------

# Our own prompt wording (the single slot is filled with the text sequence).
PROMPT_TEMPLATE = (
    "You classify event sequences of a distributed file system.\n"
    "Routine replication, deletion of surplus replicas and isolated network "
    "errors during transfers are normal.\n"
    "Decide whether the sequence below is NORMAL or ANOMALY and answer with a "
    "single JSON object with the keys classification, confidence and explanation.\n\n"
    "Sequence:\n{sequence}\n"
)

Backend = Callable[[Column, float], Column]

RESULT = ("block_id", "classification", "confidence", "explanation", "attempts", "parse_failed",
          "label", "inference_time_sec")


def build_prompts(texts: DataFrame, template: str = PROMPT_TEMPLATE) -> DataFrame:
    """``(block_id, prompt, label)`` from ``(block_id, text_sequence, label)``."""
    return texts.select("block_id", format_prompt(template, F.col("text_sequence"))
                        .alias("prompt"), "label")


def classify(texts: DataFrame, backend: Backend, template: str = PROMPT_TEMPLATE,
             temperatures=TEMPERATURES) -> DataFrame:
    """Classify every row of ``(block_id, text_sequence, label)``.

    ``inference_time_sec`` is the time of the attempts that a block took part
    in, shared evenly among the blocks of each.
    """
    spark = texts.sparkSession
    left = build_prompts(texts, template).withColumn("spent", F.lit(0.0))
    out = None
    for k, temperature in enumerate(temperatures, start=1):
        path, began = scratch_path(spark, f"answers-{k}"), time.perf_counter()
        left.withColumn("raw_answer", backend(F.col("prompt"), temperature)).write.parquet(path)
        asked = spark.read.parquet(path)
        share = (time.perf_counter() - began) / max(1, asked.count())
        asked = asked.withColumn("spent", F.col("spent") + F.lit(share)).withColumn(
            "a", answer_fields(F.col("raw_answer")))
        last = k == len(temperatures)
        done = asked if last else asked.where("a.classification is not null")
        found = F.col("a.classification").isNotNull()
        part = done.select(
            "block_id", "a.classification", F.when(found, F.col("a.confidence")).alias("confidence"),
            F.when(found, F.col("a.explanation")).alias("explanation"),
            F.lit(k).alias("attempts"), (~found).alias("parse_failed"), "label",
            F.col("spent").alias("inference_time_sec"))
        out = part if out is None else out.unionByName(part)
        left = asked.where("a.classification is null").drop("raw_answer", "a")
    return out


def classify_recorded(blocks: DataFrame, answers: DataFrame,
                      attempts: int = len(TEMPERATURES)) -> DataFrame:
    """D7 over recorded answers ``(block_id, attempt, raw_answer)``: a block's
    class is that of its first attempt with one, else it counts as failed.
    ``blocks`` is (block_id, label)."""
    parsed = answers.where(F.col("attempt") <= attempts).select(
        "block_id", "attempt", answer_fields(F.col("raw_answer")).alias("a"))
    first = parsed.where("a.classification is not null").groupBy("block_id").agg(
        F.min_by(F.struct("attempt", "a.classification", "a.confidence", "a.explanation"),
                 "attempt").alias("f"))
    return blocks.select("block_id", "label").join(first, "block_id", "left").select(
        "block_id", "f.classification", "f.confidence", "f.explanation",
        F.coalesce("f.attempt", F.lit(attempts)).alias("attempts"),
        F.col("f.classification").isNull().alias("parse_failed"), "label")


def failure_count(preds: DataFrame) -> DataFrame:
    """D9."""
    return preds.agg(F.count_if("parse_failed").alias("n_parse_failed"),
                     F.count(F.lit(1)).alias("n_total"))
