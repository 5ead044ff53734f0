"""Stand-in inputs derived by Spark from the driver tables.

The driver ships no raw HDFS log, so a log is *derived* from ``events``: one
line per event, in the same header layout as the HDFS logs, with block ids,
IP lists, exceptions, malformed headers and block-less lines.  Blocks are
labelled from their own content and detector outputs are derived from
``labels``.  Every view is a narrow projection/aggregation of the driver
tables, so its size grows with them.  The DuckDB text of the same views is in
:mod:`blocklens.plans.oracle`; both must stay byte-identical.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _block_of_event() -> Column:
    uid = F.col("user_id")
    day_b = F.dayofmonth("ts") + F.lit(100) * uid
    return F.concat(F.lit("blk_"), _s(F.when(uid % 2 == 0, -day_b).otherwise(day_b)))


def log_lines_from_events(events: DataFrame) -> DataFrame:
    """``(line_id long, raw_content string)``: one HDFS-style line per event."""
    eid, uid, etype = F.col("event_id"), F.col("user_id"), F.col("event_type")
    blk = _block_of_event()
    subnet = _s(uid % 256)
    body = (
        F.when(eid % 97 == 0, F.concat(F.lit("heartbeat "), _s(eid), F.lit(" ok")))
        .when(etype == "view", F.concat(
            F.lit("recv block "), blk, F.lit(" src: /10.0."), subnet, F.lit(".1:"),
            _s(uid + 5000), F.lit(" dest: /10.0."), subnet, F.lit(".2:50010")))
        .when(etype == "click", F.concat(
            F.lit("responder "), _s(eid % 3), F.lit(" for block "), blk, F.lit(" closing")))
        .when(etype == "purchase", F.concat(
            F.lit("stored block "), blk, F.lit(" size "), _s(eid * 7),
            F.lit(" at 10.0.0.1:1 10.0.0.2:2, 10.0.0.3")))
        .when(etype == "signup", F.concat(F.lit("verify ok for "), blk))
        .when(etype == "error", F.concat(
            F.lit("write failed "), blk, F.lit(" java.io.IOException: reset "), _s(eid)))
    )
    level = F.when(etype == "error", F.lit("WARN")).otherwise(F.lit("INFO"))
    header = F.concat_ws(" ", F.date_format("ts", "yyMMdd"), F.date_format("ts", "HHmmss"),
                         _s(uid), level, F.concat(F.lit("svc."), etype))
    sep = F.when(eid % 101 == 0, F.lit(" ")).otherwise(F.lit(": "))
    return events.select(
        (eid + 1).alias("line_id"),
        F.concat(header, sep, body).alias("raw_content"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return log_lines_from_events(events.repartition(spark.sparkContext.defaultParallelism))


def block_labels_from_parsed(parsed: DataFrame) -> DataFrame:
    """``(block_id, label)``: Anomaly iff the block has >= 2 'write failed'
    lines; blocks whose number is a multiple of 50 stay unlabelled."""
    keyed = parsed.where(F.col("block_id").isNotNull())
    counted = keyed.groupBy("block_id").agg(
        F.count_if(F.col("content").startswith("write failed ")).alias("n_failed"))
    number = F.abs(F.substring("block_id", 5, 64).cast("long"))
    return counted.where(number % 50 != 0).select(
        "block_id",
        F.when(F.col("n_failed") >= 2, F.lit("Anomaly")).otherwise(F.lit("Normal")).alias("label"),
    )


def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blocklens.operators.parse import parse_lines
    return block_labels_from_parsed(parse_lines(log_lines(spark, sf_dir)))


def _base_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction for each log block that a labelled document's event (the
    event with its number) belongs to; the smallest document speaks for it."""
    labels = read_table(spark, sf_dir, "labels")
    events = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), _block_of_event().alias("block_id"))
    one = labels.join(events, "doc_id").groupBy("block_id").agg(
        F.min_by(F.struct("doc_id", "quality", "toxic"), "doc_id").alias("d"))
    doc = F.col("doc_id")
    return one.select("block_id", "d.*").select(
        "block_id",
        F.when(doc % 37 == 0, F.lit(None).cast("string"))
        .when(F.col("quality") == 0, F.lit("Anomaly")).otherwise(F.lit("Normal"))
        .alias("classification"),
        F.when(F.col("toxic") == 1, F.lit("Anomaly")).otherwise(F.lit("Normal")).alias("label"),
        doc,
    )


def if_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation-forest shaped predictions: decision score in [-0.5, 0.5]."""
    base = _base_predictions(spark, sf_dir)
    return base.select(
        "block_id",
        (F.lit(0.5) - (F.col("doc_id") % 101) / F.lit(100.0)).alias("score"),
        "classification", "label",
        ((F.col("doc_id") % 7 + 1) / F.lit(1048576.0)).alias("inference_time_sec"),
    )


def rf_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-forest shaped predictions: P(Anomaly) in [0, 1]."""
    base = _base_predictions(spark, sf_dir)
    return base.select(
        "block_id",
        ((F.col("doc_id") % 101) / F.lit(100.0)).alias("anomaly_probability"),
        "classification", "label",
        ((F.col("doc_id") % 5 + 1) / F.lit(4194304.0)).alias("inference_time_sec"),
    )


def llm_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-classifier shaped predictions: confidence as raw text, written
    either as a fraction ('0.07'), a percentage ('7%') or not at all."""
    base = _base_predictions(spark, sf_dir)
    doc = F.col("doc_id")
    pct = _s(doc % 101)
    frac = F.concat(F.lit("0."), F.lpad(_s(doc % 100), 2, "0"))
    conf = (F.when(doc % 11 == 0, F.lit(None).cast("string"))
            .when(doc % 13 == 0, F.lit("high"))
            .when(doc % 2 == 0, F.concat(pct, F.lit("%")))
            .otherwise(frac))
    return base.select(
        "block_id", "classification",
        F.when(F.col("classification").isNull(), F.lit(None).cast("string"))
        .otherwise(conf).alias("confidence"),
        F.concat(F.lit("rule "), _s(doc % 3)).alias("explanation"),
        F.when(F.col("classification").isNull(), F.lit(3)).otherwise((doc % 3 + 1).cast("int"))
        .alias("attempts"),
        F.col("classification").isNull().alias("parse_failed"),
        "label",
        ((doc % 9 + 1) * F.lit(0.5)).alias("inference_time_sec"),
    )


def predictions(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return {
        "isolation_forest": if_predictions,
        "random_forest": rf_predictions,
        "llm": llm_predictions,
    }[model](spark, sf_dir)


# --- fixed values: the shapes of model answers (%d stands for a number) ---------
ANSWER_SHAPES = (
    'ok {"classification":"NORMAL","confidence":0.9} end',
    '{" Classification ":" anomaly ","confidence":"%d%"}',
    '{"classification":"ANÔMALO"}',
    '{"classification":"anomalo","explanation":"case %d"}',
    '{"classification":"anomalous"}',
    '{"classification":1}',
    '{"classification":["NORMAL"]}',
    '{"label":"NORMAL"}',
    'no braces in answer %d',
    "{'classification':'NORMAL'}",
    '{"classification":"NORMAL"} {"a":1}',
    '{"Classification":"NORMAL","classification":"ANOMALY"}',
    '```json\n{\n "classification": "normal"\n}\n```',
    '{"classification":"NORMAL"}, {"a":1}',
    '',
)
# --------------------------------------------------------------------------------


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(block_id, attempt, raw_answer)``: recorded answers of three attempts for
    every block with a prediction, in the shapes above."""
    doc = F.col("doc_id")
    shapes = F.array(*[F.lit(x) for x in ANSWER_SHAPES])
    base = _base_predictions(spark, sf_dir).select(
        "block_id", "doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    shape = F.element_at(shapes, (((doc + F.lit(4) * (F.col("attempt") - 1)) % len(ANSWER_SHAPES)) + 1)
                         .cast("int"))
    return base.select("block_id", "attempt",
                       F.replace(shape, F.lit("%d"), _s(doc % 100)).alias("raw_answer"))
