"""Structured Streaming variants.

The batch operators are plain DataFrame functions, so the same code runs on a
streaming DataFrame:

* E1 :func:`parse_stream` -- lines -> parse -> mask -> stream-static join with
  a frozen template table.  Masks without a template keep a NULL event id;
  :func:`unseen_mask_sink` writes them to a side table for the next mining run.
* E2 :func:`block_sessions` -- per-block activity sessions
  (``session_window``), late data bounded by a watermark.
* E3 :func:`level_rates` -- tumbling / sliding window counts per level;
  :func:`severity_rates` -- alerts per severity and window, a second stateful
  operator behind the sessions of the same query.
* E4 :func:`idempotent_alert_sink` -- ``foreachBatch`` writer that replaces
  the output of a batch id, so a replayed micro-batch after a failure cannot
  duplicate alerts.

State is bounded by the watermark: aggregates are written in ``append`` mode,
once, when their window is closed.  A bounded run (:func:`run_bounded`) ends
with a sentinel line far in the future, which closes all that is open, so its
result equals the batch query.  Checkpoints go below the shared folder.
"""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from blocklens.operators import parse as parse_ops
from blocklens.operators import templates as tpl_ops
from blocklens.session import scratch_path
from blocklens.sources import fixtures

WATERMARK = "1 day"
SESSION_GAP = "30 minutes"
RATE_WINDOW = "1 hour"
ALERT_WINDOW, ALERT_SLIDE = "1 hour", "30 minutes"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table of ``sf_dir`` as a file stream."""
    schema = fixtures.read_table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw log text files arriving in ``path``; ``line_id`` is unknown in a
    stream, so the arrival order id is not kept (event time orders rows)."""
    return spark.readStream.text(path).select(
        F.lit(None).cast("long").alias("line_id"), F.col("value").alias("raw_content"))


def parse_stream(lines: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Parsed, masked lines with their event id (NULL if unseen)."""
    masked = tpl_ops.with_masks(parse_ops.parse_lines(lines))
    if templates is None:
        return masked
    # static side: one row per template; the planner broadcasts it from its
    # file size when it is small
    lookup = templates.select(F.col("event_template").alias("template"), "event_id")
    return masked.join(lookup, "template", "left")


def unseen_mask_sink(path: str):
    """``foreachBatch`` body that counts the masks without a template and
    writes them to ``path``, one folder per micro-batch (replaced on replay)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        unseen = batch.where(F.col("event_id").isNull()).groupBy("template").agg(
            F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("first_ts"))
        unseen.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


def read_unseen_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("template").agg(F.sum("n").alias("n"))


def level_rates(parsed: DataFrame, window: str = RATE_WINDOW, slide: str | None = None,
                watermark: str = WATERMARK) -> DataFrame:
    """Line counts per (time window, level)."""
    w = F.window("event_ts", window, slide) if slide else F.window("event_ts", window)
    return (parsed.withWatermark("event_ts", watermark)
            .groupBy(w.alias("w"), "level").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "level", "n"))


def block_sessions(parsed: DataFrame, gap: str = SESSION_GAP,
                   watermark: str = WATERMARK) -> DataFrame:
    """Per block, sessions of activity separated by ``gap`` of silence."""
    keyed = parsed.where(F.col("block_id").isNotNull())
    return (keyed.withWatermark("event_ts", watermark)
            .groupBy(F.session_window("event_ts", gap).alias("s"), "block_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("block_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n"))


def windowed_sessions(parsed: DataFrame, gap: str = SESSION_GAP, watermark: str = WATERMARK,
                      *aggs) -> DataFrame:
    """E2 with the window itself: (session, block_id, n_events, ...).  The window
    carries the event time on, so a further time window can follow in the same
    query."""
    keyed = parsed.where(F.col("block_id").isNotNull())
    return keyed.withWatermark("event_ts", watermark).groupBy(
        F.session_window("event_ts", gap).alias("session"), "block_id").agg(
        F.count(F.lit(1)).alias("n_events"), *aggs)


def severity_rates(sessions: DataFrame, window: str = ALERT_WINDOW, slide: str | None = ALERT_SLIDE) -> DataFrame:
    """Alerts per (sliding window, severity).

    ``sessions`` (session, severity, ...) are the alerts, one row per session
    that was found anomalous; a session counts where it ends.  On a stream this
    is the second stateful operator of the query: sessions reach it when the
    watermark closes them, and it writes a window once no open session can
    still end in it.
    """
    at = F.window_time("session")
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return sessions.groupBy(w.alias("w"), "severity").agg(F.count(F.lit(1)).alias("n_alerts")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "severity", "n_alerts")


def graded_sessions(sessions: DataFrame, graded: DataFrame) -> DataFrame:
    """Sessions of blocks that stored alerts (block_id, severity) name (stream-static join)."""
    return sessions.join(graded.select("block_id", "severity"), "block_id")


def scored_sessions(parsed: DataFrame, decision, feature_names: list[str], gap: str = SESSION_GAP,
                    watermark: str = WATERMARK) -> DataFrame:
    """Sessions that a frozen isolation forest finds anomalous, scored inside the
    stream from their event counts: (session, block_id, n_events, score, severity)."""
    from blocklens.functions import scores as S
    from blocklens.operators.iforest import class_of_score, features_array
    counts = [F.count_if(F.col("event_id") == int(n[1:])).alias(n) for n in feature_names]
    sessions = windowed_sessions(parsed, gap, watermark, *counts)
    scored = sessions.withColumn("decision", decision(features_array(sessions, feature_names)))
    norm = S.normalize_isolation_score(F.col("decision"))
    return scored.where(class_of_score(F.col("decision")) == "Anomaly").select(
        "session", "block_id", "n_events", S.round_score(norm).alias("score"),
        S.severity(norm).alias("severity"))


def observed_totals(query, name: str) -> dict[str, int]:
    """Line counts of all micro-batches of a query over :func:`blocklens.operators.parse.observed_lines`."""
    rows = [p.observedMetrics[name] for p in query.recentProgress if name in p.observedMetrics]
    return {c: sum(r[c] for r in rows) for c in ("n_lines", "n_processed", "n_unmatched")}


#: block of the line that ends a bounded run; its own windows stay open
SENTINEL_BLOCK = "blk_0"


def run_bounded(lines: DataFrame, build, name: str, sink=None) -> DataFrame | None:
    """Stream a bounded set of lines through ``build`` (lines stream -> appended
    rows) to its end and read the result.

    The lines go to a folder as files, and the pass that writes them observes
    their latest time; a sentinel line later than any watermark and gap is added
    as the last file.  One query takes the lines as its first micro-batch and
    the sentinel, which closes every window, as its second.  ``sink(path)``
    gives the ``foreachBatch`` body (default: one folder per micro-batch).
    """
    spark = lines.sparkSession
    folder = scratch_path(spark, f"stream-{name}")
    seen = Observation(f"lines of {name}")
    parse_ops.observed_lines(lines, seen).write.parquet(folder + "/in/data")
    last = seen.get["last"]
    files = max(1, len(spark.read.schema(lines.schema).parquet(folder + "/in/data").inputFiles()))
    if last is not None:
        stamp = (last + timedelta(days=3)).strftime("%y%m%d %H%M%S")
        end = f"{stamp} 0 END sentinel: end of input {SENTINEL_BLOCK}"
        spark.createDataFrame([(None, end)], "line_id long, raw_content string").coalesce(1) \
            .write.parquet(folder + "/in/end")
    out = folder + "/out"
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(folder + "/in/*")
    query = (build(stream).writeStream.outputMode("append")
             .foreachBatch((sink or idempotent_alert_sink)(out))
             .option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    from blocklens.plans.stages import _fs_exists
    return spark.read.parquet(out).drop("batch_id") if _fs_exists(spark, out) else None


def idempotent_alert_sink(path: str):
    """``foreachBatch`` function writing each micro-batch to its own
    ``batch_id=<n>`` folder with overwrite, deduplicated on (block_id, window)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        keys = [c for c in ("block_id", "window_start", "session_start", "level")
                if c in batch.columns]
        # a window has a row for each level or severity
        keys += [c for c in ("severity",) if c in batch.columns and "window_start" in keys]
        rows = batch.dropDuplicates(keys) if keys else batch
        rows.write.mode("overwrite").parquet(
            os.path.join(path, f"batch_id={batch_id}"))
    return write


def session_counts(parsed: DataFrame, vocabulary: list[int], gap: str = SESSION_GAP,
                   watermark: str = WATERMARK) -> DataFrame:
    """E2 + G3 on a stream: per (block, session) the number of lines, of lines
    without a known template, and one count column per training event id (a
    static list of aggregates, so no pivot is needed)."""
    keyed = parsed.where(F.col("block_id").isNotNull())
    aggs = [F.count_if(F.col("event_id") == k).alias(f"E{k}") for k in vocabulary]
    return (keyed.withWatermark("event_ts", watermark)
            .groupBy(F.session_window("event_ts", gap).alias("s"), "block_id")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.count_if(F.col("event_id").isNull()).alias("n_unseen"), *aggs)
            .select("block_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events",
                    "n_unseen", *[f"E{k}" for k in vocabulary]))


def score_sessions(sessions: DataFrame, decision, feature_names: list[str]) -> DataFrame:
    """Alerts of scored sessions: each session keeps its own score."""
    from blocklens.functions import scores as S
    from blocklens.operators.iforest import class_of_score, features_array
    scored = sessions.withColumn("decision", decision(features_array(sessions, feature_names)))
    norm = S.normalize_isolation_score(F.col("decision"))
    return scored.where(class_of_score(F.col("decision")) == "Anomaly").select(
        "block_id", "session_start", "session_end", "n_events", "n_unseen",
        S.round_score(norm).alias("score"), S.severity(norm).alias("severity"))


def scoring_alert_sink(path: str, decision, feature_names: list[str]):
    """``foreachBatch`` body that scores each micro-batch of session counts
    with a frozen isolation forest (``decision``: one broadcast for the whole
    query) and writes the anomalous sessions, replacing the batch's output so
    that a replayed batch cannot duplicate them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        score_sessions(batch, decision, feature_names).write.mode("overwrite").parquet(
            os.path.join(path, f"batch_id={batch_id}"))
    return write


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state of an ``update``-mode output written by
    :func:`idempotent_alert_sink`: per key the row of the latest micro-batch
    (a partial ``max_by`` aggregate -- no key gathers its versions in one
    place)."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    latest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
