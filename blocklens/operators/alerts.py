"""Alerts with severity (A1-A4) and the dashboard read path.

An alert is a pure projection over predictions ⟕ sequences: anomaly rows
only, the model's score normalised to [0, 1], rounded to 4 decimals, the
block's events as ``E<id>`` labels and a severity band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions import scores as S
from blocklens.functions import text as TX

# --- fixed values -------------------------------------------------------------
ALERT_CLASS = "ANOMALY"
DEFAULT_RISK_FILTER = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
# -----------------------------------------------------------------------------


def generate_alerts(preds: DataFrame, model: str, sequences: DataFrame) -> DataFrame:
    """A3: ``(block_id, classification, score, model, events array<string>,
    severity)``.  A block without a sequence gets an empty event list."""
    norm = S.normalized_score(model)          # A1: raises on an unknown model
    anomalies = preds.where(F.col("classification") == "Anomaly")
    joined = anomalies.join(sequences.select("block_id", "events"), "block_id", "left")
    events = F.coalesce(TX.event_labels(F.col("events")), F.array().cast("array<string>"))
    return joined.select(
        "block_id",
        F.lit(ALERT_CLASS).alias("classification"),
        S.round_score(norm).alias("score"),
        F.lit(model).alias("model"),
        events.alias("events"),
        S.severity(norm).alias("severity"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    """A4: alerts per model and severity."""
    return alerts.groupBy("model", "severity").agg(F.count(F.lit(1)).alias("n"))


def alert_table(preds: DataFrame, model: str) -> DataFrame:
    """Anomaly rows with the raw columns kept, plus normalised score and
    risk band."""
    norm = S.normalized_score(model)
    return preds.where(F.col("classification") == "Anomaly").select(
        "*", norm.alias("norm_score"), S.severity(norm).alias("risk"))


def filter_by_risk(table: DataFrame, risks=DEFAULT_RISK_FILTER, col: str = "risk") -> DataFrame:
    """P7 (the default leaves out NORMAL)."""
    return table.where(F.col(col).isin(*risks))


def top_alerts(table: DataFrame, k: int, score_col: str = "norm_score",
               group_col: str | None = "model") -> DataFrame:
    """L2: highest scores first, missing scores last, ties by block id; top
    ``k`` per group (a rank filter Spark plans as a per-partition top-k)."""
    order = [F.col(score_col).desc_nulls_last(), F.col("block_id")]
    w = (Window.partitionBy(group_col) if group_col else Window.partitionBy(F.lit(0))) \
        .orderBy(*order)
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_detail(preds: DataFrame, model: str, sequences: DataFrame) -> DataFrame:
    """Per block the raw score, class, ground truth, correct flag (P11),
    event chain (L5) and explanation when the model gives one."""
    score_col = S.MODEL_SCORES[model][0]
    raw = F.col(score_col)
    if dict(preds.dtypes)[score_col] != "string":
        raw = F.format_string("%.6f", raw)
    expl = F.col("explanation") if "explanation" in preds.columns else F.lit(None)
    joined = preds.join(sequences.select("block_id", "events"), "block_id", "left")
    return joined.select(
        F.lit(model).alias("model"), "block_id",
        raw.alias("raw_score"),
        "classification", "label",
        (F.col("classification") == F.col("label")).alias("correct"),
        TX.event_chain(F.col("events")).alias("event_chain"),
        expl.cast("string").alias("explanation"),
    )


def lookup_block(detail: DataFrame, block_id: str) -> DataFrame:
    """One block's row (a pushed-down equality filter)."""
    return detail.where(F.col("block_id") == F.lit(block_id))
