"""Detector evaluation (M1-M3) and value counts / cross-tabs.

All metrics come out of one aggregation pass of ``count_if`` columns (partial
aggregation, no shuffle of rows); ratios are computed from the counts
afterwards, 0 on a zero denominator.  Anomaly is the positive class; rows with
a NULL prediction are excluded and counted as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = "Anomaly"
NEGATIVE = "Normal"

METRIC_COLUMNS = ("n_total", "n_invalid", "precision", "recall", "f1", "fpr",
                  "tp", "fp", "tn", "fn", "mean_inference_sec")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def compute_metrics(df: DataFrame, group_cols: list[str] | None = None,
                    label_col: str = "label", pred_col: str = "classification",
                    time_col: str | None = "inference_time_sec") -> DataFrame:
    """M1 (per group when ``group_cols`` is given)."""
    y, p = F.col(label_col), F.col(pred_col)
    valid = p.isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~valid).alias("n_invalid"),
        F.count_if(valid & (y == POSITIVE) & (p == POSITIVE)).alias("tp"),
        F.count_if(valid & (y != POSITIVE) & (p == POSITIVE)).alias("fp"),
        F.count_if(valid & (y == NEGATIVE) & (p == NEGATIVE)).alias("tn"),
        F.count_if(valid & (y == POSITIVE) & (p != POSITIVE)).alias("fn"),
    ]
    has_time = time_col is not None and time_col in df.columns
    if has_time:
        aggs.append(F.avg(F.when(valid, F.col(time_col))).alias("mean_inference_sec"))
    counts = df.groupBy(*(group_cols or [])).agg(*aggs)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    mean_t = F.col("mean_inference_sec") if has_time else F.lit(None).cast("double")
    return counts.select(
        *(group_cols or []), "n_total", "n_invalid",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(fp, fp + tn).alias("fpr"),
        "tp", "fp", "tn", "fn",
        mean_t.alias("mean_inference_sec"),
    )


def _stack(preds: dict[str, DataFrame]) -> DataFrame:
    cols = ["block_id", "classification", "label", "inference_time_sec"]
    out = None
    for name, df in preds.items():
        part = df.select(F.lit(name).alias("approach"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_full(preds: dict[str, DataFrame]) -> DataFrame:
    """M2: M1 per approach over its whole prediction table."""
    return compute_metrics(_stack(preds), ["approach"])


def evaluate_on_sample(restricted: dict[str, DataFrame], complete: dict[str, DataFrame],
                       sample_ids: DataFrame) -> DataFrame:
    """M3: approaches in ``restricted`` are semi-joined to the sample first and
    must then cover every sampled id (J6, checked lazily inside the job);
    approaches in ``complete`` already are the sample."""
    ids = sample_ids.select("block_id")
    parts = {k: v.join(ids, "block_id", "left_semi") for k, v in restricted.items()}
    parts.update(complete)
    m = compute_metrics(_stack(parts), ["approach"])
    n_sample = ids.agg(F.count(F.lit(1)).alias("_n_sample"))
    checked = _attach_scalar(m, n_sample)
    bad = F.raise_error(F.concat(F.lit("approach "), F.col("approach"),
                                 F.lit(" does not cover the sample")))
    must = F.col("approach").isin(*restricted.keys())
    return checked.withColumn(
        "n_total", F.when(must & (F.col("n_total") != F.col("_n_sample")), bad.cast("long"))
        .otherwise(F.col("n_total"))).drop("_n_sample")


def _attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate (broadcast equi-join on a
    constant key; the right side is one row by construction)."""
    return df.withColumn("_k", F.lit(1)).join(
        F.broadcast(one_row.withColumn("_k", F.lit(1))), "_k").drop("_k")


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """G5."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, row: str = "label", col: str = "classification") -> DataFrame:
    """G8 in long form ``(row, col, n)``; rows with a NULL in either are left
    out, as a cross-tabulation does."""
    clean = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return clean.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
