"""End-to-end detection job with phase checkpointing.

    python -m blocklens.plans.runner --log 'hdfs://.../HDFS*.log' \\
        --labels hdfs://.../block_labels.csv --out hdfs://.../run1
    python -m blocklens.plans.runner --demo-sf /root/testdata/sf0.01 --out /tmp/run1

Each phase writes Parquet below ``--out`` and is skipped when its ``_SUCCESS``
marker exists, so a failed or interrupted run restarts where it stopped.  The
split and the evaluation sample are written once and never replaced; the
text-model phase appends and resumes; alerts and metrics are recomputed every
run.  ``--only-metrics`` recomputes alerts and metrics from the stored
predictions.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.operators import alerts as alert_ops
from blocklens.operators import features as feat_ops
from blocklens.operators import forest, iforest, metrics, sampling
from blocklens.operators import parse as parse_ops
from blocklens.operators import sequences as seq_ops
from blocklens.operators import templates as tpl_ops
from blocklens.operators import text_classifier as tc
from blocklens.plans.stages import StageStore
from blocklens.sources import sinks

MODELS = ("isolation_forest", "random_forest", "llm")


class DetectionRun:
    def __init__(self, spark: SparkSession, out: str, miner: str = "mined",
                 backend: tc.Backend | None = None, sample_size: int = sampling.SAMPLE_SIZE,
                 text_chunks: int = 4):
        self.spark = spark
        self.store = StageStore(spark, out)
        self.miner = miner
        self.backend = backend
        self.sample_size = sample_size
        self.text_chunks = text_chunks
        self.log: list[str] = []

    def _note(self, msg: str) -> None:
        self.log.append(msg)

    # phase 3: parse, mask, mine, assign
    def parse(self, lines: DataFrame) -> DataFrame:
        masked = self.store.materialize(
            "parsed", lambda: tpl_ops.with_masks(parse_ops.parse_lines(lines)))
        if self.miner == "mined":
            mined = self.store.materialize("mined_masks", lambda: tpl_ops.mined_masks(masked))
            t, m = tpl_ops.mined_from_masks(mined)
            templates = self.store.materialize("templates", lambda: t)
            m2e = self.store.materialize("mask_to_event", lambda: m)
        else:
            templates = self.store.materialize("templates",
                                               lambda: tpl_ops.mask_templates(masked))
            m2e = tpl_ops.mask_to_event_from(templates)
        return self.store.materialize("parsed_lines", lambda: tpl_ops.assign_events(
            masked, m2e).select("line_id", "block_id", "event_id", "event_template",
                                "event_date", "event_time"))

    # phase 4: sequences + labels
    def sequences(self, assigned: DataFrame, labels: DataFrame) -> DataFrame:
        return self.store.materialize("block_sequences", lambda: seq_ops.sequences_labeled(
            seq_ops.block_sequences(assigned), labels))

    # phase 5: split (written once)
    def split(self, seqs: DataFrame) -> DataFrame:
        if not self.store.exists("split_ids"):
            ids = seqs.where(F.col("label").isNotNull()).select("block_id", "label")
            return self.store.write_once("split_ids", sampling.stratified_split(ids))
        return self.spark.read.parquet(self.store.path("split_ids"))

    # phase 6: features
    def features(self, assigned: DataFrame, split_ids: DataFrame):
        counts = self.store.materialize("event_counts", lambda: feat_ops.block_event_counts(
            seq_ops.block_events(assigned)))
        vocab = self.store.materialize("vocabulary",
                                       lambda: feat_ops.train_vocabulary(counts, split_ids))
        long = feat_ops.count_matrix_long(counts, split_ids, vocab)
        return self.store.materialize("features", lambda: feat_ops.sparse_counts(
            long, split_ids, vocab), schema=feat_ops.vector_schema())

    # phase 7a / 7b: detectors
    def isolation_forest(self, vectors: DataFrame) -> DataFrame:
        def build():
            rows = self.spark.read.parquet(self.store.path("features"))      # as plain structs
            nodes, psi = iforest.stored_isolation_forest(self.store, "iforest_model", rows)
            return iforest.score_isolation_forest(self.spark, nodes, psi, rows, None)
        return self.store.timed("predictions_isolation_forest", build)

    def random_forest(self, vectors: DataFrame) -> DataFrame:
        def build():
            model = forest.stored_forest(self.store, "rf_model", vectors)
            return forest.predict_random_forest(model, vectors, None)
        return self.store.timed("predictions_random_forest", build)

    # phase 7c: sample -> text -> text model (resumable)
    def text_model(self, seqs: DataFrame, templates: DataFrame, split_ids: DataFrame):
        if self.backend is None:
            raise ValueError("the language-model phase needs a backend; pass one or skip the phase")
        if not self.store.exists("text_sample_ids"):
            test = split_ids.where(F.col("split") == "test").select("block_id", "label")
            sample = self.store.write_once(
                "text_sample_ids", sampling.stratified_sample(test, self.sample_size))
        else:
            sample = self.spark.read.parquet(self.store.path("text_sample_ids"))
        texts = self.store.materialize("text_sequences_sample", lambda: seq_ops.text_sequences(
            seqs.join(sample.select("block_id"), "block_id", "left_semi"), templates)
            .join(sample, "block_id"))
        preds = sinks.append_resumable(
            self.spark, texts, self.store.path("predictions_llm"),
            lambda remaining: tc.classify(remaining, self.backend), chunks=self.text_chunks)
        return preds, sample

    # phase 8 / 9: alerts and metrics (always recomputed)
    def report(self, preds: dict[str, DataFrame], seqs: DataFrame,
               sample: DataFrame | None) -> dict[str, DataFrame]:
        out = {}
        for model, p in preds.items():
            a = alert_ops.generate_alerts(p, model, seqs)
            sinks.write_alerts_json(a, self.store.path(f"alerts_{model}"))
            out[f"alerts_{model}"] = a
        classic = {m: preds[m] for m in ("isolation_forest", "random_forest") if m in preds}
        full = metrics.evaluate_full(classic)
        full.write.mode("overwrite").parquet(self.store.path("metrics_full"))
        out["metrics_full"] = full
        if sample is not None and "llm" in preds:
            sm = metrics.evaluate_on_sample(classic, {"llm": preds["llm"]}, sample)
            sm.write.mode("overwrite").parquet(self.store.path("metrics_sample"))
            out["metrics_sample"] = sm
        return out

    def run(self, lines: DataFrame | None, labels: DataFrame | None, skip_llm: bool = False,
            only_metrics: bool = False) -> dict[str, DataFrame]:
        if only_metrics:
            return self.rerun_reports()
        assigned = self.parse(lines)
        seqs = self.sequences(assigned, labels)
        split_ids = self.split(seqs)
        vectors = self.features(assigned, split_ids)
        preds = {"isolation_forest": self.isolation_forest(vectors),
                 "random_forest": self.random_forest(vectors)}
        sample = None
        if not skip_llm:
            templates = self.spark.read.parquet(self.store.path("templates"))
            preds["llm"], sample = self.text_model(seqs, templates, split_ids)
        return self.report(preds, seqs, sample)

    def rerun_reports(self) -> dict[str, DataFrame]:
        seqs = self.spark.read.parquet(self.store.path("block_sequences"))
        found = {m: self.store.read_timed(f"predictions_{m}") for m in MODELS if m != "llm"}
        if self.store.exists("predictions_llm"):
            found["llm"] = self.spark.read.parquet(self.store.path("predictions_llm"))
        preds = {m: p for m, p in found.items() if p is not None}
        sample = (self.spark.read.parquet(self.store.path("text_sample_ids"))
                  if self.store.exists("text_sample_ids") else None)
        return self.report(preds, seqs, sample)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--log", help="raw log text path(s) (globs allowed)")
    ap.add_argument("--labels", help="label CSV with BlockId,Label")
    ap.add_argument("--demo-sf", help="use the log derived from <dir>/events.parquet")
    ap.add_argument("--out", required=True)
    ap.add_argument("--miner", choices=["mined", "mask"], default="mined")
    ap.add_argument("--skip-llm", action="store_true")
    ap.add_argument("--backend", help="module:function that gives the model's answers")
    ap.add_argument("--only-metrics", action="store_true")
    args = ap.parse_args(argv)
    backend = None
    if args.backend:
        import importlib
        module, name = args.backend.split(":")
        backend = getattr(importlib.import_module(module), name)
    elif not args.skip_llm and not args.only_metrics:
        ap.error("--backend names the model's answers; without one pass --skip-llm")

    from blocklens.session import get_session
    spark = get_session()
    lines = labels = None
    if not args.only_metrics:
        if args.demo_sf:
            from blocklens.sources import fixtures
            lines = fixtures.log_lines(spark, args.demo_sf)
            labels = fixtures.block_labels(spark, args.demo_sf)
        else:
            from blocklens.sources.labels import load_labels
            from blocklens.sources.rawlog import read_raw_log
            lines = read_raw_log(spark, args.log).select("line_id", "raw_content")
            labels = load_labels(spark, args.labels)
    run = DetectionRun(spark, args.out, miner=args.miner, backend=backend)
    out = run.run(lines, labels, skip_llm=args.skip_llm, only_metrics=args.only_metrics)
    for name in ("metrics_full", "metrics_sample"):
        if name in out:
            print(name)
            out[name].show(truncate=False)
    print("outputs in", os.path.abspath(args.out) if "://" not in args.out else args.out)


if __name__ == "__main__":
    main()
