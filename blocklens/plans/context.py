"""Shared, staged DataFrames for one input folder.

Every query in the catalog starts from the driver tables of one scale-factor
folder.  Reused intermediate results are written once as Parquet stages below
the shared checkpoint folder (see :mod:`blocklens.plans.stages`) and read
back, so each query plan stays small and no stage is computed twice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.operators import parse as parse_ops
from blocklens.operators import sequences as seq_ops
from blocklens.operators import templates as tpl_ops
from blocklens.plans.stages import StageStore
from blocklens.sources import fixtures

_CONTEXTS: dict[tuple, "LogContext"] = {}
_CONTEXTS_GUARD = __import__("threading").RLock()


class LogContext:
    def __init__(self, spark: SparkSession, sf_dir: str, miner: str = "mask"):
        self.spark = spark
        self.sf_dir = sf_dir
        self.miner = miner
        # miner-independent stages (parsed lines, labels) are shared by all
        # miners; stages that depend on the templates are named per miner
        self.store = StageStore.for_inputs(spark, "v2", sf_dir)
        self._p = "" if miner == "mask" else f"{miner}_"

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, miner: str = "mask") -> "LogContext":
        key = (spark.sparkContext.applicationId, sf_dir, miner)
        with _CONTEXTS_GUARD:
            if key not in _CONTEXTS:
                _CONTEXTS[key] = cls(spark, sf_dir, miner)
            return _CONTEXTS[key]

    # --- per-line stages ----------------------------------------------------

    @cached_property
    def lines(self) -> DataFrame:
        return fixtures.log_lines(self.spark, self.sf_dir)

    @cached_property
    def parsed_all(self) -> DataFrame:
        """Every line parsed + masked, unmatched ones flagged (S5), written once."""
        return self._parsed_pass[0]

    @property
    def parse_figures(self) -> DataFrame:
        """The run's line counts, observed while the parsed lines were written."""
        return self._parsed_pass[1]

    @cached_property
    def _parsed_pass(self) -> tuple[DataFrame, DataFrame]:
        return self.store.observed("parsed", lambda: tpl_ops.with_masks(
            parse_ops.parse_lines(self.lines, keep_unmatched=True)), parse_ops.parse_figures())

    @cached_property
    def parsed(self) -> DataFrame:
        """Header-matching lines only."""
        return self.parsed_all.where("matched").drop("matched")

    @property
    def masked(self) -> DataFrame:
        return self.parsed

    @cached_property
    def _mined(self) -> tuple[DataFrame, DataFrame]:
        if self.miner == "mined":
            mined = self.store.materialize("mined_masks", lambda: tpl_ops.mined_masks(self.masked))
            t, m = tpl_ops.mined_from_masks(mined)
            return (self.store.materialize("mined_templates", lambda: t),
                    self.store.materialize("mined_mask_to_event", lambda: m))
        templates = self.store.materialize(
            "templates", lambda: tpl_ops.mask_templates(self.masked))
        return templates, tpl_ops.mask_to_event_from(templates)

    @property
    def templates(self) -> DataFrame:
        return self._mined[0]

    @property
    def mask_to_event(self) -> DataFrame:
        return self._mined[1]

    @cached_property
    def assigned(self) -> DataFrame:
        return tpl_ops.assign_events(self.masked, self.mask_to_event)

    # --- per-block stages ---------------------------------------------------

    @cached_property
    def sequences(self) -> DataFrame:
        return self.store.bucketed(self._p + "sequences",
                                   lambda: seq_ops.block_sequences(self.assigned))

    @cached_property
    def labels(self) -> DataFrame:
        return self.store.bucketed(
            "labels", lambda: fixtures.block_labels_from_parsed(self.parsed))

    @cached_property
    def labeled(self) -> DataFrame:
        return seq_ops.sequences_labeled(self.sequences, self.labels)

    @cached_property
    def block_ids(self) -> DataFrame:
        """Labelled blocks as (block_id, label) -- the input of the split."""
        return self.labeled.where(F.col("label").isNotNull()).select("block_id", "label")

    # --- split, sample, features ------------------------------------------

    @cached_property
    def block_events(self) -> DataFrame:
        return seq_ops.block_events(self.assigned)

    @cached_property
    def split_ids(self) -> DataFrame:
        """(block_id, label, split) -- exact stratified 80/20, written once."""
        from blocklens.operators.sampling import stratified_split
        return self.store.bucketed(self._p + "split_ids", lambda: stratified_split(self.block_ids))

    @cached_property
    def sample_ids(self) -> DataFrame:
        """(block_id, label) -- exact stratified sample of the test split."""
        from blocklens.operators.sampling import stratified_sample
        test = self.split_ids.where(F.col("split") == "test").select("block_id", "label")
        return self.store.materialize(self._p + "sample_ids", lambda: stratified_sample(test))

    @cached_property
    def event_counts(self) -> DataFrame:
        from blocklens.operators.features import block_event_counts
        return self.store.materialize(
            self._p + "event_counts", lambda: block_event_counts(self.block_events))

    @cached_property
    def vocabulary(self) -> DataFrame:
        from blocklens.operators.features import train_vocabulary
        return self.store.materialize(
            self._p + "vocabulary", lambda: train_vocabulary(self.event_counts, self.split_ids))

    @cached_property
    def long_counts(self) -> DataFrame:
        from blocklens.operators.features import count_matrix_long
        return self.store.materialize(
            self._p + "long_counts",
            lambda: count_matrix_long(self.event_counts, self.split_ids, self.vocabulary))

    def wide_counts(self, names: list[str]) -> DataFrame:
        from blocklens.operators.features import count_matrix_wide
        return count_matrix_wide(self.long_counts, self.split_ids, names)

    # --- detectors ------------------------------------------------------------

    @cached_property
    def vectors(self) -> DataFrame:
        """Model input: one sparse count vector per block, whatever the width."""
        from blocklens.operators.features import sparse_counts, vector_schema
        return self.store.materialize(
            self._p + "vectors",
            lambda: sparse_counts(self.long_counts, self.split_ids, self.vocabulary),
            schema=vector_schema())

    @cached_property
    def vector_rows(self) -> DataFrame:
        """The same vectors as plain structs (type, size, indices, values)."""
        self.vectors
        return self.spark.read.parquet(self.store.path(self._p + "vectors"))

    @cached_property
    def rf_model(self):
        from blocklens.operators.forest import stored_forest
        return stored_forest(self.store, self._p + "rf_model", self.vectors)

    @cached_property
    def iforest(self) -> tuple[DataFrame, int]:
        from blocklens.operators.iforest import stored_isolation_forest
        return stored_isolation_forest(self.store, self._p + "iforest_nodes", self.vector_rows)

    @cached_property
    def iforest_predictions(self) -> DataFrame:
        """The isolation forest's predictions of the test split, timed by row."""
        from blocklens.operators.iforest import score_isolation_forest
        nodes, psi = self.iforest
        return self.store.timed(
            self._p + "iforest_predictions",
            lambda: score_isolation_forest(self.spark, nodes, psi, self.vector_rows, None))

    @cached_property
    def rf_predictions(self) -> DataFrame:
        """The random forest's predictions of the test split, timed by row."""
        from blocklens.operators.forest import predict_random_forest
        return self.store.timed(
            self._p + "rf_predictions",
            lambda: predict_random_forest(self.rf_model, self.vectors, None))

    @property
    def detector_predictions(self) -> dict[str, DataFrame]:
        """Test-split predictions of both detectors with the time per row."""
        return {"isolation_forest": self.iforest_predictions, "random_forest": self.rf_predictions}

    @cached_property
    def texts(self) -> DataFrame:
        """(block_id, text_sequence, label) for every labelled block."""
        return self.store.materialize(self._p + "texts", lambda: seq_ops.text_sequences(
            self.sequences, self.templates).join(self.block_ids, "block_id"))
