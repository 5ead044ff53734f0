"""Named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables of ``sf_dir`` (through the derived log and
prediction views of :mod:`blocklens.sources.fixtures`) and runs over all of
their rows.  Output columns are aliased to the names used by the DuckDB
oracle in :mod:`blocklens.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.functions import text as T
from blocklens.operators import parse as parse_ops
from blocklens.operators import sequences as seq_ops
from blocklens.operators import templates as tpl_ops
from blocklens.plans.context import LogContext

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


RAW_HEAD_ROWS = 100
#: features of the wide export
EXPORTED_FEATURES = tuple(f"E{i}" for i in range(1, 9))

# --- log lines ---------------------------------------------------------------


@query("raw_head")
def q_raw_head(spark, sf_dir):
    """The first lines of the log (top-k by line id, the feature)."""
    return parse_ops.head_lines(LogContext.of(spark, sf_dir).lines, RAW_HEAD_ROWS)


@query("parse_header")
def q_parse_header(spark, sf_dir):
    p = LogContext.of(spark, sf_dir).parsed
    return p.select("line_id", "event_date", "event_time", "pid", "level", "component",
                    "content")


@query("parse_stats")
def q_parse_stats(spark, sf_dir):
    """Line counts observed by the pass that wrote the parsed lines, and
    the size of the template table; no second scan of the lines."""
    ctx = LogContext.of(spark, sf_dir)
    size = ctx.templates.agg(F.count(F.lit(1)).alias("n_templates"))
    return ctx.parse_figures.crossJoin(size)       # one row each


@query("extract_block_id")
def q_extract_block_id(spark, sf_dir):
    return LogContext.of(spark, sf_dir).parsed.select("line_id", "block_id")


@query("drop_unkeyed")
def q_drop_unkeyed(spark, sf_dir):
    return parse_ops.drop_unkeyed(LogContext.of(spark, sf_dir).parsed).select("line_id", "block_id")


@query("mask_content")
def q_mask_content(spark, sf_dir):
    return LogContext.of(spark, sf_dir).masked.select("line_id", "template")


@query("mask_templates")
def q_mask_templates(spark, sf_dir):
    t = tpl_ops.mask_templates(LogContext.of(spark, sf_dir).masked)
    return t.select("event_id", "event_template", "occurrences")


@query("template_counts")
def q_template_counts(spark, sf_dir):
    return tpl_ops.template_counts(LogContext.of(spark, sf_dir).assigned)


@query("assign_events")
def q_assign_events(spark, sf_dir):
    a = LogContext.of(spark, sf_dir).assigned
    return a.select("line_id", "block_id", "event_id", "event_template", "event_date",
                    "event_time")


@query("approx_distinct_blocks")
def q_approx_distinct_blocks(spark, sf_dir):
    """G6, the approximate form: one sketch a day, merged for the whole log; the
    estimates are held against the exact counts."""
    from blocklens.operators import distinct
    p = LogContext.of(spark, sf_dir).parsed
    sketches = distinct.daily_sketches(p, "event_date", "block_id")
    estimates = distinct.estimates(sketches, "event_date").unionByName(
        distinct.merged_estimate(sketches).withColumn("event_date", F.lit("all")))
    exact = p.groupBy("event_date").agg(F.count_distinct("block_id").alias("n_blocks")).unionByName(
        p.agg(F.lit("all").alias("event_date"), F.count_distinct("block_id").alias("n_blocks")))
    return exact.join(estimates, "event_date").select(
        "event_date", "n_blocks",
        (F.abs(F.col("estimate") - F.col("n_blocks")) <= distinct.error_bound(F.col("n_blocks"))).alias("within_bound"))


@query("distinct_blocks")
def q_distinct_blocks(spark, sf_dir):
    p = LogContext.of(spark, sf_dir).parsed
    return p.agg(F.count_distinct("block_id").alias("n_blocks"))


# --- sequences and labels ------------------------------------------------------


@query("block_sequences")
def q_block_sequences(spark, sf_dir):
    s = seq_ops.with_sequence_text(LogContext.of(spark, sf_dir).sequences)
    return s.select("block_id", "event_sequence", "sequence_length")


#: line ids of a chunk in the chunked queries (2**6), so that blocks have several
SHOWN_CHUNK_BITS = 6


@query("chunk_positions")
def q_chunk_positions(spark, sf_dir):
    """G1 in chunks: the position of every event of a block, without a row that
    holds a whole block."""
    chunks = seq_ops.sequence_chunks(LogContext.of(spark, sf_dir).assigned, SHOWN_CHUNK_BITS)
    return seq_ops.chunk_positions(chunks)


@query("text_chunks")
def q_text_chunks(spark, sf_dir):
    """F5 in chunks: numbered template lines, chunk by chunk."""
    ctx = LogContext.of(spark, sf_dir)
    return seq_ops.text_chunks(seq_ops.sequence_chunks(ctx.assigned, SHOWN_CHUNK_BITS), ctx.templates)


@query("sequences_labeled")
def q_sequences_labeled(spark, sf_dir):
    s = seq_ops.with_sequence_text(LogContext.of(spark, sf_dir).labeled)
    return s.select("block_id", "event_sequence", "sequence_length", "label")


@query("unlabeled_count")
def q_unlabeled_count(spark, sf_dir):
    return seq_ops.unlabeled_count(LogContext.of(spark, sf_dir).labeled)


@query("label_counts")
def q_label_counts(spark, sf_dir):
    labels = LogContext.of(spark, sf_dir).labels
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("label_lookup")
def q_label_lookup(spark, sf_dir):
    """Key -> label where the *last* row of a key wins.

    Input rows: one label row per keyed line (Anomaly for a 'write failed'
    line, else Normal) in line order -- a label file with repeated keys.
    """
    from blocklens.sources.labels import labels_lookup
    keyed = parse_ops.drop_unkeyed(LogContext.of(spark, sf_dir).parsed)
    rows = keyed.select(
        "block_id",
        F.when(F.col("content").startswith("write failed "), F.lit("Anomaly"))
        .otherwise(F.lit("Normal")).alias("label"),
        F.col("line_id").alias("row_order"))
    return labels_lookup(rows, order_col="row_order")


@query("event_positions")
def q_event_positions(spark, sf_dir):
    return seq_ops.event_positions(LogContext.of(spark, sf_dir).sequences)


@query("event_labels")
def q_event_labels(spark, sf_dir):
    s = LogContext.of(spark, sf_dir).sequences
    return s.select("block_id", F.array_join(T.event_labels(F.col("events")), " ")
                    .alias("event_labels"))


@query("event_chain")
def q_event_chain(spark, sf_dir):
    s = LogContext.of(spark, sf_dir).sequences
    return s.select("block_id", T.event_chain(F.col("events")).alias("event_chain"))


@query("text_sequences")
def q_text_sequences(spark, sf_dir):
    ctx = LogContext.of(spark, sf_dir)
    return seq_ops.text_sequences(ctx.sequences, ctx.templates)


# --- split, sample, features -------------------------------------------------


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return LogContext.of(spark, sf_dir).split_ids.select("block_id", "label", "split")


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    return LogContext.of(spark, sf_dir).sample_ids.select("block_id", "label")


@query("anomaly_rate")
def q_anomaly_rate(spark, sf_dir):
    """Share of Anomaly per split and in the sample."""
    ctx = LogContext.of(spark, sf_dir)
    parts = ctx.split_ids.select("split", "label").unionByName(
        ctx.sample_ids.select(F.lit("sample").alias("split"), "label"))
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("label") == "Anomaly").alias("n_anomaly"),
        F.avg((F.col("label") == "Anomaly").cast("int")).alias("anomaly_rate"))


@query("restrict_to_ids")
def q_restrict_to_ids(spark, sf_dir):
    """Sequences of the test blocks only (semi-join with the id list)."""
    ctx = LogContext.of(spark, sf_dir)
    test = ctx.split_ids.where(F.col("split") == "test").select("block_id")
    s = seq_ops.with_sequence_text(ctx.labeled.join(test, "block_id", "left_semi"))
    return s.select("block_id", "event_sequence", "label")


@query("normal_only")
def q_normal_only(spark, sf_dir):
    """P5: the training rows an unsupervised detector may see."""
    ids = LogContext.of(spark, sf_dir).split_ids
    return ids.where((F.col("split") == "train") & (F.col("label") == "Normal")) \
        .select("block_id")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    from blocklens.operators.features import class_weights
    return class_weights(LogContext.of(spark, sf_dir).split_ids)


@query("train_vocabulary")
def q_train_vocabulary(spark, sf_dir):
    return LogContext.of(spark, sf_dir).vocabulary


@query("count_matrix_long")
def q_count_matrix_long(spark, sf_dir):
    return LogContext.of(spark, sf_dir).long_counts.select(
        "block_id", "split", "label", "feature_name", "n")


@query("count_matrix_wide")
def q_count_matrix_wide(spark, sf_dir):
    """G3 wide form: the export of a stated list of features."""
    return LogContext.of(spark, sf_dir).wide_counts(list(EXPORTED_FEATURES))


# --- predictions: metrics, scores, alerts, reports -----------------------------

MODELS = ("isolation_forest", "random_forest", "llm")
TOP_ALERTS_PER_MODEL = 20


def _preds(spark, sf_dir, model):
    from blocklens.sources import fixtures
    return fixtures.predictions(spark, sf_dir, model)


def _pred_sample_ids(spark, sf_dir):
    """The common evaluation sample, drawn from the prediction ids."""
    from blocklens.operators.sampling import stratified_sample
    base = _preds(spark, sf_dir, "isolation_forest").select("block_id", "label")
    return stratified_sample(base)


@query("binary_metrics")
def q_binary_metrics(spark, sf_dir):
    from blocklens.operators.metrics import compute_metrics
    return compute_metrics(_preds(spark, sf_dir, "isolation_forest"))


@query("metrics_full")
def q_metrics_full(spark, sf_dir):
    from blocklens.operators.metrics import evaluate_full
    return evaluate_full({m: _preds(spark, sf_dir, m) for m in MODELS[:2]})


@query("metrics_sample")
def q_metrics_sample(spark, sf_dir):
    from blocklens.operators.metrics import evaluate_on_sample
    ids = _pred_sample_ids(spark, sf_dir)
    llm = _preds(spark, sf_dir, "llm").join(ids.select("block_id"), "block_id", "left_semi")
    return evaluate_on_sample({m: _preds(spark, sf_dir, m) for m in MODELS[:2]},
                              {"llm": llm}, ids)


@query("crosstab")
def q_crosstab(spark, sf_dir):
    from blocklens.operators.metrics import crosstab
    return crosstab(_preds(spark, sf_dir, "isolation_forest"))


@query("headline")
def q_headline(spark, sf_dir):
    """R2: M1 plus the number of detected anomalies, per model."""
    from blocklens.operators.metrics import compute_metrics
    out = None
    for m in MODELS:
        p = _preds(spark, sf_dir, m).withColumn("model", F.lit(m))
        part = compute_metrics(p, ["model"]).join(
            p.groupBy("model").agg(F.count_if(F.col("classification") == "Anomaly")
                                   .alias("n_detected")), "model")
        out = part if out is None else out.unionByName(part)
    return out.select("model", "n_total", "n_detected", "precision", "recall", "f1", "fpr",
                      "mean_inference_sec")


@query("normalize_scores")
def q_normalize_scores(spark, sf_dir):
    from blocklens.functions import scores as S
    out = None
    for m in MODELS[:2]:
        part = _preds(spark, sf_dir, m).select(
            F.lit(m).alias("model"), "block_id", S.normalized_score(m).alias("norm_score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("normalize_confidence")
def q_normalize_confidence(spark, sf_dir):
    from blocklens.functions import scores as S
    return _preds(spark, sf_dir, "llm").select(
        "block_id", "confidence", S.normalize_confidence(F.col("confidence")).alias("norm_score"))


# --- fixed value: raw class spellings a text model may answer with -------------
RAW_CLASS_SPELLINGS = ("NORMAL", " anomaly ", "Anômalo", "anomalo", "anomalous", "Normal\t")


@query("normalize_class")
def q_normalize_class(spark, sf_dir):
    """F12 over raw answers derived from ``labels`` (one spelling per row)."""
    from blocklens.functions import scores as S
    from blocklens.sources import fixtures
    lab = fixtures.read_table(spark, sf_dir, "labels")
    spell = F.array(*[F.lit(s) for s in RAW_CLASS_SPELLINGS])
    raw = F.element_at(spell, (F.col("doc_id") % len(RAW_CLASS_SPELLINGS) + 1).cast("int"))
    return lab.select(F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("block_id"),
                      raw.alias("raw_class")).withColumn(
        "classification", S.normalize_class(F.col("raw_class")))


@query("severity")
def q_severity(spark, sf_dir):
    from blocklens.functions import scores as S
    out = None
    for m in MODELS:
        norm = S.normalized_score(m)
        part = _preds(spark, sf_dir, m).select(
            F.lit(m).alias("model"), "block_id", norm.alias("norm_score"),
            S.severity(norm).alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out


def _all_alerts(spark, sf_dir):
    from blocklens.operators.alerts import generate_alerts
    seqs = LogContext.of(spark, sf_dir).sequences
    out = None
    for m in MODELS:
        part = generate_alerts(_preds(spark, sf_dir, m), m, seqs)
        out = part if out is None else out.unionByName(part)
    return out


@query("alerts")
def q_alerts(spark, sf_dir):
    a = _all_alerts(spark, sf_dir)
    return a.select("block_id", "classification", "score", "model",
                    F.array_join("events", " ").alias("events"), "severity")


@query("severity_counts")
def q_severity_counts(spark, sf_dir):
    from blocklens.operators.alerts import severity_counts
    return severity_counts(_all_alerts(spark, sf_dir))


def _alert_tables(spark, sf_dir):
    from blocklens.operators.alerts import alert_table
    out = None
    for m in MODELS:
        part = alert_table(_preds(spark, sf_dir, m), m).select(
            F.lit(m).alias("model"), "block_id", "norm_score", "risk")
        out = part if out is None else out.unionByName(part)
    return out


@query("alerts_by_risk")
def q_alerts_by_risk(spark, sf_dir):
    from blocklens.operators.alerts import filter_by_risk
    return filter_by_risk(_alert_tables(spark, sf_dir))


@query("top_alerts")
def q_top_alerts(spark, sf_dir):
    from blocklens.operators.alerts import filter_by_risk, top_alerts
    return top_alerts(filter_by_risk(_alert_tables(spark, sf_dir)), TOP_ALERTS_PER_MODEL)


@query("block_detail")
def q_block_detail(spark, sf_dir):
    from blocklens.operators.alerts import block_detail
    seqs = LogContext.of(spark, sf_dir).sequences
    out = None
    for m in MODELS:
        part = block_detail(_preds(spark, sf_dir, m), m, seqs)
        out = part if out is None else out.unionByName(part)
    return out


@query("resume_remaining")
def q_resume_remaining(spark, sf_dir):
    """The work list (every block of the log) minus the blocks an
    earlier run already wrote (the language-model predictions)."""
    from blocklens.sources.sinks import remaining_work
    blocks = LogContext.of(spark, sf_dir).parsed.where("block_id is not null").select(
        "block_id").distinct()
    return remaining_work(blocks, _preds(spark, sf_dir, "llm"))


@query("append_resumed")
def q_append_resumed(spark, sf_dir):
    """Sequence lengths computed for a third of the blocks by a first run,
    then resumed in chunks by a second; read back."""
    from blocklens.session import scratch_path
    from blocklens.sources.sinks import append_resumable
    seqs = LogContext.of(spark, sf_dir).sequences
    path = scratch_path(spark, "appended")
    compute = lambda todo: todo.select("block_id", F.size("events").alias("sequence_length"))
    append_resumable(spark, seqs.where(F.pmod(F.xxhash64("block_id"), F.lit(3)) == 0), path, compute)
    return append_resumable(spark, seqs, path, compute, chunks=2)


@query("write_once_read_back")
def q_write_once(spark, sf_dir):
    """The split written once and read back; a second write is refused."""
    from blocklens.session import scratch_path
    from blocklens.sources.sinks import write_once
    path = scratch_path(spark, "once")
    ids = LogContext.of(spark, sf_dir).split_ids
    write_once(ids, path)
    try:
        write_once(ids.limit(0), path)
    except FileExistsError:
        return spark.read.parquet(path).select("block_id", "label", "split")
    raise AssertionError("a complete output was written over")


@query("alerts_json_read_back")
def q_alerts_json(spark, sf_dir):
    """Alerts written as JSON lines and read back."""
    from blocklens.session import scratch_path
    from blocklens.sources.sinks import write_alerts_json
    path = scratch_path(spark, "alerts-json")
    write_alerts_json(_all_alerts(spark, sf_dir), path)
    back = spark.read.schema("block_id string, classification string, score double, model string, "
                             "events array<string>, severity string").json(path)
    return back.select("block_id", "classification", "score", "model",
                       F.array_join("events", " ").alias("events"), "severity")


@query("lookup_blocks")
def q_lookup_blocks(spark, sf_dir):
    """The detail rows of the one block that comes first in the log."""
    from blocklens.operators.alerts import block_detail, lookup_block
    ctx = LogContext.of(spark, sf_dir)
    preds = _preds(spark, sf_dir, "random_forest")
    one = preds.agg(F.min("block_id")).first()[0]
    return lookup_block(block_detail(preds, "random_forest", ctx.sequences), one or "")


# --- template mining and detectors (rows-only checks) ---------------------------


@query("mine_templates")
def q_mine_templates(spark, sf_dir):
    """Templates mined from the distinct masks."""
    t = LogContext.of(spark, sf_dir, miner="mined").templates
    return t.select("event_id", "event_template", "occurrences")


@query("mined_events")
def q_mined_events(spark, sf_dir):
    """T5 with mined ids: the event of every line."""
    a = LogContext.of(spark, sf_dir, miner="mined").assigned
    return a.select("line_id", "block_id", "event_id", "event_template")


@query("mined_sequences")
def q_mined_sequences(spark, sf_dir):
    """G1 with mined ids: the event sequence of every block."""
    s = seq_ops.with_sequence_text(LogContext.of(spark, sf_dir, miner="mined").sequences)
    return s.select("block_id", "event_sequence", "sequence_length")


@query("iforest_train")
def q_iforest_train(spark, sf_dir):
    nodes, _ = LogContext.of(spark, sf_dir).iforest
    return nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("feature") < 0).alias("n_leaves"),
        F.max("depth").alias("depth"))


@query("iforest_score")
def q_iforest_score(spark, sf_dir):
    return LogContext.of(spark, sf_dir).iforest_predictions


@query("iforest_facts")
def q_iforest_facts(spark, sf_dir):
    """Per tree its sample size and whether its depth keeps the bound."""
    nodes, psi = LogContext.of(spark, sf_dir).iforest
    bound = F.ceil(F.log2(F.greatest(F.lit(psi), F.lit(2)).cast("double")))
    return nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("depth") == 0, F.col("n_samples"))).cast("long").alias("n_sampled"),
        (F.sum(F.when(F.col("feature") < 0, F.col("n_samples"))) == F.lit(psi)).alias("leaves_add_up"),
        (F.max("depth") <= bound).alias("depth_kept"))


def _score_facts(ctx, predictions, score, agrees):
    """Scored blocks with: does the class follow the score, do equal vectors
    get equal scores, is there a time per row."""
    preds = predictions.join(
        ctx.long_counts.groupBy("block_id").agg(F.xxhash64(F.array_sort(F.collect_list(
            F.struct("feature_index", "n")))).alias("vector")), "block_id", "left")
    same = preds.groupBy("vector").agg((F.min(score) == F.max(score)).alias("equal_scores"))
    return preds.join(same, preds["vector"].eqNullSafe(same["vector"])).select(
        "block_id", "label", agrees.alias("class_follows"), "equal_scores",
        (F.col("inference_time_sec") > 0).alias("timed"))


@query("iforest_score_facts")
def q_iforest_score_facts(spark, sf_dir):
    """D2 over the whole test split."""
    ctx = LogContext.of(spark, sf_dir)
    return _score_facts(ctx, ctx.iforest_predictions, "score",
                        (F.col("score") < 0) == (F.col("classification") == "Anomaly"))


@query("rf_score_facts")
def q_rf_score_facts(spark, sf_dir):
    """D5 over the whole test split (a tie goes to Anomaly)."""
    ctx = LogContext.of(spark, sf_dir)
    return _score_facts(ctx, ctx.rf_predictions, "anomaly_probability",
                        (F.col("anomaly_probability") >= 0.5) == (F.col("classification") == "Anomaly"))


@query("rf_facts")
def q_rf_facts(spark, sf_dir):
    """The number of trees, and importances that add up to one over as
    many features as the vocabulary has."""
    from blocklens.operators.forest import describe_trees, feature_importances
    ctx = LogContext.of(spark, sf_dir)
    trees = describe_trees(spark, ctx.rf_model).agg(F.count(F.lit(1)).alias("n_trees"))
    every = feature_importances(spark, ctx.rf_model, None, top=None, vocabulary=ctx.vocabulary)
    sums = every.agg(F.count(F.lit(1)).alias("n_features"),
                     (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_up"))
    return trees.crossJoin(sums)        # one row each


@query("detector_alerts")
def q_detector_alerts(spark, sf_dir):
    """A3 on the detectors' own predictions, with the blocks' events."""
    from blocklens.operators.alerts import generate_alerts
    ctx = LogContext.of(spark, sf_dir)
    out = None
    for m, p in ctx.detector_predictions.items():
        part = generate_alerts(p, m, ctx.sequences)
        out = part if out is None else out.unionByName(part)
    return out.select("block_id", "classification", "score", "model",
                      F.array_join("events", " ").alias("events"), "severity")


@query("detector_metrics")
def q_detector_metrics(spark, sf_dir):
    """M2 on the detectors' own predictions."""
    from blocklens.operators.metrics import evaluate_full
    return evaluate_full(LogContext.of(spark, sf_dir).detector_predictions)


@query("detector_crosstab_totals")
def q_detector_crosstab(spark, sf_dir):
    """G8 on the detectors' own predictions, summed by label."""
    from blocklens.operators.metrics import crosstab
    out = None
    for m, p in LogContext.of(spark, sf_dir).detector_predictions.items():
        part = crosstab(p).groupBy("label").agg(F.sum("n").alias("n")).withColumn("model", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out.select("model", "label", "n")


@query("rf_confusion")
def q_rf_confusion(spark, sf_dir):
    """Labels against the random forest's classes on the test split.  A
    block's label follows from one of its counts, so the classes are known."""
    from blocklens.operators.metrics import crosstab
    return crosstab(LogContext.of(spark, sf_dir).rf_predictions)


@query("rf_alerts")
def q_rf_alerts(spark, sf_dir):
    """A3 on the random forest's predictions: who is alerted, with which events."""
    from blocklens.operators.alerts import generate_alerts
    ctx = LogContext.of(spark, sf_dir)
    a = generate_alerts(ctx.rf_predictions, "random_forest", ctx.sequences)
    return a.select("block_id", "classification", "model", F.array_join("events", " ").alias("events"),
                    (F.col("score") >= 0.5).alias("above_half"),
                    F.col("severity").isin("HIGH", "MEDIUM", "LOW").alias("graded"))


@query("iforest_crosstab_by_score")
def q_iforest_crosstab_by_score(spark, sf_dir):
    """Labels of the test split against the sign of the stored score and the
    stored class; rows where the two part would show."""
    p = LogContext.of(spark, sf_dir).iforest_predictions
    by_sign = F.when(F.col("score") < 0, F.lit("Anomaly")).otherwise(F.lit("Normal"))
    return p.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(by_sign == F.col("classification")).alias("n_as_signed"),
        F.count_if(F.col("score").between(-0.5, 0.5)).alias("n_in_range"))


@query("rf_train")
def q_rf_train(spark, sf_dir):
    from blocklens.operators.forest import describe_trees
    return describe_trees(spark, LogContext.of(spark, sf_dir).rf_model)


@query("rf_score")
def q_rf_score(spark, sf_dir):
    return LogContext.of(spark, sf_dir).rf_predictions


@query("rf_top_features")
def q_rf_top_features(spark, sf_dir):
    from blocklens.operators.forest import feature_importances
    ctx = LogContext.of(spark, sf_dir)
    return feature_importances(spark, ctx.rf_model, None, top=10, vocabulary=ctx.vocabulary)


# --- text-model detector ----------------------------------------------------------


@query("build_prompts")
def q_build_prompts(spark, sf_dir):
    from blocklens.operators.text_classifier import build_prompts
    return build_prompts(LogContext.of(spark, sf_dir).texts).select("block_id", "prompt")


def _recorded(spark, sf_dir):
    """D7 over the recorded answers of all blocks with predictions."""
    from blocklens.operators.text_classifier import classify_recorded
    from blocklens.sources import fixtures
    return classify_recorded(_preds(spark, sf_dir, "llm"), fixtures.model_answers(spark, sf_dir))


@query("text_classify")
def q_text_classify(spark, sf_dir):
    """The class of every block from up to three recorded answers."""
    return _recorded(spark, sf_dir)


@query("stream_text_classify")
def q_stream_text_classify(spark, sf_dir):
    """S12/D8 as a stream: blocks arrive in files and are classified batch by
    batch; the first run dies between the answer and the commit of its second
    batch, the next one resumes; read back."""
    from pyspark.errors import StreamingQueryException

    from blocklens.operators.text_classifier import classify_recorded
    from blocklens.session import scratch_path
    from blocklens.sources import fixtures
    from blocklens.streaming import resume
    folder = scratch_path(spark, "stream-classify")
    blocks = _preds(spark, sf_dir, "llm").select("block_id", "label")
    resume.in_parts(blocks, 4).write.parquet(folder + "/in")
    answers = LogContext.of(spark, sf_dir).store.materialize(
        "model_answers", lambda: fixtures.model_answers(spark, sf_dir))

    def die(batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped between answer and commit")

    def run(after):
        query = resume.classify_stream(
            resume.file_stream(spark, folder + "/in", blocks.schema), folder + "/out", folder + "/checkpoint",
            lambda batch: classify_recorded(batch, answers), after)
        query.awaitTermination()

    try:
        run(die)
    except StreamingQueryException:
        pass
    run(None)
    return resume.read_answers(spark, folder + "/out")


@query("classify_failures")
def q_classify_failures(spark, sf_dir):
    from blocklens.operators.text_classifier import failure_count
    return failure_count(_recorded(spark, sf_dir))


@query("extract_json")
def q_extract_json(spark, sf_dir):
    """every recorded answer and what it parses to."""
    from blocklens.functions.text import answer_fields
    from blocklens.sources import fixtures
    return fixtures.model_answers(spark, sf_dir).withColumn(
        "a", answer_fields(F.col("raw_answer"))).select(
        "block_id", "attempt", "raw_answer", "a.classification", "a.confidence", "a.explanation")


# --- streaming (file-source stream run to completion) ------------------------------


def _lines(spark, sf_dir):
    return LogContext.of(spark, sf_dir).lines


@query("stream_event_counts")
def q_stream_event_counts(spark, sf_dir):
    """Hourly line counts per level, computed by a streaming query."""
    from blocklens.streaming import live
    return live.run_bounded(_lines(spark, sf_dir),
                            lambda s: live.level_rates(live.parse_stream(s)), "level-rates")


@query("stream_block_sessions")
def q_stream_block_sessions(spark, sf_dir):
    """Per-block sessions (30 min gap), computed by a streaming query."""
    from blocklens.streaming import live
    return live.run_bounded(_lines(spark, sf_dir),
                            lambda s: live.block_sessions(live.parse_stream(s)), "sessions")


@query("stream_severity_rates")
def q_stream_severity_rates(spark, sf_dir):
    """Alerts per severity in sliding hours: block sessions of the log stream,
    graded by the stored isolation-forest alerts, then windows over session ends;
    two stateful operators in one streaming query."""
    from blocklens.operators.alerts import alert_table
    from blocklens.streaming import live
    ctx = LogContext.of(spark, sf_dir)
    graded = ctx.store.materialize("graded_blocks", lambda: alert_table(
        _preds(spark, sf_dir, "isolation_forest"), "isolation_forest").select(
        "block_id", F.col("risk").alias("severity")))
    return live.run_bounded(ctx.lines, lambda s: live.severity_rates(live.graded_sessions(
        live.windowed_sessions(live.parse_stream(s)), graded)), "severity-rates")


@query("template_versions")
def q_template_versions(spark, sf_dir):
    """A dictionary grown by two mining runs over the halves of the log."""
    from blocklens.operators.dictionary import TemplateDictionary
    from blocklens.session import scratch_path
    masked = LogContext.of(spark, sf_dir).masked
    half = F.lit(masked.agg(F.expr("max(line_id) div 2")).first()[0])
    grown = TemplateDictionary(spark, scratch_path(spark, "dictionary"))
    grown.add_run(masked.where(F.col("line_id") <= half))
    grown.add_run(masked.where(F.col("line_id") > half))
    return grown.templates().select("event_id", "event_template", "since_version", "replaced_by", "occurrences")


@query("stream_dictionary")
def q_stream_dictionary(spark, sf_dir):
    """E1, the next mining run: a stream parsed against the templates of the INFO
    lines leaves unseen masks in a side table, which the next run adds; the
    stream's lines then all have an event."""
    from blocklens.operators.dictionary import TemplateDictionary
    from blocklens.session import scratch_path
    from blocklens.streaming import live
    ctx = LogContext.of(spark, sf_dir)
    grown = TemplateDictionary(spark, scratch_path(spark, "dictionary"))
    grown.add_run(ctx.masked.where(F.col("level") == "INFO"))
    path = scratch_path(spark, "unseen")
    live.run_bounded(ctx.lines, lambda s: live.parse_stream(s, grown.templates()), "dictionary",
                     lambda _: live.unseen_mask_sink(path))
    unseen = live.read_unseen_masks(spark, path).where(~F.col("template").startswith("end of input "))
    firsts = ctx.masked.groupBy("template").agg(F.min("line_id").alias("first_line_id"))
    grown.add_masks(unseen.join(firsts, "template").select("template", "first_line_id", F.col("n").alias("occurrences")))
    return tpl_ops.assign_events(ctx.masked, grown.mask_to_event()).groupBy("event_id", "event_template").agg(
        F.count(F.lit(1)).alias("n_lines"))


@query("stream_unseen_masks")
def q_stream_unseen(spark, sf_dir):
    """The stream parsed against templates frozen from the INFO lines; the
    masks it does not know go to a side table, which is read back."""
    from blocklens.session import scratch_path
    from blocklens.streaming import live
    ctx = LogContext.of(spark, sf_dir)
    known = tpl_ops.mask_templates(ctx.masked.where(F.col("level") == "INFO"))
    path = scratch_path(spark, "unseen")
    live.run_bounded(ctx.lines, lambda s: live.parse_stream(s, known), "unseen",
                     lambda _: live.unseen_mask_sink(path))
    return live.read_unseen_masks(spark, path).where(~F.col("template").startswith("end of input "))


def _session_scorer(spark, sf_dir):
    from blocklens.operators.iforest import forest_scorer
    ctx = LogContext.of(spark, sf_dir)
    nodes, psi = ctx.iforest
    names = [r[0] for r in ctx.vocabulary.orderBy("feature_index").select("feature_name").collect()]
    return forest_scorer(spark, nodes, psi), names


@query("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    """E1+E2+E4: the log stream is parsed against the frozen templates,
    counted per block session, scored by the trained isolation forest inside
    ``foreachBatch`` and written as alerts (one folder per micro-batch)."""
    from blocklens.streaming import live
    ctx = LogContext.of(spark, sf_dir)
    decision, names = _session_scorer(spark, sf_dir)
    vocab = [int(n[1:]) for n in names]
    out = live.run_bounded(
        ctx.lines, lambda s: live.session_counts(live.parse_stream(s, ctx.templates), vocab),
        "alerts", lambda path: live.scoring_alert_sink(path, decision, names))
    if out is None:       # an empty log
        return spark.createDataFrame([], "block_id string, session_start timestamp_ntz, "
                                         "session_end timestamp_ntz, n_events long, n_unseen long, "
                                         "score double, severity string")
    return out


# --- source round trips (text and CSV written to the shared folder, read back) -----


@query("raw_scan")
def q_raw_scan(spark, sf_dir):
    """The derived log written as text files in line order (a range-
    partitioned sort, many part files) and read back with dense line ids."""
    from blocklens.session import scratch_path
    from blocklens.sources.rawlog import read_raw_log
    path = scratch_path(spark, "raw-log")
    LogContext.of(spark, sf_dir).lines.orderBy("line_id").select("raw_content") \
        .write.text(path)
    return read_raw_log(spark, path).select("line_id", "raw_content")


@query("label_scan")
def q_label_scan(spark, sf_dir):
    """S3: block labels written as a CSV with padded header names and read
    back through the checked label loader."""
    from blocklens.session import scratch_path
    from blocklens.sources.labels import load_labels
    path = scratch_path(spark, "labels-csv")
    LogContext.of(spark, sf_dir).labels.toDF(" BlockId", "Label ") \
        .write.option("header", True).csv(path)
    return load_labels(spark, path)


# --- volume inputs (FIXTURES 2.4) ---------------------------------------------------

LINEITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("lineitem_sequences")
def q_lineitem_sequences(spark, sf_dir):
    """G1 at volume: per order, its part keys in line order."""
    from blocklens.sources import fixtures
    li = fixtures.read_table(spark, sf_dir, "lineitem")
    s = seq_ops.ordered_sequences(li, "l_orderkey", LINEITEM_ORDER, "l_partkey")
    return s.select("l_orderkey", F.array_join("values", " ").alias("part_sequence"),
                    F.col("n").alias("n_lines"))


def _document_lines(spark, sf_dir):
    """Every non-empty line of every document: (doc_id, line_no, content)."""
    from blocklens.sources import fixtures
    docs = fixtures.read_table(spark, sf_dir, "documents").select("doc_id", "text").repartition(
        spark.sparkContext.defaultParallelism)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "content"))
    return lines.where(F.col("content") != "").select(
        "doc_id", (F.col("_i") + 1).alias("line_no"), "content")


@query("document_templates")
def q_document_templates(spark, sf_dir):
    """T1+T3 over wide, low-repetition text: document lines masked, distinct
    masks ranked by first appearance (document, line)."""
    lines = tpl_ops.with_masks(_document_lines(spark, sf_dir))
    firsts = lines.groupBy("template").agg(
        F.min(F.struct("doc_id", "line_no")).alias("_first"),
        F.count(F.lit(1)).alias("occurrences"))
    keyed = firsts.select("template", "occurrences", F.col("_first.doc_id").alias("_d"),
                          F.col("_first.line_no").alias("_l"))
    from blocklens.operators.ordinals import dense_ordinal
    ranked = dense_ordinal(keyed, ["_d", "_l"], "event_id")
    return ranked.select(F.col("event_id").cast("int"), F.col("template").alias("event_template"),
                         "occurrences")


@query("document_mined_templates")
def q_document_mined_templates(spark, sf_dir):
    """T2 over wide, low-repetition text: templates mined from the distinct
    masks of all document lines (first appearance by document and line)."""
    lines = _document_lines(spark, sf_dir)
    # first appearance only needs an order-preserving key, not a dense one
    numbered = lines.withColumn(
        "line_id", F.shiftleft("doc_id", 24) + F.col("line_no"))
    ctx = LogContext.of(spark, sf_dir)
    mined = ctx.store.materialize("document_mined", lambda: tpl_ops.mined_masks(
        tpl_ops.with_masks(numbered)))
    t = tpl_ops.mined_from_masks(mined)[0]
    return t.select("event_id", "event_template", "occurrences")


@query("classification_counts")
def q_classification_counts(spark, sf_dir):
    """Value counts of the predicted class per model (NULL = invalid)."""
    out = None
    for m in MODELS:
        part = _preds(spark, sf_dir, m).groupBy(F.lit(m).alias("model"), "classification") \
            .agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("alert_summary")
def q_alert_summary(spark, sf_dir):
    """A4: alerts out of all predictions, per model."""
    out = None
    for m in MODELS:
        part = _preds(spark, sf_dir, m).agg(
            F.lit(m).alias("model"),
            F.count_if(F.col("classification") == "Anomaly").alias("n_alerts"),
            F.count(F.lit(1)).alias("n_predictions"))
        out = part if out is None else out.unionByName(part)
    return out
