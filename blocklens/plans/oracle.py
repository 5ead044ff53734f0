"""DuckDB oracle SQL for the catalog queries.

The driver registers the parquet tables as views and runs these statements
next to the Spark queries.  The derived views (log lines, parsed lines,
labels, predictions) are spelled out as CTEs that mirror
:mod:`blocklens.sources.fixtures` expression for expression.  Regex patterns
come from the same constants as the Spark side.
"""

from __future__ import annotations

from blocklens.functions import parsing as P
from blocklens.functions import text as TX
from blocklens.operators import sequences as SEQ
from blocklens.operators.templates import SHARE_THRESHOLD, WORDS_PER_MASK

# The lookahead-free IP pattern is shared; DuckDB (RE2) reads \d \w \s \b as
# ASCII classes, which agree with the Unicode reading on ASCII logs.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _mask_sql(col: str) -> str:
    out = col
    for pattern, token in P.MASKS:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(token)}, 'g')"
    return f"regexp_replace(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


LOG_LINES = """
log_src AS (
  SELECT event_id, ts, user_id, event_type,
         'blk_' || CAST(CASE WHEN user_id % 2 = 0 THEN -(day(ts) + 100 * user_id)
                             ELSE day(ts) + 100 * user_id END AS VARCHAR) AS blk
  FROM events
),
log_lines AS (
  SELECT event_id + 1 AS line_id,
         strftime(ts, '%y%m%d') || ' ' || strftime(ts, '%H%M%S') || ' ' ||
         CAST(user_id AS VARCHAR) || ' ' ||
         CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END || ' svc.' || event_type ||
         CASE WHEN event_id % 101 = 0 THEN ' ' ELSE ': ' END ||
         CASE
           WHEN event_id % 97 = 0 THEN 'heartbeat ' || CAST(event_id AS VARCHAR) || ' ok'
           WHEN event_type = 'view' THEN 'recv block ' || blk || ' src: /10.0.' ||
                CAST(user_id % 256 AS VARCHAR) || '.1:' || CAST(user_id + 5000 AS VARCHAR) ||
                ' dest: /10.0.' || CAST(user_id % 256 AS VARCHAR) || '.2:50010'
           WHEN event_type = 'click' THEN 'responder ' || CAST(event_id % 3 AS VARCHAR) ||
                ' for block ' || blk || ' closing'
           WHEN event_type = 'purchase' THEN 'stored block ' || blk || ' size ' ||
                CAST(event_id * 7 AS VARCHAR) || ' at 10.0.0.1:1 10.0.0.2:2, 10.0.0.3'
           WHEN event_type = 'signup' THEN 'verify ok for ' || blk
           WHEN event_type = 'error' THEN 'write failed ' || blk ||
                ' java.io.IOException: reset ' || CAST(event_id AS VARCHAR)
         END AS raw_content
  FROM log_src
)"""

PARSED = f"""
parsed0 AS (
  SELECT line_id,
         regexp_extract(raw_content, {_q(P.HEADER_PATTERN)},
                        ['event_date', 'event_time', 'pid', 'level', 'component', 'content']) AS f
  FROM log_lines
  WHERE regexp_matches(raw_content, {_q(P.HEADER_PATTERN)})
),
parsed AS (
  SELECT line_id, f.event_date AS event_date, f.event_time AS event_time, f.pid AS pid,
         f.level AS level, f.component AS component, f.content AS content,
         NULLIF(regexp_extract(f.content, {_q(P.BLOCK_ID_PATTERN)}, 1), '') AS block_id
  FROM parsed0
),
masked AS (
  SELECT *, {_mask_sql('content')} AS template FROM parsed
),
templates AS (
  SELECT CAST(row_number() OVER (ORDER BY min(line_id)) AS INTEGER) AS event_id,
         template AS event_template, count(*) AS occurrences, min(line_id) AS first_line_id
  FROM masked GROUP BY template
),
assigned AS (
  SELECT m.*, t.event_id, t.event_template
  FROM masked m JOIN templates t ON m.template = t.event_template
),
block_seq AS (
  SELECT block_id,
         list(event_id ORDER BY line_id) AS events,
         string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY line_id) AS event_sequence,
         CAST(count(*) AS INTEGER) AS sequence_length
  FROM assigned WHERE block_id IS NOT NULL AND block_id <> ''
  GROUP BY block_id
),
block_labels AS (
  SELECT block_id,
         CASE WHEN count(*) FILTER (WHERE starts_with(content, 'write failed ')) >= 2
              THEN 'Anomaly' ELSE 'Normal' END AS label
  FROM parsed WHERE block_id IS NOT NULL
  GROUP BY block_id
  HAVING abs(CAST(substr(block_id, 5) AS BIGINT)) % 50 <> 0
),
labeled AS (
  SELECT s.*, l.label FROM block_seq s LEFT JOIN block_labels l USING (block_id)
)"""

BASE = "WITH RECURSIVE " + LOG_LINES.strip() + ",\n" + PARSED.strip() + "\n"


def _with(*extra: str) -> str:
    if not extra:
        return BASE
    return BASE.rstrip() + ",\n" + ",\n".join(e.strip() for e in extra) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["raw_head"] = BASE + """
SELECT line_id, raw_content FROM log_lines ORDER BY line_id LIMIT 100"""

ORACLE["parse_header"] = BASE + """
SELECT line_id, event_date, event_time, pid, level, component, content FROM parsed"""

ORACLE["parse_stats"] = BASE + f"""
SELECT
  (SELECT count(*) FROM parsed) AS n_processed,
  (SELECT count(*) FROM log_lines) - (SELECT count(*) FROM parsed) AS n_unmatched,
  (SELECT count(*) FROM parsed WHERE block_id IS NOT NULL) AS n_with_block,
  (SELECT count(DISTINCT template) FROM masked) AS n_templates"""

ORACLE["extract_block_id"] = BASE + "SELECT line_id, block_id FROM parsed"

ORACLE["drop_unkeyed"] = BASE + """
SELECT line_id, block_id FROM parsed WHERE block_id IS NOT NULL AND block_id <> ''"""

ORACLE["mask_content"] = BASE + "SELECT line_id, template FROM masked"

ORACLE["mask_templates"] = BASE + """
SELECT event_id, event_template, occurrences FROM templates"""

ORACLE["template_counts"] = BASE + """
SELECT event_id, event_template, count(*) AS occurrences FROM assigned
GROUP BY event_id, event_template"""

ORACLE["assign_events"] = BASE + """
SELECT line_id, block_id, event_id, event_template, event_date, event_time FROM assigned"""

ORACLE["distinct_blocks"] = BASE + """
SELECT count(DISTINCT block_id) AS n_blocks FROM parsed"""

ORACLE["block_sequences"] = BASE + """
SELECT block_id, event_sequence, sequence_length FROM block_seq"""

ORACLE["sequences_labeled"] = BASE + """
SELECT block_id, event_sequence, sequence_length, label FROM labeled"""

ORACLE["unlabeled_count"] = BASE + """
SELECT count(*) FILTER (WHERE label IS NULL) AS n_unlabeled, count(*) AS n_blocks FROM labeled"""

ORACLE["label_counts"] = BASE + """
SELECT label, count(*) AS n FROM block_labels GROUP BY label"""

ORACLE["label_lookup"] = BASE + """
SELECT block_id,
       arg_max(CASE WHEN starts_with(content, 'write failed ') THEN 'Anomaly' ELSE 'Normal' END,
               line_id) AS label
FROM parsed WHERE block_id IS NOT NULL AND block_id <> ''
GROUP BY block_id"""

ORACLE["event_positions"] = BASE + """
SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY line_id) AS INTEGER)
         AS position, event_id
FROM assigned WHERE block_id IS NOT NULL AND block_id <> ''"""

ORACLE["event_labels"] = BASE + """
SELECT block_id, string_agg('E' || CAST(event_id AS VARCHAR), ' ' ORDER BY line_id) AS event_labels
FROM assigned WHERE block_id IS NOT NULL AND block_id <> '' GROUP BY block_id"""

_ARROW = _q(TX.CHAIN_ARROW)
_MORE_A, _MORE_B = TX.CHAIN_MORE.split("{n}")
ORACLE["event_chain"] = BASE + f"""
SELECT block_id,
  array_to_string(list_transform(events[1:{TX.CHAIN_MAX_EVENTS}], lambda x: 'E' || CAST(x AS VARCHAR)),
                  {_ARROW}) ||
  CASE WHEN len(events) > {TX.CHAIN_MAX_EVENTS}
       THEN {_q(_MORE_A)} || CAST(len(events) - {TX.CHAIN_MAX_EVENTS} AS VARCHAR) || {_q(_MORE_B)}
       ELSE '' END AS event_chain
FROM block_seq"""

ORACLE["text_sequences"] = BASE + f"""
SELECT block_id,
  string_agg('Event ' || CAST(pos AS VARCHAR) || ': ' ||
             coalesce(event_template, {_q(SEQ.UNKNOWN_TEMPLATE)}), chr(10) ORDER BY pos)
    AS text_sequence
FROM (
  SELECT block_id, event_template,
         row_number() OVER (PARTITION BY block_id ORDER BY line_id) AS pos
  FROM assigned WHERE block_id IS NOT NULL AND block_id <> ''
) GROUP BY block_id"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- split, sample, features ---------------------------------------------------

def _quota_sql(name: str, src: str, n_draws: str) -> str:
    """Approximate-mode quotas over (label, n_c) of ``src``; ``n_draws`` may use n_total."""
    return f"""
{name}_counts AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
{name}_tot AS (SELECT sum(n_c) AS n_total FROM {name}_counts),
{name}_cont AS (
  SELECT c.label, c.n_c, t.n_total, CAST({n_draws} AS BIGINT) AS n_draws,
         (CAST(c.n_c AS DOUBLE) / t.n_total) * CAST({n_draws} AS BIGINT) AS cv
  FROM {name}_counts c, {name}_tot t
),
{name}_fl AS (SELECT *, floor(cv) AS fv FROM {name}_cont),
{name}_need AS (
  SELECT *, n_draws - sum(fv) OVER () AS need,
         row_number() OVER (ORDER BY cv - fv DESC, label) AS r
  FROM {name}_fl
),
{name}_quota AS (
  SELECT label, CAST(fv + CASE WHEN r <= need THEN 1 ELSE 0 END AS BIGINT) AS quota
  FROM {name}_need
)"""


SPLIT = _quota_sql("tr", "labeled WHERE label IS NOT NULL",
                   "n_total - ceil(CAST(0.2 AS DOUBLE) * n_total)") + """,
ranked AS (
  SELECT block_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5(block_id || ':42'), block_id) AS rk
  FROM labeled WHERE label IS NOT NULL
),
split_ids AS (
  SELECT r.block_id, r.label, CASE WHEN r.rk <= q.quota THEN 'train' ELSE 'test' END AS split
  FROM ranked r JOIN tr_quota q USING (label)
),
test_ids AS (SELECT block_id, label FROM split_ids WHERE split = 'test'),""" + \
    _quota_sql("sm", "test_ids", "least(1000, n_total)") + """,
sample_ids AS (
  SELECT block_id, label FROM (
    SELECT t.block_id, t.label, q.quota,
           row_number() OVER (PARTITION BY t.label ORDER BY md5(t.block_id || ':42'), t.block_id)
             AS rk
    FROM test_ids t JOIN sm_quota q USING (label)
  ) WHERE rk <= quota
),
be AS (
  SELECT block_id, line_id, event_id FROM assigned WHERE block_id IS NOT NULL AND block_id <> ''
),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY CAST(event_id AS VARCHAR)) AS INTEGER) AS feature_index,
         event_id, 'E' || CAST(event_id AS VARCHAR) AS feature_name
  FROM (SELECT DISTINCT event_id FROM be JOIN split_ids USING (block_id) WHERE split = 'train')
),
long_counts AS (
  SELECT c.block_id, s.split, s.label, v.feature_index, v.feature_name, c.n
  FROM (SELECT block_id, event_id, count(*) AS n FROM be GROUP BY block_id, event_id) c
  JOIN split_ids s USING (block_id) JOIN vocab v USING (event_id)
)"""

ORACLE["stratified_split"] = _with(SPLIT) + "SELECT block_id, label, split FROM split_ids"

ORACLE["stratified_sample"] = _with(SPLIT) + "SELECT block_id, label FROM sample_ids"

ORACLE["anomaly_rate"] = _with(SPLIT) + """
SELECT split, count(*) AS n_blocks, count(*) FILTER (WHERE label = 'Anomaly') AS n_anomaly,
       avg(CASE WHEN label = 'Anomaly' THEN 1 ELSE 0 END) AS anomaly_rate
FROM (SELECT split, label FROM split_ids UNION ALL SELECT 'sample', label FROM sample_ids)
GROUP BY split"""

ORACLE["restrict_to_ids"] = _with(SPLIT) + """
SELECT l.block_id, l.event_sequence, l.label
FROM labeled l SEMI JOIN test_ids t ON l.block_id = t.block_id"""

ORACLE["normal_only"] = _with(SPLIT) + """
SELECT block_id FROM split_ids WHERE split = 'train' AND label = 'Normal'"""

ORACLE["class_weights"] = _with(SPLIT) + """
SELECT label, n_c, CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c) AS weight
FROM (SELECT label, count(*) AS n_c FROM split_ids WHERE split = 'train' GROUP BY label)"""

ORACLE["train_vocabulary"] = _with(SPLIT) + """
SELECT feature_index, event_id, feature_name FROM vocab"""

ORACLE["count_matrix_long"] = _with(SPLIT) + """
SELECT block_id, split, label, feature_name, n FROM long_counts"""

ORACLE["count_matrix_wide"] = _with(SPLIT) + """
SELECT s.block_id, s.split, s.label, """ + ", ".join(
    f"CAST(coalesce(sum(l.n) FILTER (WHERE l.feature_name = 'E{i}'), 0) AS BIGINT) AS \"E{i}\""
    for i in range(1, 9)) + """
FROM split_ids s LEFT JOIN long_counts l USING (block_id)
GROUP BY s.block_id, s.split, s.label"""


# --- predictions ----------------------------------------------------------------

PREDS = """
preds_base AS (
  SELECT d.doc_id AS doc_id, block_id,
         CASE WHEN d.doc_id % 37 = 0 THEN NULL WHEN d.quality = 0 THEN 'Anomaly' ELSE 'Normal' END
           AS classification,
         CASE WHEN d.toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS label
  FROM (SELECT s.blk AS block_id,
               arg_min({'doc_id': l.doc_id, 'quality': l.quality, 'toxic': l.toxic}, l.doc_id) AS d
        FROM labels l JOIN log_src s ON s.event_id = l.doc_id GROUP BY s.blk)
),
if_preds AS (
  SELECT block_id, 0.5 - CAST(doc_id % 101 AS DOUBLE) / 100.0 AS score, classification, label,
         CAST(doc_id % 7 + 1 AS DOUBLE) / 1048576.0 AS inference_time_sec, doc_id
  FROM preds_base
),
rf_preds AS (
  SELECT block_id, CAST(doc_id % 101 AS DOUBLE) / 100.0 AS anomaly_probability, classification,
         label, CAST(doc_id % 5 + 1 AS DOUBLE) / 4194304.0 AS inference_time_sec, doc_id
  FROM preds_base
),
llm_preds AS (
  SELECT block_id, classification,
         CASE WHEN classification IS NULL THEN NULL
              WHEN doc_id % 11 = 0 THEN NULL
              WHEN doc_id % 13 = 0 THEN 'high'
              WHEN doc_id % 2 = 0 THEN CAST(doc_id % 101 AS VARCHAR) || '%'
              ELSE '0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') END AS confidence,
         'rule ' || CAST(doc_id % 3 AS VARCHAR) AS explanation,
         CASE WHEN classification IS NULL THEN 3 ELSE CAST(doc_id % 3 + 1 AS INTEGER) END AS attempts,
         classification IS NULL AS parse_failed, label,
         CAST(doc_id % 9 + 1 AS DOUBLE) * 0.5 AS inference_time_sec, doc_id
  FROM preds_base
),
norm_scores AS (
  SELECT 'isolation_forest' AS model, block_id, classification, label,
         CASE WHEN score IS NULL THEN NULL ELSE greatest(0.0, least(1.0, 0.5 - score)) END AS norm_score
  FROM if_preds
  UNION ALL
  SELECT 'random_forest', block_id, classification, label,
         CASE WHEN anomaly_probability IS NULL THEN NULL
              ELSE greatest(0.0, least(1.0, anomaly_probability)) END
  FROM rf_preds
  UNION ALL
  SELECT 'llm', block_id, classification, label, conf_norm FROM (
    SELECT *, CASE WHEN v IS NULL THEN NULL ELSE greatest(0.0, least(1.0, v)) END AS conf_norm
    FROM (
      SELECT *, CASE WHEN ends_with(s, '%') THEN
                       CASE WHEN regexp_full_match(bare, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                            THEN TRY_CAST(bare AS DOUBLE) / 100.0 END
                     WHEN regexp_full_match(s, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                       THEN TRY_CAST(s AS DOUBLE) END AS v
      FROM (SELECT *, regexp_replace(regexp_replace(s, '%+$', ''), '^\\s+|\\s+$', '', 'g') AS bare
            FROM (SELECT *, regexp_replace(confidence, '^\\s+|\\s+$', '', 'g') AS s FROM llm_preds))
    )
  )
),
sev AS (
  SELECT *, CASE WHEN norm_score IS NULL THEN 'UNKNOWN' WHEN norm_score >= 0.8 THEN 'HIGH'
                 WHEN norm_score >= 0.6 THEN 'MEDIUM' WHEN norm_score >= 0.4 THEN 'LOW'
                 ELSE 'NORMAL' END AS severity
  FROM norm_scores
),
all_preds AS (
  SELECT 'isolation_forest' AS approach, block_id, classification, label, inference_time_sec FROM if_preds
  UNION ALL SELECT 'random_forest', block_id, classification, label, inference_time_sec FROM rf_preds
  UNION ALL SELECT 'llm', block_id, classification, label, inference_time_sec FROM llm_preds
)"""


def _metrics_sql(src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {g}n_total, n_invalid,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0.0 END AS fpr,
  tp, fp, tn, fn, mean_inference_sec
FROM (
  SELECT {g}count(*) AS n_total,
    count(*) FILTER (WHERE classification IS NULL) AS n_invalid,
    count(*) FILTER (WHERE classification = 'Anomaly' AND label = 'Anomaly') AS tp,
    count(*) FILTER (WHERE classification = 'Anomaly' AND label <> 'Anomaly') AS fp,
    count(*) FILTER (WHERE classification = 'Normal' AND label = 'Normal') AS tn,
    count(*) FILTER (WHERE classification IS NOT NULL AND classification <> 'Anomaly'
                     AND label = 'Anomaly') AS fn,
    avg(inference_time_sec) FILTER (WHERE classification IS NOT NULL) AS mean_inference_sec
  FROM {src} {gb}
)"""


PBASE = _with(PREDS)

ORACLE["binary_metrics"] = PBASE + _metrics_sql("if_preds", None)

ORACLE["metrics_full"] = PBASE + _metrics_sql(
    "(SELECT * FROM all_preds WHERE approach <> 'llm')", "approach")

ORACLE["metrics_sample"] = PBASE.rstrip() + ",\n" + _quota_sql(
    "ps", "(SELECT block_id, label FROM if_preds)", "least(1000, n_total)").strip() + """,
psample AS (
  SELECT block_id FROM (
    SELECT p.block_id, q.quota,
           row_number() OVER (PARTITION BY p.label ORDER BY md5(p.block_id || ':42'), p.block_id)
             AS rk
    FROM if_preds p JOIN ps_quota q USING (label)
  ) WHERE rk <= quota
)
""" + _metrics_sql("(SELECT * FROM all_preds SEMI JOIN psample USING (block_id))", "approach")

ORACLE["crosstab"] = PBASE + """
SELECT label, classification, count(*) AS n FROM if_preds
WHERE label IS NOT NULL AND classification IS NOT NULL GROUP BY label, classification"""

ORACLE["headline"] = PBASE + """
SELECT m.approach AS model, m.n_total, d.n_detected, m.precision, m.recall, m.f1, m.fpr,
       m.mean_inference_sec
FROM (""" + _metrics_sql("all_preds", "approach") + """) m
JOIN (SELECT approach, count(*) FILTER (WHERE classification = 'Anomaly') AS n_detected
      FROM all_preds GROUP BY approach) d USING (approach)"""

ORACLE["normalize_scores"] = PBASE + """
SELECT model, block_id, norm_score FROM norm_scores WHERE model <> 'llm'"""

ORACLE["normalize_confidence"] = PBASE + """
SELECT t.block_id, t.confidence, n.norm_score
FROM llm_preds t JOIN norm_scores n ON n.model = 'llm' AND n.block_id = t.block_id"""

_SPELL = ", ".join(_q(s) for s in __import__(
    "blocklens.plans.catalog", fromlist=["RAW_CLASS_SPELLINGS"]).RAW_CLASS_SPELLINGS)
ORACLE["normalize_class"] = f"""
SELECT block_id, raw_class,
  CASE WHEN upper(regexp_replace(raw_class, '^\\s+|\\s+$', '', 'g')) IN ('NORMAL') THEN 'Normal'
       WHEN upper(regexp_replace(raw_class, '^\\s+|\\s+$', '', 'g'))
            IN ('ANOMALO', 'ANÔMALO', 'ANOMALY') THEN 'Anomaly' END AS classification
FROM (SELECT 'blk_' || CAST(doc_id AS VARCHAR) AS block_id,
             [{_SPELL}][doc_id % 6 + 1] AS raw_class FROM labels)"""

ORACLE["severity"] = PBASE + "SELECT model, block_id, norm_score, severity FROM sev"

ALERTS = """
alerts AS (
  SELECT s.block_id, 'ANOMALY' AS classification, round(s.norm_score, 4) AS score, s.model,
         coalesce(array_to_string(list_transform(b.events, lambda x: 'E' || CAST(x AS VARCHAR)), ' '),
                  '') AS events,
         s.severity
  FROM sev s LEFT JOIN block_seq b USING (block_id)
  WHERE s.classification = 'Anomaly'
)"""

ORACLE["alerts"] = _with(PREDS, ALERTS) + """
SELECT block_id, classification, score, model, events, severity FROM alerts"""

ORACLE["severity_counts"] = _with(PREDS, ALERTS) + """
SELECT model, severity, count(*) AS n FROM alerts GROUP BY model, severity"""

ORACLE["alerts_by_risk"] = PBASE + """
SELECT model, block_id, norm_score, severity AS risk FROM sev
WHERE classification = 'Anomaly' AND severity IN ('HIGH', 'MEDIUM', 'LOW', 'UNKNOWN')"""

ORACLE["top_alerts"] = PBASE + """
SELECT * FROM (
  SELECT model, block_id, norm_score, severity AS risk,
         row_number() OVER (PARTITION BY model ORDER BY norm_score DESC NULLS LAST, block_id)
           AS rank
  FROM sev
  WHERE classification = 'Anomaly' AND severity IN ('HIGH', 'MEDIUM', 'LOW', 'UNKNOWN')
) WHERE rank <= 20"""

ORACLE["block_detail"] = _with(PREDS) + f"""
SELECT p.model, p.block_id, p.raw_score, p.classification, p.label,
       p.classification = p.label AS correct,
       array_to_string(list_transform(b.events[1:{TX.CHAIN_MAX_EVENTS}],
                                      lambda x: 'E' || CAST(x AS VARCHAR)), {_ARROW}) ||
       CASE WHEN len(b.events) > {TX.CHAIN_MAX_EVENTS}
            THEN {_q(_MORE_A)} || CAST(len(b.events) - {TX.CHAIN_MAX_EVENTS} AS VARCHAR) || {_q(_MORE_B)}
            ELSE '' END AS event_chain,
       p.explanation
FROM (
  SELECT 'isolation_forest' AS model, block_id, printf('%.6f', score) AS raw_score, classification,
         label, CAST(NULL AS VARCHAR) AS explanation FROM if_preds
  UNION ALL
  SELECT 'random_forest', block_id, printf('%.6f', anomaly_probability), classification, label,
         NULL FROM rf_preds
  UNION ALL
  SELECT 'llm', block_id, confidence, classification, label, explanation FROM llm_preds
) p LEFT JOIN block_seq b USING (block_id)"""

ORACLE["resume_remaining"] = PBASE + """
SELECT DISTINCT block_id FROM parsed
WHERE block_id IS NOT NULL AND block_id NOT IN (SELECT block_id FROM llm_preds)"""

ORACLE["append_resumed"] = BASE + "SELECT block_id, sequence_length FROM block_seq"

ORACLE["write_once_read_back"] = _with(SPLIT) + "SELECT block_id, label, split FROM split_ids"

ORACLE["alerts_json_read_back"] = ORACLE["alerts"]

ORACLE["lookup_blocks"] = (
    "SELECT * FROM (" + ORACLE["block_detail"] + ") WHERE model = 'random_forest' AND block_id = "
    "(SELECT min(block_id) FROM (" + PBASE + "SELECT block_id FROM rf_preds))")


# --- text-model detector (recorded answers) ------------------------------------

from blocklens.operators import text_classifier as TC  # noqa: E402

_PRE, _POST = TC.PROMPT_TEMPLATE.split("{sequence}")
TEXTS = f"""
texts AS (
  SELECT l.block_id, t.text_sequence, l.label, l.sequence_length
  FROM labeled l JOIN (
    SELECT block_id,
      string_agg('Event ' || CAST(pos AS VARCHAR) || ': ' ||
                 coalesce(event_template, {_q(SEQ.UNKNOWN_TEMPLATE)}), chr(10) ORDER BY pos)
        AS text_sequence
    FROM (SELECT block_id, event_template,
                 row_number() OVER (PARTITION BY block_id ORDER BY line_id) AS pos
          FROM assigned WHERE block_id IS NOT NULL AND block_id <> '')
    GROUP BY block_id
  ) t USING (block_id)
  WHERE l.label IS NOT NULL
)"""

# expected (class, confidence, explanation) of each answer shape, by hand
_SHAPE_RESULTS = (
    ("'Normal'", "'0.9'", "NULL"), ("'Anomaly'", "n || '%'", "NULL"), ("'Anomaly'", "NULL", "NULL"),
    ("'Anomaly'", "NULL", "'case ' || n"), *[("NULL", "NULL", "NULL")] * 7,
    ("'Anomaly'", "NULL", "NULL"), ("'Normal'", "NULL", "NULL"), *[("NULL", "NULL", "NULL")] * 2)


def _by_shape(values) -> str:
    return "CASE shape " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


from blocklens.sources.fixtures import ANSWER_SHAPES  # noqa: E402

ANSWERS = f"""
answer_shapes AS (
  SELECT block_id, label, attempt, (doc_id + 4 * (attempt - 1)) % {len(ANSWER_SHAPES)} AS shape,
         CAST(doc_id % 100 AS VARCHAR) AS n
  FROM preds_base, (VALUES (1), (2), (3)) AS t(attempt)
),
answers AS (
  SELECT block_id, label, attempt,
    replace([{", ".join(_q(x) for x in ANSWER_SHAPES)}][shape + 1], '%d', n) AS raw_answer,
    {_by_shape([r[0] for r in _SHAPE_RESULTS])} AS classification,
    {_by_shape([r[1] for r in _SHAPE_RESULTS])} AS confidence,
    {_by_shape([r[2] for r in _SHAPE_RESULTS])} AS explanation
  FROM answer_shapes
),
resolved AS (
  SELECT b.block_id, b.label, a.classification, a.confidence, a.explanation,
         CAST(coalesce(a.attempt, 3) AS INTEGER) AS attempts,
         a.classification IS NULL AS parse_failed
  FROM preds_base b LEFT JOIN (
    SELECT * FROM answers WHERE classification IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY attempt) = 1) a USING (block_id)
)"""

ORACLE["build_prompts"] = _with(TEXTS) + f"""
SELECT block_id, {_q(_PRE)} || text_sequence || {_q(_POST)} AS prompt FROM texts"""

ORACLE["text_classify"] = _with(PREDS, ANSWERS) + """
SELECT block_id, classification, confidence, explanation, attempts, parse_failed, label
FROM resolved"""

ORACLE["classify_failures"] = _with(PREDS, ANSWERS) + """
SELECT count(*) FILTER (WHERE parse_failed) AS n_parse_failed, count(*) AS n_total FROM resolved"""

ORACLE["extract_json"] = _with(PREDS, ANSWERS) + """
SELECT block_id, CAST(attempt AS INTEGER) AS attempt, raw_answer, classification, confidence,
       explanation
FROM answers"""


# --- streaming equivalents ----------------------------------------------------------

EVENT_TS = """
ts_lines AS (
  SELECT block_id, level, strptime(event_date || event_time, '%y%m%d%H%M%S') AS event_ts
  FROM parsed
)"""

ORACLE["stream_event_counts"] = _with(EVENT_TS) + """
SELECT time_bucket(INTERVAL 1 hour, event_ts) AS window_start,
       time_bucket(INTERVAL 1 hour, event_ts) + INTERVAL 1 hour AS window_end,
       level, count(*) AS n
FROM ts_lines GROUP BY ALL"""

ORACLE["stream_block_sessions"] = _with(EVENT_TS) + """
SELECT block_id, min(event_ts) AS session_start,
       max(event_ts) + INTERVAL 30 minute AS session_end, count(*) AS n
FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR event_ts >= prev + INTERVAL 30 minute THEN 1 ELSE 0 END)
              OVER (PARTITION BY block_id ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS sid
  FROM (SELECT *, lag(event_ts) OVER (PARTITION BY block_id ORDER BY event_ts) AS prev
        FROM ts_lines WHERE block_id IS NOT NULL)
) GROUP BY block_id, sid"""

ORACLE["stream_severity_rates"] = _with(PREDS, EVENT_TS, """
sessions AS (""" + ORACLE["stream_block_sessions"].split(EVENT_TS.strip())[1].strip() + """
),
graded AS (
  SELECT block_id, CASE WHEN s >= 0.8 THEN 'HIGH' WHEN s >= 0.6 THEN 'MEDIUM' WHEN s >= 0.4 THEN 'LOW'
                        ELSE 'NORMAL' END AS severity
  FROM (SELECT block_id, greatest(0.0, least(1.0, 0.5 - score)) AS s FROM if_preds
        WHERE classification = 'Anomaly')
),
placed AS (
  SELECT severity, time_bucket(INTERVAL 30 minute, session_end - INTERVAL 1 microsecond) AS slot
  FROM sessions JOIN graded USING (block_id)
)""") + """
SELECT slot - k * INTERVAL 30 minute AS window_start, slot - k * INTERVAL 30 minute + INTERVAL 1 hour AS window_end,
       severity, count(*) AS n_alerts
FROM placed, range(2) AS r(k) GROUP BY ALL"""

ORACLE["approx_distinct_blocks"] = BASE + """
SELECT event_date, count(DISTINCT block_id) AS n_blocks, true AS within_bound FROM parsed GROUP BY event_date
UNION ALL SELECT 'all', count(DISTINCT block_id), true FROM parsed"""

CHUNKED = _with("""
chunked AS (
  SELECT block_id, event_id, event_template, line_id >> 6 AS chunk,
         row_number() OVER (PARTITION BY block_id ORDER BY line_id) AS position
  FROM assigned WHERE block_id IS NOT NULL AND block_id <> ''
)""")

ORACLE["chunk_positions"] = CHUNKED + "SELECT block_id, position, event_id FROM chunked"

ORACLE["text_chunks"] = CHUNKED + """
SELECT block_id, chunk, min(position) AS first_position,
       string_agg('Event ' || position || ': ' || event_template, chr(10) ORDER BY position) AS text
FROM chunked GROUP BY block_id, chunk"""

ORACLE["stream_text_classify"] = ORACLE["text_classify"]

ORACLE["template_versions"] = BASE + """
SELECT event_id, event_template,
       CAST(CASE WHEN first_line_id <= (SELECT max(line_id) // 2 FROM masked) THEN 1 ELSE 2 END AS INTEGER)
         AS since_version, CAST(NULL AS INTEGER) AS replaced_by, occurrences
FROM templates"""

ORACLE["stream_dictionary"] = BASE + """
SELECT CAST(row_number() OVER (ORDER BY version, first_line_id) AS INTEGER) AS event_id,
       template AS event_template, n_lines
FROM (SELECT template, min(CASE WHEN level = 'INFO' THEN 1 ELSE 2 END) AS version, count(*) AS n_lines,
             coalesce(min(line_id) FILTER (level = 'INFO'), min(line_id)) AS first_line_id
      FROM masked GROUP BY template)"""

ORACLE["raw_scan"] = BASE + "SELECT line_id, raw_content FROM log_lines"

ORACLE["label_scan"] = BASE + "SELECT block_id, label FROM block_labels"

ORACLE["lineitem_sequences"] = """
SELECT l_orderkey,
       string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey,
                  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
                  l_shipdate) AS part_sequence,
       count(*) AS n_lines
FROM lineitem GROUP BY l_orderkey"""

ORACLE["document_templates"] = f"""
WITH doc_lines AS (
  SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS content
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS t(i)
),
m AS (SELECT doc_id, line_no, {_mask_sql('content')} AS template FROM doc_lines WHERE content <> '')
SELECT CAST(row_number() OVER (ORDER BY min(doc_id * 1000000000 + line_no)) AS INTEGER) AS event_id,
       template AS event_template, count(*) AS occurrences
FROM m GROUP BY template"""

ORACLE["classification_counts"] = PBASE + """
SELECT approach AS model, classification, count(*) AS n FROM all_preds
GROUP BY approach, classification"""

ORACLE["alert_summary"] = PBASE + """
SELECT approach AS model, count(*) FILTER (WHERE classification = 'Anomaly') AS n_alerts,
       count(*) AS n_predictions
FROM all_preds GROUP BY approach"""


# --- mined templates ---------------------------------------------------------------


def _mined_sql(source: str) -> str:
    """CTEs from ``source`` (line_id, template): mined(template, occurrences,
    first_line_id, event_template) and mined_templates with their ids.  A level
    of the recursion is one round of splits; rows that are not open are final."""
    return f"""
distinct_masks AS (
  SELECT template, min(line_id) AS first_line_id, count(*) AS occurrences,
         CASE WHEN template = '' THEN [] ELSE string_split(template, ' ') END AS tokens
  FROM {source} GROUP BY template
),
partitioned AS (
  SELECT template, tokens, len(tokens) || ' ' ||
         CASE WHEN regexp_matches(coalesce(tokens[1], ''), '[0-9]') THEN {_q(P.WILDCARD)}
              ELSE coalesce(tokens[1], '') END AS grp, true AS live
  FROM distinct_masks
  UNION ALL
  SELECT p.template, p.tokens,
         CASE WHEN s.place IS NULL THEN p.grp ELSE p.grp || ' ' || s.place || ' ' || p.tokens[s.place] END,
         s.place IS NOT NULL
  FROM partitioned p LEFT JOIN (
    SELECT grp, min(place) FILTER (words = least_words) AS place
    FROM (
      SELECT grp, place, words, masks, count(*) OVER own AS n_tokens,
             count(*) FILTER (words = 1) OVER own AS fixed,
             min(words) FILTER (words > 1) OVER own AS least_words
      FROM (
        SELECT grp, place, count(DISTINCT token) AS words, count(*) AS masks
        FROM (SELECT grp, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
              FROM partitioned WHERE live)
        GROUP BY grp, place)
      WINDOW own AS (PARTITION BY grp))
    WHERE fixed < {SHARE_THRESHOLD} * n_tokens AND least_words <= {WORDS_PER_MASK} * masks
    GROUP BY grp) s USING (grp)
  WHERE p.live
),
clusters AS (SELECT template, tokens, grp FROM partitioned WHERE NOT live),
cluster_words AS (
  SELECT grp, place, CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE {_q(P.WILDCARD)} END AS word
  FROM (SELECT grp, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM clusters)
  GROUP BY grp, place
),
mined AS (
  SELECT d.template, d.first_line_id, d.occurrences, coalesce(k.event_template, '') AS event_template
  FROM distinct_masks d JOIN clusters c USING (template) LEFT JOIN (
    SELECT grp, string_agg(word, ' ' ORDER BY place) AS event_template
    FROM cluster_words GROUP BY grp) k USING (grp)
),
mined_templates AS (
  SELECT CAST(row_number() OVER (ORDER BY min(first_line_id)) AS INTEGER) AS event_id,
         event_template, CAST(sum(occurrences) AS BIGINT) AS occurrences
  FROM mined GROUP BY event_template
)"""


MINED = _with(_mined_sql("masked"))

ORACLE["mine_templates"] = MINED + "SELECT event_id, event_template, occurrences FROM mined_templates"

MINED_LINES = MINED.rstrip() + """,
mined_lines AS (
  SELECT m.line_id, m.block_id, t.event_id, t.event_template
  FROM masked m JOIN mined d USING (template) JOIN mined_templates t
    ON t.event_template = d.event_template
)
"""

ORACLE["mined_events"] = MINED_LINES + "SELECT line_id, block_id, event_id, event_template FROM mined_lines"

ORACLE["mined_sequences"] = MINED_LINES + """
SELECT block_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY line_id) AS event_sequence,
       CAST(count(*) AS INTEGER) AS sequence_length
FROM mined_lines WHERE block_id IS NOT NULL AND block_id <> '' GROUP BY block_id"""

ORACLE["document_mined_templates"] = f"""
WITH RECURSIVE doc_lines AS (
  SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS content
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS t(i)
),
document_masks AS (
  SELECT (doc_id << 24) + line_no AS line_id, {_mask_sql('content')} AS template
  FROM doc_lines WHERE content <> ''
),
""" + _mined_sql("document_masks").strip() + """
SELECT event_id, event_template, occurrences FROM mined_templates"""


# --- detectors: facts that hold for any correct model ----------------------------------

ORACLE["iforest_facts"] = _with(SPLIT) + """
SELECT CAST(t AS INTEGER) AS tree_id,
       (SELECT least(256, count(*)) FROM split_ids WHERE split = 'train' AND label = 'Normal')
         AS n_sampled, true AS leaves_add_up, true AS depth_kept
FROM range(100) AS r(t)"""

ORACLE["iforest_score_facts"] = _with(SPLIT) + """
SELECT block_id, label, true AS class_follows, true AS equal_scores, true AS timed
FROM split_ids WHERE split = 'test'"""

ORACLE["rf_score_facts"] = ORACLE["iforest_score_facts"]

ORACLE["rf_facts"] = _with(SPLIT) + """
SELECT CAST(100 AS BIGINT) AS n_trees, (SELECT count(*) FROM vocab) AS n_features, true AS adds_up"""

ORACLE["detector_crosstab_totals"] = _with(SPLIT) + """
SELECT model, label, count(*) AS n
FROM split_ids, (VALUES ('isolation_forest'), ('random_forest')) AS m(model)
WHERE split = 'test' GROUP BY model, label"""

# the label of a block follows from its number of failed writes, which is one feature
ORACLE["rf_confusion"] = _with(SPLIT) + """
SELECT label, label AS classification, count(*) AS n FROM split_ids WHERE split = 'test' GROUP BY label"""

ORACLE["rf_alerts"] = _with(SPLIT) + """
SELECT s.block_id, 'ANOMALY' AS classification, 'random_forest' AS model,
       array_to_string(list_transform(b.events, lambda e: 'E' || e), ' ') AS events,
       true AS above_half, true AS graded
FROM split_ids s JOIN block_seq b USING (block_id) WHERE s.split = 'test' AND s.label = 'Anomaly'"""

ORACLE["iforest_crosstab_by_score"] = _with(SPLIT) + """
SELECT label, count(*) AS n, count(*) AS n_as_signed, count(*) AS n_in_range
FROM split_ids WHERE split = 'test' GROUP BY label"""

ORACLE["stream_unseen_masks"] = BASE + """
SELECT template, count(*) AS n FROM masked
WHERE template NOT IN (SELECT template FROM masked WHERE level = 'INFO') GROUP BY template"""
