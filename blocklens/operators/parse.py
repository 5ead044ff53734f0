"""Line parsing: header split, unmatched filter, block ids, missing-key filter.

One narrow, codegen'd projection over the line scan; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.functions import parsing as P


def parse_lines(lines: DataFrame, keep_unmatched: bool = False,
                limit: int | None = None) -> DataFrame:
    """``(line_id, raw_content)`` -> one row per header-matching line.

    Output: line_id, event_date, event_time, pid, level, component, content,
    block_id (NULL when the content has no block id), event_ts.
    With ``keep_unmatched`` the non-matching lines are kept with a false
    ``matched`` flag and NULL fields (used for the run statistics).
    ``limit`` keeps the first ``limit`` *matched* lines by line id (a top-k,
    planned per partition and merged, not a global sort).
    """
    raw = F.col("raw_content")
    joined = lines.select("line_id", raw, P.header_joined(raw).alias("_j"))
    staged = joined.select(
        "line_id",
        (F.col("_j") != F.col("raw_content")).alias("matched"),
        F.split(F.col("_j"), ":", 6).alias("_f"),
    )
    if not keep_unmatched:
        staged = staged.where("matched")
    fields = [F.when(F.col("matched"), F.try_element_at("_f", F.lit(i + 1))).alias(name)
              for i, name in enumerate(P.HEADER_FIELDS)]
    parsed = staged.select("line_id", "matched", *fields)
    parsed = parsed.select(
        "*",
        P.block_id(F.col("content")).alias("block_id"),
        P.event_timestamp(F.col("event_date"), F.col("event_time")).alias("event_ts"),
    )
    out = parsed if keep_unmatched else parsed.drop("matched")
    if limit is not None:
        out = out.where(F.col("matched")) if keep_unmatched else out
        out = out.orderBy("line_id").limit(limit)
    return out


def parse_stats(lines: DataFrame, with_templates: bool = False) -> DataFrame:
    """Run statistics in one pass over the lines.

    n_processed (header matched), n_unmatched, n_with_block and, optionally,
    n_templates = number of distinct masks among matched lines.
    """
    raw = F.col("raw_content")
    joined = lines.select(raw, P.header_joined(raw).alias("_j"))
    m = F.col("_j") != F.col("raw_content")
    content = F.when(m, F.try_element_at(F.split(F.col("_j"), ":", 6), F.lit(6)))
    staged = joined.select(m.alias("m"), content.alias("content"))
    aggs = [
        F.count_if("m").alias("n_processed"),
        F.count_if(~F.col("m")).alias("n_unmatched"),
        F.count_if(P.block_id(F.col("content")).isNotNull()).alias("n_with_block"),
    ]
    if with_templates:
        template = P.normalize_tokens(P.mask(F.col("content")))
        aggs.append(F.count_distinct(template).alias("n_templates"))
    return staged.agg(*aggs)


def observed_lines(lines: DataFrame, observation) -> DataFrame:
    """``lines`` with the run's figures as metrics of whatever pass reads them:
    n_lines, n_processed and n_unmatched (P2, T6), last (latest event time).

    ``observation`` is an ``Observation`` of a batch, or a name on a stream,
    whose figures stand in the query's progress.
    """
    # one column a step, so the header's regex runs once per line
    read = lines.select("*", P.header_joined(F.col("raw_content")).alias("_j"))
    read = read.select(*lines.columns, (F.col("_j") != F.col("raw_content")).alias("_ok"),
                       F.split("_j", ":", 6).alias("_f"))
    at = P.event_timestamp(F.try_element_at("_f", F.lit(1)), F.try_element_at("_f", F.lit(2)))
    read = read.select(*lines.columns, "_ok", F.when(F.col("_ok"), at).alias("_at"))
    return read.observe(observation, F.count(F.lit(1)).alias("n_lines"), F.count_if("_ok").alias("n_processed"),
                        F.count_if(~F.col("_ok")).alias("n_unmatched"), F.max("_at").alias("last")).drop("_ok", "_at")


def parse_figures() -> list:
    """Figures of parsed lines (with unmatched ones), for the pass that writes them."""
    return [F.count_if("matched").alias("n_processed"), F.count_if(~F.col("matched")).alias("n_unmatched"),
            F.count_if(F.col("block_id").isNotNull()).alias("n_with_block")]


def drop_unkeyed(parsed: DataFrame, key: str = "block_id") -> DataFrame:
    """Rows with a usable key (neither NULL nor empty)."""
    k = F.col(key)
    return parsed.where(k.isNotNull() & (k != F.lit("")))


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` non-empty lines by line id (a top-k, not a full sort)."""
    return lines.orderBy("line_id").limit(n)
