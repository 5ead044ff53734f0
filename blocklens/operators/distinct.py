"""Approximate distinct counts (G6, opt-in): HyperLogLog sketches that can be
kept per day and merged later, instead of keeping or rescanning the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: 2 KB to 4 KB a sketch
LG_REGISTERS = 12


def daily_sketches(rows: DataFrame, day: str, key: str, lg: int = LG_REGISTERS) -> DataFrame:
    """(day, sketch binary): one mergeable sketch of the keys of each day."""
    return rows.groupBy(day).agg(F.hll_sketch_agg(key, lg).alias("sketch"))


def estimates(sketches: DataFrame, day: str) -> DataFrame:
    """(day, estimate) of every stored sketch."""
    return sketches.select(day, F.hll_sketch_estimate("sketch").alias("estimate"))


def merged_estimate(sketches: DataFrame) -> DataFrame:
    """(estimate): distinct keys over all the days given, from their sketches alone."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def error_bound(exact: Column, lg: int = LG_REGISTERS) -> Column:
    """Three standard errors (1.04 / sqrt(registers)) of a count, one at least."""
    return F.greatest(F.lit(1.0), exact * F.lit(3 * 1.04 / 2 ** (lg / 2)))
