"""Exact-size stratified split and sample.

Sizes follow the usual "approximate mode" rule of stratified shuffle splits:
per class ``floor(n_draws * n_c / N)`` and the leftover draws go to the classes
with the largest fractional parts (ties by class name -- deterministic instead
of random).  Membership is decided by a seeded hash order: rows are ranked
inside their class by ``md5(key || ':' || seed)`` (then key), and the first
``quota`` rows are drawn.

Scale: ranking a class with one window would put the whole class (97 % of
rows for log labels) into one task.  Instead the hash prefix (4 hex digits)
splits each class into 65,536 equal buckets: bucket sizes are counted (tiny
table), prefix-summed per class, broadcast back, and ``row_number`` runs only
within a (class, bucket) -- a uniform, bounded group.  Rank in class =
rows in earlier buckets + rank in bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
TEST_SIZE = 0.2
SAMPLE_SIZE = 1000
HASH_PREFIX = 4   # hex digits -> 16**4 buckets per class


def hash_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def class_counts(df: DataFrame, strata: str) -> DataFrame:
    return df.groupBy(strata).agg(F.count(F.lit(1)).alias("n_c"))


def approximate_mode(counts: DataFrame, n_draws: F.Column, strata: str) -> DataFrame:
    """Per-class quota for ``n_draws`` rows (``counts`` = (strata, n_c), tiny).

    ``n_draws`` may refer to the column ``n_total`` (sum of n_c).
    """
    total = Window.partitionBy(F.lit(0))
    staged = counts.withColumn("n_total", F.sum("n_c").over(total))
    staged = staged.withColumn("_draws", n_draws.cast("long"))
    cont = (F.col("n_c") / F.col("n_total")) * F.col("_draws")
    staged = staged.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont"))
    staged = staged.withColumn("_need", F.col("_draws") - F.sum("_floor").over(total))
    order = Window.partitionBy(F.lit(0)).orderBy(
        (F.col("_cont") - F.col("_floor")).desc(), F.col(strata))
    staged = staged.withColumn("_r", F.row_number().over(order))
    quota = F.col("_floor") + F.when(F.col("_r") <= F.col("_need"), 1).otherwise(0)
    return staged.select(strata, "n_c", "n_total", quota.cast("long").alias("quota"))


def rank_in_class(df: DataFrame, strata: str, key: str = "block_id",
                  seed: int = SEED) -> DataFrame:
    """Add ``class_rank`` (1-based) by the seeded hash order inside each class."""
    keyed = df.withColumn("_h", hash_key(key, seed)) \
        .withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    sizes = keyed.groupBy(strata, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(strata).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    in_bucket = Window.partitionBy(strata, "_b").orderBy("_h", key)
    # sizes: <= 16**HASH_PREFIX rows per class; AQE broadcasts it from its
    # measured size (no hint: the class count is not bounded by us)
    ranked = keyed.join(sizes.drop("_bn"), [strata, "_b"]) \
        .withColumn("class_rank", F.col("_before") + F.row_number().over(in_bucket))
    return ranked.drop("_h", "_b", "_before")


def stratified_split(df: DataFrame, strata: str = "label", key: str = "block_id",
                     test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Add ``split`` in {train, test}; test = ceil(test_size * N) rows.

    Rows with a NULL stratum cannot be placed and are left out.
    """
    clean = df.where(F.col(strata).isNotNull())
    counts = class_counts(clean, strata)
    n_test = F.ceil(F.lit(float(test_size)) * F.col("n_total"))
    quotas = approximate_mode(counts, F.col("n_total") - n_test, strata)
    quotas = _check_quotas(quotas, strata)
    ranked = rank_in_class(clean, strata, key, seed)
    out = ranked.join(F.broadcast(quotas.select(strata, "quota")), strata)
    return out.withColumn(
        "split", F.when(F.col("class_rank") <= F.col("quota"), F.lit("train"))
        .otherwise(F.lit("test"))).drop("quota", "class_rank")


def stratified_sample(df: DataFrame, size: int = SAMPLE_SIZE, strata: str = "label",
                      key: str = "block_id", seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows (when N >= size), class shares kept.

    The bucket counts (a map-side aggregate) say in which hash bucket a class's
    quota ends.  Rows of later buckets are filtered out in the scan's stage, so
    only about ``size`` rows and the boundary bucket are shuffled and ranked.
    """
    clean = df.where(F.col(strata).isNotNull())
    keyed = clean.withColumn("_h", hash_key(key, seed)).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    sizes = keyed.groupBy(strata, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    per_class = sizes.groupBy(strata).agg(F.sum("_bn").alias("n_c"))
    quotas = approximate_mode(per_class, F.least(F.lit(int(size)), F.col("n_total")), strata)
    upto = Window.partitionBy(strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = sizes.withColumn("_before", F.coalesce(F.sum("_bn").over(upto), F.lit(0))).join(
        quotas.select(strata, "quota"), strata).where(F.col("_before") < F.col("quota")) \
        .groupBy(strata).agg(F.max("_b").alias("_end"), F.max("quota").alias("_quota"))
    near = keyed.join(ends, strata).where(F.col("_b") <= F.col("_end")).join(
        sizes.select(strata, "_b", F.coalesce(F.sum("_bn").over(upto), F.lit(0)).alias("_before")),
        [strata, "_b"])
    # ranked within a hash bucket, behind the rows of the buckets before it
    order = Window.partitionBy(strata, "_b").orderBy("_h", key)
    return near.withColumn("_r", F.col("_before") + F.row_number().over(order)).where(
        F.col("_r") <= F.col("_quota")).select(df.columns)


def _check_quotas(quotas: DataFrame, strata: str) -> DataFrame:
    """A class with fewer than 2 members cannot be split: fail the job lazily
    (no extra pass over the data just for the check)."""
    bad = F.raise_error(F.concat(F.lit("class with fewer than 2 members cannot be split: "),
                                 F.col(strata).cast("string")))
    return quotas.withColumn("quota", F.when(F.col("n_c") < 2, bad.cast("long"))
                             .otherwise(F.col("quota")))
