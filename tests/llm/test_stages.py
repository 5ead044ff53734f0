"""Staged tables leave neither shuffle files nor a changed setting behind."""
import os

import numpy as np
from pyspark.sql import functions as F

from blocklens.llm import common, suffix_dedup


def shuffled(spark):
    """Names of the shuffle data files on this machine's disk."""
    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    root = jvm.blockManager().diskBlockManager().localDirs()[0].getPath()
    return {f for _, _, names in os.walk(root) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_staged_write_drops_its_own_shuffles(spark):
    rows = spark.range(20_000).withColumn("k", F.xxhash64("id") % 500)
    kept = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert kept.count() == 999                 # its shuffle stays for a later action
    before = shuffled(spark)
    got = common.stage(rows.groupBy("k").agg(F.min("id").alias("m")).groupBy("m").count(), "t-shuffles")
    assert shuffled(spark) <= before
    assert got.count() == 999
    assert kept.agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(common.CLEAN_SETTING, None) is None


def test_tables_of_powers_grow_with_the_texts():
    suffix_dedup._TABLES.clear()
    suffix_dedup.gram_hashes(np.zeros(300, np.uint8), 100)
    small = len(suffix_dedup._TABLES[0].up)
    data = np.arange(40_000, dtype=np.int64).astype(np.uint8)
    whole = suffix_dedup.gram_hashes(data, 100)
    assert small < len(data) <= len(suffix_dedup._TABLES[0].up)
    assert (whole[:201] == suffix_dedup.gram_hashes(data[:300], 100)).all()
