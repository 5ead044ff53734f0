"""What a stream of alerts does for each line and each (block, tree) stays in generated code."""
import random

from pyspark.sql import functions as F

from blocklens.operators.iforest import sample_per_tree
from blocklens.operators.parse import observed_lines


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_the_smallest_keys_without_a_lambda_per_pair(spark):
    draw = random.Random(2)
    rows = spark.createDataFrame([(f"blk_{draw.randrange(10 ** 9)}", i) for i in range(300)], "block_id string, v int")
    got = sample_per_tree(rows, 300, 7, 20, 42)
    assert "lambda" not in _plan(got)
    keys = [rows.select("block_id", (F.pmod(F.xxhash64(F.lit(42), F.lit(t), "block_id"), F.lit(1 << 53))
                                     / F.lit(float(1 << 53))).alias("u")).collect() for t in range(7)]
    want = {(t, r.block_id, r.u) for t in range(7) for r in sorted(keys[t], key=lambda r: (r.u, r.block_id))[:20]}
    assert {(r.tree_id, r.block_id, r.u) for r in got.collect()} == want


def test_the_header_of_an_observed_line_is_matched_once(spark):
    lines = spark.createDataFrame([(1, "240101 000000 1 INFO svc: open blk_5"), (2, "no header"), (3, None)],
                                  "line_id long, raw_content string")
    seen = observed_lines(lines, "figures")
    assert _plan(seen).count("regexp_replace") == 1
    assert seen.columns == lines.columns and sorted(seen.collect()) == sorted(lines.collect())
