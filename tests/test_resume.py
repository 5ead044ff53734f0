"""The streamed form of append and resume: each block is answered once over restarts."""
import collections

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from blocklens.streaming import resume


@pytest.mark.parametrize("moment", ["before the answer", "after the answer"])
def test_a_run_killed_at_any_moment_repeats_and_loses_no_block(spark, tmp_dir, moment):
    blocks = spark.range(40).select(F.concat(F.lit("blk_"), "id").alias("block_id"))
    resume.in_parts(blocks, 4).write.parquet(tmp_dir + "/in/a")
    asked = collections.Counter()

    def classify(batch, dying):
        if dying and moment == "before the answer" and asked:
            raise RuntimeError("killed")
        asked.update(r.block_id for r in batch.collect())
        return batch.withColumn("classification", F.lit("Normal"))

    def run(dying):
        after = None
        if dying and moment == "after the answer":
            def after(batch_id):
                if batch_id == 1:
                    raise RuntimeError("killed")
        stream = resume.file_stream(spark, tmp_dir + "/in/*", blocks.schema)
        resume.classify_stream(stream, tmp_dir + "/out", tmp_dir + "/ck", lambda b: classify(b, dying),
                               after).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(True)
    assert 0 < len(asked) < 40
    run(False)
    # new files go on from there; a block that comes again is not asked again
    blocks.unionByName(spark.createDataFrame([("blk_new",)], "block_id string")).coalesce(1).write.parquet(
        tmp_dir + "/in/b")
    run(False)
    got = [r.block_id for r in resume.read_answers(spark, tmp_dir + "/out").collect()]
    assert len(got) == len(set(got)) == 41 and set(asked.values()) == {1}
