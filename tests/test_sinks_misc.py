"""CSV export of multi-line text, sign labels, stream-static lookup, replayed batches."""
import os

from pyspark.sql import functions as F

from blocklens.functions.scores import label_from_sign
from blocklens.operators.parse import parse_lines
from blocklens.operators.templates import mask_templates, with_masks
from blocklens.sources.sinks import export_csv, read_csv_export
from blocklens.streaming import live


def test_multiline_csv_round_trip(spark, tmp_dir):
    rows = [("b1", 'Event 1: a "quoted" x\nEvent 2: b, c', "Normal"),
            ("b2", "Event 1: only", "Anomaly")]
    df = spark.createDataFrame(rows, "block_id string, text_sequence string, label string")
    p = os.path.join(tmp_dir, "texts")
    export_csv(df, p)
    back = read_csv_export(spark, p, "block_id string, text_sequence string, label string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_label_from_sign(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,)], "p int")
    assert [r[0] for r in df.select(label_from_sign(F.col("p"))).collect()] == \
        ["Normal", "Anomaly", None]


def test_stream_static_template_lookup(spark, tmp_dir):
    known = ["081109 203615 1 INFO a: open blk_1 from 10.0.0.1",
             "081109 203616 1 INFO a: close blk_1"]
    lines = spark.createDataFrame(list(enumerate(known, start=1)),
                                  "line_id long, raw_content string")
    templates = mask_templates(with_masks(parse_lines(lines)))
    src = os.path.join(tmp_dir, "logs")
    os.makedirs(src)
    with open(os.path.join(src, "a.log"), "w") as f:
        f.write("081109 203617 2 INFO a: open blk_2 from 10.0.0.9\n"
                "081109 203618 2 INFO a: something new 5\n")
    parsed = live.parse_stream(live.text_stream(spark, src), templates)
    out = os.path.join(tmp_dir, "out")
    q = (parsed.select("template", "event_id").writeStream.foreachBatch(live.idempotent_alert_sink(out))
         .option("checkpointLocation", out + "-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).drop("batch_id")
    res = {r["template"]: r["event_id"] for r in got.collect()}
    assert res["open <BLOCK_ID> from <IP>"] == 1
    assert res["something new <NUM>"] is None


def test_replayed_batch_does_not_duplicate(spark, tmp_dir):
    out = os.path.join(tmp_dir, "alerts")
    write = live.idempotent_alert_sink(out)
    batch = spark.createDataFrame([("blk_1", 1), ("blk_1", 1), ("blk_2", 2)],
                                  "block_id string, n int")
    write(batch, 7)
    write(batch, 7)   # the same micro-batch again after a failure
    assert spark.read.parquet(out).count() == 2


def test_update_mode_upsert(spark, tmp_dir):
    out = os.path.join(tmp_dir, "upd")
    write = live.idempotent_alert_sink(out)
    schema = "block_id string, window_start string, n int"
    write(spark.createDataFrame([("b1", "w1", 1), ("b2", "w1", 5)], schema), 0)
    write(spark.createDataFrame([("b1", "w1", 3)], schema), 1)   # b1/w1 re-emitted
    got = {(r["block_id"], r["window_start"]): r["n"] for r in
           live.read_upserted(spark, out, ["block_id", "window_start"]).collect()}
    assert got == {("b1", "w1"): 3, ("b2", "w1"): 5}
