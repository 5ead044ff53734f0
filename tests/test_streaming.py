"""Streaming equals batch; the watermark drops data that is too late."""
import datetime as dt
import os


from blocklens.operators.parse import parse_lines
from blocklens.operators.templates import with_masks
from blocklens.sources import fixtures
from blocklens.streaming import live
from tests.conftest import SF_SMALL


def test_level_rates_stream_equals_batch(spark):
    got = live.run_bounded(fixtures.log_lines(spark, SF_SMALL),
                           lambda s: live.level_rates(live.parse_stream(s)), "t-rates")
    batch = with_masks(parse_lines(fixtures.log_lines(spark, SF_SMALL)))
    want = live.level_rates(batch)
    key = ["window_start", "level"]
    assert got.orderBy(key).collect() == want.orderBy(key).collect()


def test_late_rows_dropped(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    base = dt.datetime(2024, 1, 10, 12, 0, 0)
    schema = "event_ts timestamp, block_id string, level string"

    def put(name, rows):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(
            os.path.join(src, name))

    put("a", [(base, "blk_1", "INFO")])
    stream = spark.readStream.schema(schema).parquet(src + "/*")
    agg = live.level_rates(stream, watermark="1 hour")
    out = os.path.join(tmp_dir, "out")
    q = (agg.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", out + "-ck").option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # a much later row moves the watermark; then a very late row and a slightly late row
    put("b", [(base + dt.timedelta(hours=5), "blk_2", "INFO")])
    q = (agg.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", out + "-ck").option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    put("c", [(base + dt.timedelta(minutes=5), "blk_3", "INFO"),
              (base + dt.timedelta(hours=4, minutes=30), "blk_4", "INFO")])
    put("d", [(base + dt.timedelta(hours=9), "blk_5", "INFO")])
    q = (agg.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", out + "-ck").option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = {r["window_start"]: r["n"] for r in spark.read.parquet(out).collect()}
    # the 12:00 window was closed before the 12:05 row came: that row is dropped
    assert res[dt.datetime(2024, 1, 10, 12, 0)] == 1
    # 16:30 is within the 1-hour delay of the 17:00 watermark: kept in the 16:00 window
    assert res[dt.datetime(2024, 1, 10, 16, 0)] == 1
    assert res[dt.datetime(2024, 1, 10, 17, 0)] == 1


def test_stream_alerts_equal_batch_scoring_of_the_same_sessions(spark):
    import __spark_entry__ as E
    from blocklens.plans.catalog import _session_scorer
    from blocklens.plans.context import LogContext
    got = E.queries()["stream_alerts"](spark, SF_SMALL)
    ctx = LogContext.of(spark, SF_SMALL)
    decision, names = _session_scorer(spark, SF_SMALL)
    sessions = live.session_counts(live.parse_stream(ctx.lines, ctx.templates),
                                   [int(n[1:]) for n in names])
    want = live.score_sessions(sessions, decision, names)
    key = ["block_id", "session_start"]
    assert got.select(want.columns).orderBy(key).collect() == want.orderBy(key).collect()
    assert want.count() > 0


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    batch = spark.createDataFrame([("blk_1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 3, 0, 1.0)],
                                  "block_id string, session_start timestamp, session_end timestamp, "
                                  "n_events long, n_unseen long, E1 double")
    from pyspark.sql import functions as F
    sink = live.scoring_alert_sink(tmp_dir + "/out", lambda features: F.lit(-0.2) + features[0] * 0, ["E1"])
    for _ in range(3):
        sink(batch, 7)
    assert spark.read.parquet(tmp_dir + "/out").count() == 1


def test_lines_of_unseen_templates_count_and_are_listed(spark, tmp_dir):
    lines = spark.createDataFrame(
        [(i, f"240101 00000{i} 1 INFO svc: {'known' if i % 2 else 'strange'} blk_5") for i in range(6)],
        "line_id long, raw_content string")
    templates = spark.createDataFrame([("known <BLOCK_ID>", 1)], "event_template string, event_id int")
    got = live.run_bounded(lines, lambda s: live.session_counts(live.parse_stream(s, templates), [1]), "t-unseen")
    row = got.first()
    assert (got.count(), row.n_events, row.n_unseen, row.E1) == (1, 6, 3, 3)
    path = tmp_dir + "/side"
    live.run_bounded(lines, lambda s: live.parse_stream(s, templates), "t-side",
                     lambda _: live.unseen_mask_sink(path))
    side = {r.template: r.n for r in live.read_unseen_masks(spark, path).collect()}
    assert side["strange <BLOCK_ID>"] == 3 and "known <BLOCK_ID>" not in side


def _log(rows):
    return [(i, f"{at:%y%m%d %H%M%S} 1 INFO svc: open {block}") for i, (at, block) in enumerate(rows)]


def test_severity_rates_drop_late_lines_and_count_each_session_once(spark, tmp_dir):
    base = dt.datetime(2024, 1, 10, 12, 0, 0)
    schema = "line_id long, raw_content string"
    graded = spark.createDataFrame([("blk_1", "HIGH"), ("blk_2", "HIGH"), ("blk_3", "LOW")],
                                   "block_id string, severity string")
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")

    def run(name, rows):
        spark.createDataFrame(_log(rows), schema).coalesce(1).write.parquet(os.path.join(src, name))
        stream = spark.readStream.schema(schema).parquet(src + "/*")
        rates = live.severity_rates(live.graded_sessions(live.windowed_sessions(
            live.parse_stream(stream), watermark="1 hour"), graded), "1 hour", "30 minutes")
        rates.writeStream.outputMode("append").format("parquet").option("checkpointLocation", out + "-ck") \
            .option("path", out).trigger(availableNow=True).start().awaitTermination()

    # blk_1 and blk_2 end 12:30 and 12:40, blk_3 is one session of two lines, blk_9 is no alert
    run("a", [(base, "blk_1"), (base + dt.timedelta(minutes=10), "blk_2"), (base, "blk_3"),
              (base + dt.timedelta(minutes=20), "blk_3"), (base, "blk_9")])
    run("b", [(base + dt.timedelta(hours=9), "blk_9")])
    # far behind the watermark: dropped; within its hour: counted
    run("c", [(base + dt.timedelta(minutes=1), "blk_1"), (base + dt.timedelta(hours=8, minutes=30), "blk_2")])
    run("d", [(base + dt.timedelta(hours=20), "blk_9")])
    run("e", [(base + dt.timedelta(hours=30), "blk_9")])
    got = {(r.window_start.strftime("%H:%M"), r.severity): r.n_alerts for r in spark.read.parquet(out).collect()}
    # a session ends half an hour after its last line; that instant itself is outside
    assert got == {("12:00", "HIGH"): 2, ("11:30", "HIGH"): 1, ("12:30", "HIGH"): 1, ("12:00", "LOW"): 1,
                   ("12:30", "LOW"): 1, ("20:00", "HIGH"): 1, ("20:30", "HIGH"): 1}


def test_rates_of_sessions_scored_in_the_stream_equal_batch(spark):
    from blocklens.plans.catalog import _session_scorer
    from blocklens.plans.context import LogContext
    ctx = LogContext.of(spark, SF_SMALL)
    decision, names = _session_scorer(spark, SF_SMALL)

    def rates(lines):
        return live.severity_rates(live.scored_sessions(live.parse_stream(lines, ctx.templates), decision, names))
    got = live.run_bounded(ctx.lines, rates, "t-scored")
    key = ["window_start", "severity"]
    assert got.orderBy(key).collect() == rates(ctx.lines).orderBy(key).collect()
    assert got.count() > 0


def test_line_counts_are_observed_on_a_stream(spark, tmp_dir):
    from blocklens.operators.parse import observed_lines
    rows = _log([(dt.datetime(2024, 1, 1), "blk_1")] * 7) + [(9, "no header")] * 3
    for i in range(2):
        spark.createDataFrame(rows, "line_id long, raw_content string").write.parquet(f"{tmp_dir}/in/{i}")
    stream = spark.readStream.schema("line_id long, raw_content string").parquet(tmp_dir + "/in/*")
    query = observed_lines(stream, "lines").writeStream.format("noop").option(
        "checkpointLocation", tmp_dir + "/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert live.observed_totals(query, "lines") == {"n_lines": 20, "n_processed": 14, "n_unmatched": 6}
