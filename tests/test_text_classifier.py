"""Answers, retries and recorded answers of the text model."""
from pyspark.sql import functions as F

from blocklens.functions.text import answer_class, answer_fields
from blocklens.operators import text_classifier as tc

CASES = [
    ('ok {"classification":"NORMAL","confidence":0.9} end', "Normal"),
    ('{" Classification ":" anomaly ","confidence":"90%"}', "Anomaly"),
    ('{"classification":"ANÔMALO"}', "Anomaly"), ('{"classification":"anomalo"}', "Anomaly"),
    ('{"classification":"anomalous"}', None), ('{"classification":1}', None),
    ('{"classification":["NORMAL"]}', None), ('{"label":"NORMAL"}', None), ("no braces", None),
    ("{'classification':'NORMAL'}", None), ('{"classification":"NORMAL"} {"a":1}', None),
    ('{"Classification":"NORMAL","classification":"ANOMALY"}', "Anomaly"),
    ('```json\n{\n "classification": "normal"\n}\n```', "Normal"),
    ('{"classification":"NORMAL"}, {"a":1}', None), ("", None), (None, None)]


def test_answer_shapes(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string")
    got = [r.c for r in df.select("i", answer_class(F.col("a")).alias("c")).orderBy("i").collect()]
    assert got == [c for _, c in CASES]


def test_answer_fields(spark):
    df = spark.createDataFrame([('{"Classification":"normal","confidence":0.5,"explanation":"x"}',)], "a string")
    r = df.select(answer_fields(F.col("a")).alias("f")).first().f
    assert (r.classification, r.confidence, r.explanation) == ("Normal", "0.5", "x")


def texts(spark):
    return spark.createDataFrame([("a", "one", "Normal"), ("b", "two", "Anomaly"), ("c", "three", None)],
                                 "block_id string, text_sequence string, label string")


def test_only_unresolved_blocks_are_asked_again(spark):
    asked = []

    def backend(prompt, temperature):
        asked.append(temperature)
        good = F.lit('{"classification":"ANOMALY","confidence":"80%"}')
        first = {0.0: "one", 0.3: "two"}.get(temperature, "nothing")
        return F.when(prompt.contains(f"\n{first}\n"), good).otherwise(F.lit("?"))

    out = {r.block_id: r for r in tc.classify(texts(spark), backend).collect()}
    assert asked == list(tc.TEMPERATURES)
    assert [(out[b].classification, out[b].attempts, out[b].parse_failed) for b in "abc"] == [
        ("Anomaly", 1, False), ("Anomaly", 2, False), (None, 3, True)]
    assert out["a"].confidence == "80%" and out["c"].confidence is None
    assert 0 < out["a"].inference_time_sec < out["c"].inference_time_sec
    fails = tc.failure_count(tc.classify(texts(spark), backend)).first()
    assert (fails.n_parse_failed, fails.n_total) == (1, 3)


def test_recorded_answers(spark):
    answers = spark.createDataFrame(
        [("a", 2, '{"classification":"normal"}'), ("a", 1, "?"), ("a", 3, '{"classification":"anomaly"}'),
         ("b", 1, "?"), ("b", 4, '{"classification":"anomaly"}')],
        "block_id string, attempt int, raw_answer string")
    out = {r.block_id: r for r in tc.classify_recorded(texts(spark), answers).collect()}
    assert (out["a"].classification, out["a"].attempts) == ("Normal", 2)
    assert (out["b"].classification, out["b"].attempts, out["b"].parse_failed) == (None, 3, True)
    assert out["c"].parse_failed


def test_prompt_has_the_sequence(spark):
    p = tc.build_prompts(texts(spark)).where("block_id = 'a'").first().prompt
    assert p.endswith("Sequence:\none\n")
