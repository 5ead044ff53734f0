"""Template versions: ids stay, new ones follow, replaced templates point on."""
from blocklens.operators import templates as tpl
from blocklens.operators.dictionary import TemplateDictionary


def lines(spark, masks, start=1):
    return spark.createDataFrame([(i, m) for i, m in enumerate(masks, start)], "line_id long, template string")


def test_two_runs_give_the_ids_of_one(spark, tmp_dir):
    masks = ["b", "a", "b", "c", "a", "d", "b", "e"]
    halves, whole = TemplateDictionary(spark, tmp_dir + "/h"), TemplateDictionary(spark, tmp_dir + "/w")
    assert halves.version() == 0 and halves.templates().count() == 0
    assert halves.add_run(lines(spark, masks[:3])) == 1
    assert halves.add_run(lines(spark, masks[3:], 4)) == 2
    whole.add_run(lines(spark, masks))
    keep = ["event_id", "event_template", "first_line_id", "occurrences"]
    got = sorted(map(tuple, halves.templates().select(*keep).collect()))
    assert got == sorted(map(tuple, whole.templates().select(*keep).collect()))
    assert {r.event_template: r.since_version for r in halves.templates().collect()} == {
        "b": 1, "a": 1, "c": 2, "d": 2, "e": 2}


def mined(spark):
    def mine(masks):
        lines = masks.withColumnRenamed("first_line_id", "line_id")
        found = tpl.mined_masks(lines.select("line_id", "template"))
        return masks.join(found.select("template", "event_template"), "template")
    return mine


def test_replaced_templates_point_on(spark, tmp_dir):
    d = TemplateDictionary(spark, tmp_dir, mined(spark))
    d.add_run(lines(spark, ["open door now", "close x"]))
    first = {r.event_template: r.event_id for r in d.templates().collect()}
    assert first == {"open door now": 1, "close x": 2}
    # a second kind of door makes the first template a more general one
    d.add_run(lines(spark, ["open gate now", "new line here"], 3))
    rows = {r.event_template: (r.event_id, r.replaced_by, r.since_version) for r in d.templates().collect()}
    assert rows == {"open door now": (1, 3, 1), "close x": (2, None, 1), "open <*> now": (3, None, 2),
                    "new line here": (4, None, 2)}
    events = spark.createDataFrame([(1, "l1"), (2, "l2"), (4, "l3")], "event_id int, line string")
    assert {r.line: r.event_id for r in d.resolve(events).collect()} == {"l1": 3, "l2": 2, "l3": 4}
    assert {r.template: r.event_id for r in d.mask_to_event().collect()} == {
        "open door now": 3, "open gate now": 3, "close x": 2, "new line here": 4}


def test_a_run_that_died_leaves_the_version_before_it(spark, tmp_dir):
    d = TemplateDictionary(spark, tmp_dir)
    d.add_run(lines(spark, ["a"]))
    # masks of the next version were written, its templates were not
    d.masks().write.parquet(tmp_dir + "/version=2/masks")
    assert d.version() == 1
    d.add_run(lines(spark, ["z"], 2))
    assert {r.event_template: r.event_id for r in d.templates().collect()} == {"a": 1, "z": 2}


def test_repeated_and_empty_runs_change_no_id(spark, tmp_dir):
    d = TemplateDictionary(spark, tmp_dir)
    d.add_run(lines(spark, ["a", "", "b"]))
    before = {r.event_template: r.event_id for r in d.templates().collect()}
    d.add_run(lines(spark, []))
    d.add_run(lines(spark, ["b", "a"], 9))
    assert {r.event_template: r.event_id for r in d.templates().collect()} == before == {"a": 1, "": 2, "b": 3}
    assert {r.event_template: r.occurrences for r in d.templates().collect()} == {"a": 2, "": 1, "b": 2}
