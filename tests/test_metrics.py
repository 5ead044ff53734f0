"""Confusion counts -> metrics (published percentages of the three detectors)."""
import pytest

from blocklens.operators.metrics import compute_metrics, crosstab, evaluate_on_sample


def _preds(spark, tp, fp, fn, tn, extra_null=0):
    rows = ([("Anomaly", "Anomaly")] * tp + [("Normal", "Anomaly")] * fp +
            [("Anomaly", "Normal")] * fn + [("Normal", "Normal")] * tn +
            [("Normal", None)] * extra_null)
    return spark.createDataFrame([(f"b{i}", y, p, 1.0) for i, (y, p) in enumerate(rows)],
                                 "block_id string, label string, classification string, "
                                 "inference_time_sec double")


@pytest.mark.parametrize("tp,fp,fn,tn,p,r,f1,fpr", [
    (21, 360, 8, 611, 5.51, 72.41, 10.24, 37.08),
    (29, 0, 0, 971, 100, 100, 100, 0),
    (21, 750, 8, 221, 2.72, 72.41, 5.25, 77.24),
])
def test_published(spark, tp, fp, fn, tn, p, r, f1, fpr):
    m = compute_metrics(_preds(spark, tp, fp, fn, tn)).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (tp, fp, fn, tn)
    assert round(100 * m["precision"], 2) == p
    assert round(100 * m["recall"], 2) == r
    assert round(100 * m["f1"], 2) == f1
    assert round(100 * m["fpr"], 2) == fpr


def test_invalid_and_zero_division(spark):
    m = compute_metrics(_preds(spark, 0, 0, 0, 0, extra_null=5)).first()
    assert m["n_total"] == 5 and m["n_invalid"] == 5
    assert m["precision"] == m["recall"] == m["f1"] == m["fpr"] == 0.0
    no_pos = compute_metrics(_preds(spark, 0, 0, 3, 4)).first()
    assert no_pos["precision"] == 0.0 and no_pos["recall"] == 0.0


def test_sample_cardinality_check(spark):
    preds = _preds(spark, 2, 1, 1, 2)
    ids = spark.createDataFrame([("b0",), ("b1",), ("missing",)], "block_id string")
    with pytest.raises(Exception, match="does not cover the sample"):
        evaluate_on_sample({"m": preds}, {}, ids).collect()


def test_crosstab(spark):
    got = {(r[0], r[1]): r[2] for r in crosstab(_preds(spark, 1, 2, 3, 4, 2)).collect()}
    assert got == {("Anomaly", "Anomaly"): 1, ("Normal", "Anomaly"): 2,
                   ("Anomaly", "Normal"): 3, ("Normal", "Normal"): 4}
