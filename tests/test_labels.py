"""Label CSV sources: required columns, header strip, last duplicate wins."""
import os

import pytest

from blocklens.sources.labels import (SchemaError, labels_lookup, load_labels,
                                      load_labels_with_order)


def _write(tmp_dir, text):
    p = os.path.join(tmp_dir, "labels.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_header_strip_and_projection(spark, tmp_dir):
    p = _write(tmp_dir, " BlockId , Label ,Extra\nblk_1,Normal,x\nblk_2,Anomaly,y\n")
    got = sorted(tuple(r) for r in load_labels(spark, p).collect())
    assert got == [("blk_1", "Normal"), ("blk_2", "Anomaly")]


def test_missing_column(spark, tmp_dir):
    p = _write(tmp_dir, "BlockId,Kind\nblk_1,Normal\n")
    with pytest.raises(SchemaError):
        load_labels(spark, p)


def test_last_duplicate_wins(spark, tmp_dir):
    p = _write(tmp_dir, "BlockId,Label\nblk_1,Normal\nblk_2,Normal\nblk_1,Anomaly\n")
    got = {r[0]: r[1] for r in labels_lookup(load_labels_with_order(spark, p),
                                             "row_order").collect()}
    assert got == {"blk_1": "Anomaly", "blk_2": "Normal"}


def test_quoted_fields_and_each_files_header(spark, tmp_dir):
    import os
    from blocklens.sources.labels import labels_lookup, load_labels_with_order
    for name, rows in (("a.csv", ['b1,"x, y",Normal', "b2,z,Normal"]), ("b.csv", ["b1,w,Anomaly"])):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("\n".join([" BlockId,note,Label ", *rows]) + "\n")
    rows = load_labels_with_order(spark, tmp_dir)
    assert rows.count() == 3
    got = {r.block_id: r.label for r in labels_lookup(rows, "row_order").collect()}
    assert got == {"b1": "Anomaly", "b2": "Normal"}
