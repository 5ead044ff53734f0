import numpy as np
import pytest
from pyspark.sql import types as T

from blocklens.llm import embedding_dedup as ed

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType()),
                       T.StructField("home", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.9):
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a][1], rows[b][1]
            if valid(u) and valid(v) and len(u) == len(v):
                x, y = np.float32(u).astype(float), np.float32(v).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, left = {k}, [k]
        while left:
            for n in links[left.pop()] - seen:
                seen.add(n)
                left.append(n)
        known = [rows[n][0] for n in seen if rows[n][0] is not None]
        least = min(known) if known else None
        out.append((i, len(links[k]), least, i == least))
    return sorted(out, key=str)


def clusters(seed, dims=16, spread=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((centre + spread * np.linalg.norm(centre) / 4 * rng.standard_normal(dims)).tolist())
    rows += rng.standard_normal((40, dims)).tolist()
    return [(i, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("seed,cells,block", [(1, None, ed.BLOCK), (2, 5, 7), (3, 12, 3)])
def test_matches_all_pairs(spark, monkeypatch, seed, cells, block):
    """However many cells and blocks there are, no link is lost."""
    monkeypatch.setattr(ed, "BATCH", 16)
    monkeypatch.setattr(ed, "ROWS", 4)
    rows = clusters(seed)
    got = ed.near_duplicates(frame(spark, rows), cells=cells, block=block).collect()
    want = brute(rows)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert sum(w[1] for w in want) > 50


def test_bounds_hold_for_any_centroids():
    rng = np.random.default_rng(6)
    for _ in range(50):
        x = rng.standard_normal(8)
        y = x + 0.4 * rng.standard_normal(8)
        unit = ed.unit_rows([x, y])
        if unit[0] @ unit[1] < 0.9:
            continue
        centroids = ed.unit_rows(list(rng.standard_normal((9, 8))))
        near = unit @ centroids.T
        home = near.argmax(axis=1)
        visits = ed.visited_cells(near, home, centroids, 0.9)
        if home[0] != home[1]:
            late, early = (0, 1) if home[0] > home[1] else (1, 0)
            assert visits[late, home[early]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (None, [1.0, 0.0]),
            (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]), (13, [1e30, 1e29])]
    got = ed.near_duplicates(frame(spark, rows)).collect()
    want = brute(rows)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == sorted(
        [w[:3] for w in want], key=str)


def test_many_copies_and_one_crowded_cell(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(i, base.tolist()) for i in range(60)]
    rows += [(100 + i, (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(50)]
    rows += [(200 + i, rng.standard_normal(8).tolist()) for i in range(20)]
    got = ed.near_duplicates(frame(spark, rows), block=8).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_empty_table(spark):
    assert ed.near_duplicates(frame(spark, [])).count() == 0
    assert ed.near_duplicates(frame(spark, [(1, None)])).collect()[0].kept
