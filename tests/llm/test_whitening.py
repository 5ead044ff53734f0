import math
import random

import numpy as np
import pytest

from blocklens.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, deviation long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "n", 3, None) for i, v in rows], SCHEMA).repartition(3)


def integers(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def check(spark, rows, valid, components=16):
    """The whole contract against numpy on the valid (vec_id, vector) rows."""
    got = wh.whiten(frame(spark, rows)).collect()
    fit = sorted({integers(v) for _, v in valid})
    n, d = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit)]
    exact = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    v = np.array([[e / n ** 2 for e in row] for row in exact])
    values = np.linalg.eigvalsh(v)[::-1][:components]
    trace = np.trace(v)
    assert sorted((r.vec_id, r.component) for r in got) == sorted(
        (i, k + 1) for i, _ in valid for k in range(len(values)))
    of = {}
    for r in got:
        of.setdefault(r.vec_id, {})[r.component] = r
    at = dict(valid)
    for i, own in of.items():
        x = integers(at[i])
        assert {r.n for r in own.values()} == {n}
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert {r.deviation for r in own.values()} == {deviation if deviation < 1 << 63 else None}
    # whitened values: covariance one over the fit list, and linear in x along an eigenvector
    centred = np.array([[float(a * n - s) / n for a, s in zip(integers(v), sums)] for _, v in valid])
    for k, value in enumerate(values):
        e = [of[i][k + 1] for i, _ in valid]
        if value <= trace * d * np.finfo(float).eps:
            assert all(r.whitened is None for r in e)
            continue
        assert all(abs(r.explained - value / trace) <= 1e-4 * value / trace for r in e)
        w = np.array([r.whitened for r in e])
        direction = np.linalg.lstsq(centred, w * math.sqrt(value), rcond=None)[0]
        assert np.allclose(centred @ direction, w * math.sqrt(value), atol=1e-6 * math.sqrt(trace))
        assert np.allclose(v @ direction @ centred.T, value * (direction @ centred.T),
                           atol=1e-6 * trace * math.sqrt(trace))
    assert len({r.identity_error for r in got}) == 1
    if got[0].identity_error is not None:
        assert got[0].identity_error <= 1e-4
    return got


def test_matches_numpy_with_repeated_and_spoilt_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (120, 6)) * [1, 3, 0.2, 1, 1, 8] + [0, 5, 0, -3, 0, 0]
    valid = [(i, v.tolist()) for i, v in enumerate(base)]
    valid += [(1000 + i, valid[7][1]) for i in range(60)]          # a third of the rows are one vector
    rows = valid + [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 6),
                    (5003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (5004, []), (5005, [1.0, 2.0])]
    check(spark, rows, valid)


def test_more_components_than_sixteen_and_rank_deficit(spark):
    rng = np.random.default_rng(2)
    wide = rng.normal(0, 1, (90, 20))
    check(spark, [(i, v.tolist()) for i, v in enumerate(wide)], [(i, v.tolist()) for i, v in enumerate(wide)])
    flat = [(i, [float(a), 2.0 * a, 1.0]) for i, a in enumerate(range(8))]
    got = check(spark, flat, flat)
    assert {r.component for r in got if r.whitened is not None} == {1}


def test_values_far_apart_keep_exact_integers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 1.0]) * 2.0 ** rng.randrange(30, 40), rng.random(), float(i)])
            for i in range(40)]
    check(spark, rows, rows)


def test_saturated_values_do_not_crash(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = wh.whiten(frame(spark, rows)).collect()
    assert len(got) == 6
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, 192 ** 2)}


def test_single_vector_empty_table_and_large_ids(spark):
    big = [(2 ** 60 + 1, [1.0, 2.0]), (2 ** 60 + 3, [1.0, 2.0]), (None, [1.0, 2.0])]
    got = wh.whiten(frame(spark, big)).collect()
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id) == [
        (2 ** 60 + 1, 1), (2 ** 60 + 1, 2), (2 ** 60 + 3, 1), (2 ** 60 + 3, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (1, 0, None, None, None)}
    for rows in ([], [(1, None)], [(1, [])]):
        out = wh.whiten(frame(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                               "identity_error"]
        assert out.count() == 0


@pytest.mark.parametrize("rows,bits", [(1, [3, 1]), (64, [20, 7, 1]), (200, [20, 20, 20]), (130, [5])])
def test_popcounts_are_exact_cross_products(rows, bits):
    rng = np.random.default_rng(rows)
    limbs = np.stack([rng.integers(0, 1 << b, rows) for b in bits], axis=1)
    sums, cross = wh.cross_products(limbs, bits)
    assert (sums == limbs.sum(axis=0)).all()
    assert (cross == limbs.T @ limbs).all()


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 5)))]
    one = {(r.vec_id, r.component): (r.deviation, abs(r.whitened)) for r in
           wh.whiten(frame(spark, rows).coalesce(1)).collect()}
    many = {(r.vec_id, r.component): (r.deviation, abs(r.whitened)) for r in
            wh.whiten(frame(spark, rows).repartition(7)).collect()}
    assert one.keys() == many.keys()
    assert all(one[k][0] == many[k][0] and abs(one[k][1] - many[k][1]) < 1e-9 for k in one)
