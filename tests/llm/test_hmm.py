import itertools
import math
import zlib

import numpy as np
import pytest

from blocklens.llm import hmm
from tests.llm.conftest import ODD


def some_model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)

    def rows(*shape):
        x = rng.random(shape) + 0.1
        return x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(rows(states), rows(states, states), rows(states, classes).T,
                     rng.random(states) * 0.3, rng.integers(1, 9, classes).astype(float) + 1)


def brute_log10(model, c, cls):
    seen = model.emissions(c, cls)
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(c)):
        p = model.start[path[0]]
        for t, s in enumerate(path):
            p *= seen[t, s] * (model.move[path[t - 1], s] if t else 1)
        total += p
    return math.log10(total)


def random_texts(seed, n=6):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 6, n)
    cls = rng.integers(-1, 5, sizes.sum())
    c = np.where(cls < 0, 0, rng.integers(1, 4, sizes.sum()))
    return sizes, c, cls


@pytest.mark.parametrize("seed", range(5))
def test_scaled_forward_is_the_sum_over_all_paths(seed):
    model = some_model(seed=seed)
    sizes, c, cls = random_texts(seed)
    got = hmm.log_likelihoods(model, sizes, c, cls)
    at = np.cumsum(sizes) - sizes
    want = [brute_log10(model, c[a:a + n], cls[a:a + n]) for a, n in zip(at, sizes)]
    assert np.allclose(got, want, rtol=1e-12)


def test_expected_counts_are_the_posteriors():
    model = some_model(seed=9)
    sizes, c, cls = random_texts(11)
    cls, c = np.abs(cls), np.maximum(c, 1)
    counts = hmm.Counts(3, 5)
    hmm.add_counts(counts, model, sizes, c, cls)
    start, move, emit, once = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), np.zeros(3)
    for a, n in zip(np.cumsum(sizes) - sizes, sizes):
        seen, paths = model.emissions(c[a:a + n], cls[a:a + n]), {}
        for path in itertools.product(range(3), repeat=int(n)):
            p = model.start[path[0]]
            for t, s in enumerate(path):
                p *= seen[t, s] * (model.move[path[t - 1], s] if t else 1)
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emit[cls[a + t], s] += p / total
                once[s] += p / total * (c[a + t] == 1)
                if t:
                    move[path[t - 1], s] += p / total
    for got, want in ((counts.start, start), (counts.move, move), (counts.emit, emit), (counts.once, once)):
        assert np.allclose(got, want)


def test_emissions_are_a_distribution():
    """Over the words of all classes and the unknown symbol."""
    model = some_model(seed=3)
    c = np.concatenate([np.full(1, s - 1) for s in model.sizes])       # one word a class: c + 1 = S
    known = model.emissions(c, np.arange(5)).sum(axis=0)
    assert np.allclose(known + model.unknown, 1)


SMALL = dict(part_tokens=500, frequent=8, endings=8, states=3, warm_rounds=2, passes=2)


def brute_base(rows):
    words = {k: (t or "").encode().lower().split() + [b""] for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = {}
    for k in train:
        for w in words[k]:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    out = []
    for k, (i, _) in enumerate(rows):
        held = None if i is None else zlib.crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in words[k])
        out.append((i, held, len(words[k]), sum(c.get(w, 0) > 0 for w in words[k]), n, round(base, 6)))
    return sorted(out, key=str)


def test_counts_folds_and_base_score(make_docs):
    rows = ODD + [(100 + i, " ".join(f"w{(i * j) % 17} Ü{i % 3}" for j in range(i % 40))) for i in range(80)]
    got = hmm.score_documents(make_docs(rows), **SMALL).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in got], key=str) == brute_base(rows)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_training_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = hmm.score_documents(docs).toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and held.score.sum() > held.base_score.sum()


def test_each_round_raises_the_likelihood(make_docs):
    """Up to the small prior: Baum-Welch never lowers the training likelihood."""
    rows = [(i, " ".join(["red green blue" if i % 2 else "uno dos tres"] * (3 + i % 5))) for i in range(60)]
    ready, tokens, types, sizes = hmm.prepare(make_docs(rows), part_tokens=300, frequent=8, endings=8)
    model, last = hmm.Model.noise(2, sizes, tokens), -np.inf
    for _ in range(6):
        total = ready.mapInPandas(hmm._score(model, tokens, types),
                                  "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                  "train_tokens long, base_score double, score double") \
            .where("not held_out").groupBy().sum("score").first()[0]
        assert total >= last - 1.0
        last, model = total, hmm.baum_welch(ready, model)


def test_no_training_rows_and_empty_table(make_docs):
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = hmm.score_documents(make_docs([(only_held, "a b")]), **SMALL).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)
    assert hmm.score_documents(make_docs([]), **SMALL).count() == 0
