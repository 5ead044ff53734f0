"""Forward-backward over long texts does its scaling at every few positions only."""
import numpy as np

from blocklens.llm import hmm
from tests.llm.test_hmm import some_model


def stepwise(model, c, cls):
    """log10 probability and posteriors of one text, scaled at every position."""
    seen, alpha, scale = model.emissions(c, cls), [], []
    for t in range(len(c)):
        now = (alpha[-1] @ model.move if t else model.start) * seen[t]
        scale.append(now.sum())
        alpha.append(now / scale[-1])
    beta = [np.ones(len(model.start))]
    for t in range(len(c) - 1, 0, -1):
        beta.insert(0, model.move @ (seen[t] * beta[0]) / scale[t])
    return np.log10(scale).sum(), np.array(alpha) * np.array(beta)


def test_long_texts_of_rare_words_equal_the_stepwise_recursion():
    model = some_model(seed=5)
    model = hmm.Model(model.start, model.move, model.emit * 1e-12, model.unknown, model.sizes_given)
    rng = np.random.default_rng(5)
    sizes = np.array([700, 1, 16, 17, 8, 303])
    cls = rng.integers(0, 5, sizes.sum())
    c = rng.integers(1, 4, sizes.sum())
    parts = [slice(a, a + n) for a, n in zip(np.cumsum(sizes) - sizes, sizes)]
    want = [stepwise(model, c[p], cls[p]) for p in parts]
    assert np.allclose(hmm.log_likelihoods(model, sizes, c, cls), [w[0] for w in want], rtol=1e-12)
    counts = hmm.Counts(3, 5)
    hmm.add_counts(counts, model, sizes, c, cls)
    gamma = np.concatenate([w[1] for w in want])
    assert np.allclose(counts.emit, [gamma[cls == k].sum(axis=0) for k in range(5)])
    assert np.allclose(counts.start, sum(w[1][0] for w in want))
    assert np.isclose(counts.move.sum(), (sizes - 1).sum())


def test_scaling_only_at_every_few_positions():
    model, sizes = some_model(), np.array([40, 40])
    grid = hmm.Lattice(sizes)
    seen, top = model.relative(np.ones(80, int), np.zeros(80, int))
    assert np.allclose(seen.max(axis=1), 1) and len(top) == 80
    _, logs = grid.forward(model, seen)
    assert set(np.flatnonzero(logs) // 2 % hmm.RESCALE) == {0}


def test_words_get_the_next_free_number():
    known = hmm._Numbers({b"": 0})
    assert [known[w] for w in (b"a", b"b", b"a", b"", b"c")] == [1, 2, 1, 0, 3]
