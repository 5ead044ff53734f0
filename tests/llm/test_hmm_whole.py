"""The HMM's training sees every training text in its sweep and in its passes."""
import zlib

import pytest

from blocklens.llm import hmm


@pytest.fixture()
def ready(make_docs):
    """Over 64 parts, each of one text."""
    rows = [(i, f"red w{i} green blue" if i % 2 else f"uno dos v{i}") for i in range(150)]
    n = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    return n, *hmm.prepare(make_docs(rows), part_tokens=1, frequent=8, endings=8)


def test_the_sweep_counts_every_training_text_once(ready, monkeypatch):
    n, parts, tokens, _, sizes = ready
    starts, words, made = [], [], hmm.Model.counted

    def counted(counts, sizes):
        starts.append(counts.start.sum())
        words.append(counts.emit.sum())
        return made(counts, sizes)
    monkeypatch.setattr(hmm.Model, "counted", counted)
    hmm.train(parts, tokens, sizes, states=2, warm_rounds=4, passes=1)
    assert len(starts) == 5 and sorted(starts[:4]) == starts[:4] and starts[0] < n / 2
    assert starts[3] == pytest.approx(n, abs=1e-3) and starts[4] == pytest.approx(n, abs=1e-3)
    assert words[3] == pytest.approx(tokens, abs=1e-2)
