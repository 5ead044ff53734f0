import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.llm import suffix_dedup as sd
from tests.llm.conftest import ODD


def brute(rows, length):
    """(doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, kept sha)."""
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def emulate(docs, length, gram):
    """The operator's steps on plain lists: election, names, sorting, induction."""
    places = []
    for n, d in enumerate(docs):
        at, first, last = sd.elected(d, length, gram)
        starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
        assert starts == list(range(max(0, len(d) - length + 1)))
        places += [(d[p:p + gram], d[a:b + length], n, p, p - a, p - b)
                   for p, a, b in zip(at.tolist(), first.tolist(), last.tolist())]
    reach = collections.Counter((x[0], x[1], x[4] - x[5]) for x in places)
    out, one = [set() for _ in docs], {}
    for x in places:
        key = (x[0], x[1], x[4] - x[5])
        one.setdefault(key, x)
        if reach[key] > 1:
            out[x[2]].update(range(x[3] - x[4], x[3] - x[5] + 1))
    rows = [(x[0], x[2], x[3], x[4], x[5], docs[x[2]][x[3] - x[4]:x[3]],
             docs[x[2]][x[3] + gram:x[3] - x[5] + length]) for x in one.values()]
    names = {k: i for i, k in enumerate(sorted({r[0] for r in rows}))}
    rows.sort(key=lambda r: (names[r[0]], r[6]))
    if rows:
        got, step = sd.induce([r[5] for r in rows], [r[6] for r in rows],
                              np.array([r[3] for r in rows]), np.array([r[4] for r in rows]),
                              np.array([names[r[0]] for r in rows]), length - gram)
        for r, s in zip(got.tolist(), step.tolist()):
            out[rows[r][1]].add(rows[r][2] - s)
    return [sorted(o) for o in out]


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_induction_finds_every_repeated_window(data):
    length = data.draw(st.sampled_from([4, 6, 9, 12]))
    gram = data.draw(st.integers(1, length - 1))
    letters = data.draw(st.sampled_from([b"ab", b"abc", b"abcdefgh"]))
    piece = st.lists(st.sampled_from(letters), max_size=30).map(bytes)
    docs = data.draw(st.lists(piece, min_size=1, max_size=6))
    shared = data.draw(piece)
    docs = list(dict.fromkeys([d[:i] + shared + d[i:] for d in docs
                               for i in [data.draw(st.integers(0, len(d)))]]))
    seen = collections.Counter(d[i:i + length] for d in docs for i in range(len(d) - length + 1))
    want = [[i for i in range(len(d) - length + 1) if seen[d[i:i + length]] > 1] for d in docs]
    assert emulate(docs, length, gram) == want


def passages(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 20))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15)))
                 if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "ab" * 60), (n + 3, "ba" * 70)]


@pytest.mark.parametrize("seed,hot", [(1, sd.HOT), (2, 1)])
def test_matches_brute_force(make_docs, seed, hot):
    rows = passages(seed)
    got = sd.suffix_dedup(make_docs(rows), 30, 13, hot).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 30)


def test_chunks_of_long_texts(make_docs, monkeypatch):
    """Texts cut into chunks of window starts give the same result."""
    monkeypatch.setattr(sd, "CHUNK", 50)
    rows = passages(7, 12)
    docs = [t.encode() for _, t in rows]
    for d in docs:
        at, first, last = sd.elected(d, 30, 13)
        assert [s for a, b in zip(first, last) for s in range(a, b + 1)] == list(range(max(0, len(d) - 29)))
    seen = collections.Counter(d[i:i + 30] for d in dict.fromkeys(docs) for i in range(len(d) - 29))
    want = [[i for i in range(len(d) - 29) if seen[d[i:i + 30]] > 1] for d in dict.fromkeys(docs)]
    assert emulate(list(dict.fromkeys(docs)), 30, 13) == want


def test_production_length_and_odd_rows(make_docs):
    rows = ODD + [(50, "p" * 150 + "z" * 300 + "q"), (51, "other " * 10 + "z" * 260),
                  (52, "unique text " + "".join(map(str, range(200))))]
    got = sd.suffix_dedup(make_docs(rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 200)
    clean = next(r for r in got if r.doc_id == 52)
    assert clean.n_removed == 0


def test_spans_and_bytes(make_docs):
    text = "A" + "x1y2" * 60
    rows = [(1, text), (2, "B" + text[1:] + "C")]
    got = {r.doc_id: r for r in sd.suffix_dedup(make_docs(rows), with_bytes=True).collect()}
    assert bytes(got[1].kept) == b"A" and bytes(got[2].kept) == b"BC"
    assert [tuple(s) for s in got[2].spans] == [(1, 241)]


def test_cut_repeats_keeps_columns_and_drops_emptied_texts(make_docs):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "start " + passage), (2, passage + " end"), (3, "clean text"), (4, None), (5, passage)]
    docs = make_docs(rows)
    out = sd.cut_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1][0].strip() == "start" and got[2][0].strip() == "end" and 5 not in got
    assert got[3] == ("clean text", 10) and got[4] == (None, None)
    assert got[1][1] == len(got[1][0])
    assert {(r.kind, r.length, r.part) for r in out.collect()} == {("k", "l", "x")}
    assert sd.cut_repeats(make_docs([])).count() == 0 and sd.suffix_dedup(make_docs([])).count() == 0
