import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blocklens.llm import packing as pk
from tests.llm.conftest import ODD


def optimum(items, capacity):
    """Fewest bins, by trying every place for every item."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1:])
        place(i + 1, bins + [items[i]])

    place(0, [])
    return best[0]


def check(patterns, counts, capacity):
    used = collections.Counter()
    for bin_, times in patterns:
        assert 0 < sum(bin_) <= capacity and times > 0
        for n in bin_:
            used[n] += times
    assert used == collections.Counter(counts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_cases_are_optimal(items):
    counts = dict(collections.Counter(items))
    patterns = pk.solve(counts, 20)
    check(patterns, counts, 20)
    best = optimum(items, 20)
    assert pk.lower_bound(counts, 20) <= best
    assert sum(k for _, k in patterns) == best


def test_search_improves_on_best_fit():
    counts = dict(collections.Counter([6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 2, 13, 7, 9, 11, 3] * 3))
    patterns = pk.solve(counts, 20)
    check(patterns, counts, 20)
    assert sum(k for _, k in patterns) <= sum(k for _, k in pk.best_fit(counts, 20))


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_large_histograms_come_close_to_the_bound(n):
    rng = random.Random(n)
    counts = dict(collections.Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(n)))
    patterns = pk.solve(counts)
    check(patterns, counts, 2048)
    assert sum(k for _, k in patterns) <= pk.lower_bound(counts, 2048) + 2


def test_places_are_gapless():
    patterns = [((5, 3, 3, 3), 2), ((3, 3), 1), ((7,), 4)]
    taken = collections.defaultdict(set)
    for n, low, high, sequence, offset, copies in pk.places(patterns):
        for r in range(low, high):
            s, o = sequence + (r - low) // copies, offset + (r - low) % copies * n
            own = set(range(o, o + n))
            assert not own & taken[s]
            taken[s] |= own
    assert len(taken) == 7 and all(v == set(range(len(v))) for v in taken.values())


def test_dominance():
    for a, b in itertools.product(itertools.combinations_with_replacement(range(1, 6), 2), repeat=2):
        fits = any(x <= p and y <= q for x, y in (b, b[::-1]) for p, q in (a,)) or any(sum(b) <= p for p in a)
        assert pk._dominates(tuple(sorted(a, reverse=True)), tuple(sorted(b, reverse=True))) == fits


@pytest.fixture(scope="module")
def library(word_bpe):
    t = Tokenizer.from_file(word_bpe)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("theinsAHRÉé.,;'<|> \n\x1c\x85ẖ̱Σİ0²🙂"),
                                       st.characters(exclude_categories=["Cs"])), max_size=25))
def test_encoder_gives_the_librarys_ids(word_bpe, library, text):
    own = pk.encoder(open(word_bpe, encoding="utf-8").read())
    for t in (text, text + "<|endoftext|>", text + " <|ENDOFTEXT|>"):
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_documents(make_docs, word_bpe, library):
    got = pk.pack(make_docs(ODD), word_bpe).collect()
    want = []
    for doc_id, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at:at + 2048]
            want.append((doc_id, p, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) == -(-total // 2048) or len(by) <= -(-total // 2048) + 1
    assert pk.pack(make_docs([]), word_bpe).count() == 0


def test_one_length_in_a_third_of_all_rows(make_docs, word_bpe):
    rows = [(i, "same words in here") for i in range(300)] + [(1000 + i, "w " * (i % 50)) for i in range(600)]
    got = pk.pack(make_docs(rows), word_bpe, capacity=64).toPandas()
    assert len(got) == 900 and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.groupby("sequence_id").length.sum().max() <= 64
