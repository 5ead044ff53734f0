import hashlib
import random

import numpy as np
import pytest

from blocklens.llm import exact_dedup as ed
from tests.llm.conftest import ODD


def brute(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, sha) and kept texts."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, max(known) if known else None, len(ids), sha) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,key_bytes,owners", [(64, 32, None), (3, 32, 4), (2, 1, 8)])
def test_matches_brute_force_whatever_the_fingerprints(make_docs, bits, key_bytes, owners):
    rng = random.Random(bits)
    rows = [(i, rng.choice(["a", "b", "cc", "", None, f"own {i}", f"d{i % 9}"])) for i in range(300)]
    got = ed.exact_dedup(make_docs(rows), owners, bits, key_bytes).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got],
                  key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows(make_docs):
    got = ed.exact_dedup(make_docs(ODD)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(ODD)
    assert sum(r.kept for r in got) == len({t or "" for _, t in ODD})


def test_empty_table(make_docs):
    assert ed.exact_dedup(make_docs([])).count() == 0
    assert ed.drop_copies(make_docs([])).count() == 0


def test_drop_copies_keeps_one_row_of_each_text_with_its_columns(make_docs):
    rows = ODD + [(20, "a"), (20, "b"), (21, "a")]
    docs = make_docs(rows)
    out = ed.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert {(r.doc_id, r.text) for r in out.where("doc_id >= 20").collect()} == {(20, "b"), (21, "a")}


@pytest.mark.parametrize("n,bits", [(0, 64), (1, 64), (1, 8), (500, 64), (500, 20), (5000, 40), (256, 8)])
def test_rice_round_trip(n, bits):
    rng = np.random.default_rng(n + bits)
    top = (1 << bits) - 1
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    data = ed.rice_encode(values, bits)
    assert (ed.rice_decode(data) == values).all()
    if len(values) == 5000:
        assert len(data) < 5000 * 5     # far below 8 bytes each
