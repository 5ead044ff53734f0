import hashlib
import random

import numpy as np
import pytest

from blocklens.llm import paragraph_dedup as pd_
from tests.llm.conftest import ODD


def sentences(rng, n):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
                     for _ in range(rng.randint(8, 14))).capitalize() + "." for _ in range(n)]


def brute(rows, run_words=pd_.RUN_WORDS):
    """Groups of paragraphs by all pairs, then the same rule of removal."""
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(text or "", []).append(doc_id)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    units = []
    for text, doc_id in first.items():
        own = pd_.Paragraphs(text)
        for u, (_, _, a, b, _) in enumerate(own.units):
            grams = frozenset(pd_.shingles(own.words[a:b]).tolist())
            units.append((doc_id, u, tuple(own.words[a:b].tolist()), grams, text))
    label = list(range(len(units)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(units)):
        for j in range(i):
            same = units[i][2] == units[j][2]
            common = len(units[i][3] & units[j][3])
            if same or common >= pd_.SIMILARITY * (len(units[i][3]) + len(units[j][3]) - common) - 1e-9:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, u in enumerate(units):
        groups.setdefault(find(i), []).append(u)
    again = {}
    for own in groups.values():
        own.sort(key=lambda u: (u[0], u[1]))
        for u in own[1:]:
            again.setdefault(u[4], []).append(u[1])
    out = []
    for doc_id, text in rows:
        text = text or ""
        own, copies = pd_.Paragraphs(text), len(texts[text]) > 1
        whole = copies and doc_id != first[text]
        spans = pd_.removed_spans(own, [-1] if whole else again.get(text, []), run_words)
        gone = np.zeros(own.size, bool)
        for a, b in spans:
            gone[a:b] = True
        kept = bytes(b for b, g in zip(text.encode(), gone) if not g)
        out.append((doc_id, own.size, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    shared = [sentences(rng, 5) for _ in range(3)]
    rows = []
    for i in range(30):
        lines = [" ".join(sentences(rng, rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:      # a passage in the middle of a line
            at = rng.randrange(len(lines))
            lines[at] = lines[at] + " own words " + " ".join(rng.choice(shared)) + " and more here"
        if i % 5 == 0:      # a line with one word changed at its end
            words = " ".join(shared[0]).split()
            words[-1] = f"changed{i}."
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows + [(40, rows[2][1]), (41, rows[2][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(make_docs, seed):
    rows = corpus(seed)
    got = pd_.paragraph_dedup(make_docs(rows)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows)


def test_blocks_of_a_crowded_band(make_docs, monkeypatch):
    monkeypatch.setattr(pd_, "BLOCK", 2)
    rng = random.Random(5)
    line = " ".join(sentences(rng, 6)).replace(".", "").split()
    rows = [(i, " ".join(line[:-1] + [f"end{i}"])) for i in range(12)]
    got = {r.doc_id: r for r in pd_.paragraph_dedup(make_docs(rows)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == got[i].n_bytes for i in range(1, 12))


def test_a_passage_inside_other_lines_is_cut_and_clean_texts_stay(make_docs):
    rng = random.Random(8)
    passage = " ".join(sentences(rng, 7))
    own = [" ".join(sentences(rng, 4)) for _ in range(4)]
    rows = [(1, own[0] + " " + passage), (2, own[1] + "\nsome lead " + passage + " " + own[2]), (3, own[3])]
    got = {r.doc_id: r for r in pd_.paragraph_dedup(make_docs(rows), with_text=True).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    assert got[2].n_removed > 0.7 * len(passage) and own[2] in got[2].kept and own[1] in got[2].kept
    assert len(got[2].spans) == got[2].n_spans


def test_a_short_line_that_many_share_stays(make_docs):
    rng = random.Random(9)
    footer = "All rights reserved by the owners of this page."
    rows = [(i, "\n".join([" ".join(sentences(rng, 3)), footer])) for i in range(20)]
    assert all(r.n_removed == 0 for r in pd_.paragraph_dedup(make_docs(rows)).collect())


def test_signatures_of_equal_paragraphs_meet_and_shares_follow_similarity():
    rng = random.Random(11)
    hits = {0.8: [0, 0], 0.3: [0, 0]}
    for similarity in hits:
        for _ in range(150):
            words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(124)]
            # replacing a suffix of the words replaces a suffix of the shingles
            keep = round(124 * 2 * similarity / (1 + similarity))
            other = words[:keep] + ["".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(124 - keep)]
            a, _ = pd_.band_keys([pd_.Paragraphs(" ".join(words))])
            b, _ = pd_.band_keys([pd_.Paragraphs(" ".join(other))])
            hits[similarity][0] += bool(set(a.tolist()) & set(b.tolist()))
            hits[similarity][1] += 1
    assert hits[0.8][0] >= 0.97 * hits[0.8][1] and hits[0.3][0] < 0.5 * hits[0.3][1]


def test_odd_rows_and_empty_table(make_docs):
    got = pd_.paragraph_dedup(make_docs(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[7].n_removed == 0 and by[10].n_removed == 0
    assert pd_.paragraph_dedup(make_docs([])).count() == 0
