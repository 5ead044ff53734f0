"""Texts are cut together by arrays, with the results of each cut alone."""
import random

import pyarrow as pa
from xxhash import xxh64_intdigest

from blocklens.llm import paragraph_dedup as pd_


def test_texts_cut_together_are_as_cut_alone(monkeypatch):
    monkeypatch.setattr(pd_, "CHUNK_CHARS", 300)
    draw = random.Random(4)
    bits = ["a ", "bb. ", "c! d ", "\n", "...", "x y z w v u. ", "\t", "é. ", " one two three four five six "]
    texts = ["", "", "."] + ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(200)] + [""]
    for text, own, bare in zip(texts, pd_.Paragraphs.of(texts), pd_.Paragraphs.of(texts, hashes=False), strict=True):
        alone = pd_.Paragraphs(text)
        assert (own.size, own.pieces, own.units) == (alone.size, alone.pieces, alone.units)
        assert own.words.tolist() == alone.words.tolist() and len(own.words) == own.n_words
        assert (bare.pieces, bare.units, bare.n_words) == (own.pieces, own.units, own.n_words)


def test_words_of_any_length_keep_their_xxh64():
    draw = random.Random(5)
    words = [bytes(draw.randrange(97, 123) for _ in range(n)) for n in range(1, 80) for _ in range(3)]
    own = pd_.Paragraphs(b" ".join(words).decode())
    assert own.words.tolist() == [xxh64_intdigest(w, pd_.SEED) for w in words]


def test_groups_over_several_batches_link_what_is_alike(monkeypatch):
    monkeypatch.setattr(pd_, "LINK_ROWS", 4)
    base = list(range(20))
    rows = [(1, n, base[:19] + [100 + n], 0) for n in range(12)]       # by arrays
    rows += [(2, 20, base, 0), (2, 21, base + [30], 0), (2, 22, [40, 41], 0)]       # by sets
    rows += [(3, 30, base, 7), (3, 31, base + [30], 7)]                # one passage of one text
    columns = {"key": [r[0] for r in rows], "x": [0] * len(rows), "y": [0] * len(rows),
               "name": [r[1] for r in rows], "grams": [r[2] for r in rows], "home": [r[3] for r in rows],
               "first": [0] * len(rows), "last": [0] * len(rows)}
    batches = [pa.RecordBatch.from_pydict({k: v[i:i + 3] for k, v in columns.items()}) for i in range(0, len(rows), 3)]
    links = {tuple(r.values()) for b in pd_._links(iter(batches)) for r in b.to_pylist()}
    reached = {0}
    for _ in range(12):
        reached |= {x for pair in links for x in pair if reached & set(pair)}
    assert reached == set(range(12))
    assert {tuple(sorted(pair)) for pair in links if max(pair) > 19} == {(20, 21)}


def test_a_name_of_a_line_and_a_sentence_has_each_key_once():
    text = "one two three four five six seven eight."
    own = [pd_.Paragraphs(text), pd_.Paragraphs(text + " Yes."), pd_.Paragraphs(text)]
    key, name = pd_.band_keys(own)
    found = list(zip(key.tolist(), name.tolist()))
    assert len(found) == len(set(found))
    assert {k for k, n in found if n == own[0].names()[0]} == set(pd_.band_keys(own[:1])[0].tolist())
