"""What collides by chance is not sent on; what is alike always is."""
import random

import numpy as np
import pyarrow as pa

from blocklens.llm import paragraph_dedup as pd_


def _rows(key, names, own):
    maps, sizes = pd_.bit_maps(own)
    return [(key, n, m[0], s[0]) for n, m, s in zip(names, maps, sizes)]


def _near(rows):
    columns = [pa.array(np.array(c, np.int64)) for c in zip(*sorted(rows))]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "name", "bits", "grams"])
    out = [tuple(r.values()) for b in pd_._near(iter([batch])) for r in b.to_pylist()]
    return out


def test_alike_paragraphs_stay_together_and_equal_groups_are_one():
    draw = random.Random(7)
    for _ in range(200):
        words = [f"w{draw.randrange(10 ** 6)}" for _ in range(draw.randrange(8, 120))]
        other = list(words)
        if draw.random() < 0.5:
            other += [f"w{draw.randrange(10 ** 6)}"]
        else:
            other[0] = "changed"
        own = [pd_.Paragraphs(" ".join(w)) for w in (words, other)]
        sets = [set(pd_.shingles(p.words).tolist()) for p in own]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= pd_.SIMILARITY
        got = _near(_rows(1, [11, 22], own) + _rows(2, [11, 22], own))
        if alike:
            assert sorted({n for _, n in got}) == [11, 22] and len({g for g, _ in got}) == 1


def test_large_keys_stay_as_they_are():
    rows = [(5, n, 1 << (n % 60), 9) for n in range(pd_.BLOCK + 1)]
    assert _near(rows) == [(5, n) for n in range(pd_.BLOCK + 1)]


def test_runs_over_several_batches_hold_each_name_once(monkeypatch):
    monkeypatch.setattr(pd_, "ROWS", 8)
    key, name = [1] * 30 + [2] * 3 + [3], [4] * 15 + [5] * 15 + [6, 6, 6] + [7]
    batches = [pa.RecordBatch.from_pydict({"key": key[i:i + 3], "name": name[i:i + 3]})
               for i in range(0, len(key), 3)]
    got = [tuple(r.values()) for b in pd_._collisions(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 4), (1, 5)]


def test_sentences_that_share_a_phrase_only_are_not_sent_on(spark, monkeypatch):
    draw = random.Random(3)
    phrase = "as far as we know today there is no"
    rows = [(i, f"{phrase} " + " ".join(f"x{draw.randrange(10 ** 6)}" for _ in range(8)))
            for i in range(60)]
    rows += [(60, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
             (61, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen too")]
    sent, staged = {}, pd_.stage

    def noted(df, name):
        out = staged(df, name)
        sent[name] = out.collect()
        return out
    monkeypatch.setattr(pd_, "stage", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_repeated for r in pd_.paragraph_dedup(docs).collect()}
    assert sorted(r.doc_id for r in sent["wanted"]) == [60, 61]
    assert got == {i: int(i == 61) for i in range(62)}


def test_words_and_pieces_as_split_by_hand():
    draw = random.Random(1)
    bits = ["a ", "bb ", "c. ", "d! e ", "\n", "\n\n", ". ", "...", "x y z w v u. ", "\t", "é. ", "\x0b",
            "y" * 64 + " ", "y" * 65 + " ", "y" * 66 + ". ", "one two three four five six "]
    number, back = {}, {}
    for text in ["", ".", "\n", "a b c.", "..\n"] + [
            "".join(draw.choice(bits) for _ in range(draw.randrange(60))) for _ in range(500)]:
        own, low = pd_.Paragraphs(text), text.encode().lower()
        words = low.split()
        assert len(own.words) == len(words)
        for word, value in zip(words, own.words.tolist()):
            assert number.setdefault(word, value) == value and back.setdefault(value, word) == word
        for first, end, a, b in own.pieces:
            assert low[first:end].split() == words[a:b]
        assert [p[0] for p in own.pieces] == [0] + [p[1] for p in own.pieces[:-1]]
        assert own.pieces[-1][1] == own.size == len(low)
