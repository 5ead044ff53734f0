import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blocklens.llm import bpe
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def both(word_bpe):
    library = Tokenizer.from_file(word_bpe)
    library.no_truncation()
    library.no_padding()
    return bpe.Codec(open(word_bpe, encoding="utf-8").read()), library


def same(both, text):
    own, library = both
    ids, decoded, n = own.round_trip(text)
    want = library.encode(text, add_special_tokens=False).ids
    got = list(map(int, ids.split()))
    assert got == want and n == len(want), text
    assert decoded.decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(
    st.sampled_from("aaabbcdethin'srRTHÉé<|> \n\t\x0b\x1c\x85  ²½0１.,!?-_ẖΣςİßŉﬃǅÅ한글日本🙂‍̱́"),
    st.characters(exclude_categories=["Cs"])), max_size=30))
def test_any_text(both, text):
    same(both, text)


def test_words_specials_and_long_texts(both):
    rng = random.Random(2)
    for _ in range(300):
        same(both, " ".join("".join(rng.choice("abcdefghinorstuéü'") for _ in range(rng.randint(1, 30)))
                            for _ in range(6)) + rng.choice(["", ".", "!?", "<|endoftext|>", " <|startoftext|>z"]))
    same(both, "ab" * 20_000)
    same(both, "<|ENDOFTEXT|> <|endoftext|><|endoftext|>")


def test_every_pair_of_a_prefix_is_checked_by_plain_merging(both):
    """compatible() is what merging the joined symbols says."""
    own, _ = both

    def merge(symbols):
        ids = [ord(c) for c in symbols]
        while True:
            ranks = [(own._rank.get(p, bpe.NEVER), i) for i, p in enumerate(zip(ids, ids[1:]))]
            best = min(ranks, default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                return ids
            rank, i = best
            pair = (ids[i], ids[i + 1])
            made = next(t for t, (a, b, _) in own._parts.items() if (a, b) == pair)
            ids[i:i + 2] = [made]

    rng = random.Random(4)
    tokens = [t for t, s in own._span.items() if 1 < len(s) < 6 and max(map(ord, s)) < 256]
    for _ in range(25):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert own.compatible(a, b) == (merge(own._span[a] + own._span[b]) == [a, b])


def test_small_caches_change_nothing(word_bpe, monkeypatch, both):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    own = bpe.Codec(open(word_bpe, encoding="utf-8").read())
    same((own, both[1]), "one two three, four five six. one two seven eight nine ten")


def test_documents(make_docs, word_bpe, both):
    docs = make_docs(ODD)
    got = bpe.digest_documents(docs, word_bpe).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in ODD:
        ids = both[1].encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))),
                     sha(both[1].decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = {r.doc_id: r for r in bpe.encode_documents(docs, word_bpe).collect()}
    assert full[1].ids == [] and full[1].decoded == ""
    assert bpe.digest_documents(make_docs([]), word_bpe).count() == 0
