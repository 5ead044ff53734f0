"""Byte-pair encoding by dynamic programming over prefixes, and its decoding.

For every prefix of a word, exact BPE ends in one determined token.  An
automaton over the vocabulary lists the tokens that are suffixes of each
prefix; the last token of a prefix is the one among them that is compatible
with the last token of what stands before it.  Two tokens are compatible if
merging their joined symbols in rank order never crosses the border between
them.  Following the tokens back from the word's end gives the exact ids, with
no merge loop over the text.

The vocabulary file is the caller's; its text travels with the tasks.  Encoded
chunks (runs without ASCII white space) are cached per worker up to a bound.

Defined results: null text counts as empty and gives no ids; a special token's
own string in a text becomes its id, as in the library; other columns are
ignored; rows stay one to one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame

from blocklens.llm.common import map_frames, own_caches, session, texts

#: cached chunks and token pairs of a worker; a full cache starts anew
CACHED_CHUNKS, CACHED_PAIRS = 400_000, 1_000_000
#: marks that make words of their own behind a plain word
MARKS = b".,;:!?"
NEVER = 1 << 60
#: below this character every Unicode version agrees on letters, digits and cases
LATIN = "\u0250"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level BPE file with word ends."""

    def __init__(self, file_text: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        self._words = regex.compile(pattern)
        library = Tokenizer.from_str(file_text)
        self._shape, self._cut = library.normalizer, library.pre_tokenizer
        self._byte = {c: b for b, c in enumerate(byte_symbols())}

        # every token as a string of base symbols (one character each)
        plain = [vocab[c] for c in byte_symbols()]
        ended = [vocab[c + end] for c in byte_symbols()]
        self._plain = [chr(i) for i in plain]
        self._ended = [chr(i) for i in ended]
        self._span = {i: chr(i) for i in plain + ended}
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self._rank.setdefault((a, b), rank)
            if made not in self._span:
                self._span[made] = self._span[a] + self._span[b]
                self._parts[made] = (a, b, rank)
        self._left: dict[int, tuple[list, list]] = {}
        self._right: dict[int, tuple[list, list]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, span in self._span.items():
            if t not in self._parts or self.compatible(*self._parts[t][:2], below=self._parts[t][2]):
                self._automaton.add_word(span, (t, len(span)))
        self._automaton.make_automaton()
        self._specials = [s.encode() for s in self.special]
        self._chunks: dict[bytes, tuple[bytes, bytes, int]] = {}

    # --- pairs ------------------------------------------------------------

    def _spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """Tokens along one edge of a token's merge tree, leaf first, and the
        rank at which each is swallowed by the next (never, for the token)."""
        known = (self._left, self._right)[side]
        if token not in known:
            tokens, until = [token], [NEVER]
            while tokens[-1] in self._parts:
                a, b, rank = self._parts[tokens[-1]]
                tokens.append((a, b)[side])
                until.append(rank)
            known[token] = (tokens[::-1], until[::-1])
        return known[token]

    def compatible(self, a: int, b: int, below: int = NEVER) -> bool:
        """Whether merging the symbols of ``a`` and ``b`` together gives just
        the two again (looking only at merges of a rank under ``below``)."""
        edge, edge_until = self._spine(a, 1)
        front, front_until = self._spine(b, 0)
        i = j = 0
        while True:
            x, y = edge_until[i], front_until[j]
            across = self._rank.get((edge[i], front[j]), NEVER)
            # equal ranks: the leftmost pair merges first
            if across < below and across < x and across <= y:
                return False
            if x == NEVER and y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    # --- words ------------------------------------------------------------

    def word(self, data: bytes) -> list[int]:
        """The ids of one word, given in bytes."""
        symbols = "".join([self._plain[b] for b in data[:-1]]) + self._ended[data[-1]]
        last: list[int] = [-1] * len(symbols)
        size: list[int] = [0] * len(symbols)
        pairs = self._pairs
        for at, (token, n) in self._automaton.iter(symbols):
            if size[at]:
                continue
            before = at - n
            if before >= 0:
                if not size[before]:
                    continue
                pair = (last[before], token)
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self.compatible(*pair)
                if not ok:
                    continue
            last[at], size[at] = token, n
        ids, at = [], len(symbols) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _ordinary(self, text: str) -> list[int]:
        if text.isascii() or max(text) < LATIN:
            shaped = unicodedata.normalize("NFC", text).lower()
            return [i for w in self._words.findall(shaped) for i in self.word(w.encode())]
        # elsewhere letters, digits and cases are those of the library's Unicode version
        words = self._cut.pre_tokenize_str(self._shape.normalize_str(text))
        return [i for w, _ in words for i in self.word(bytes(map(self._byte.get, w)))]

    def encode(self, text: str) -> list[int]:
        ids, at = [], 0
        for found in self._special.finditer(text):
            ids += self._ordinary(text[at:found.start()])
            ids.append(self.special[found[0]])
            at = found.end()
        return ids + self._ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    # --- whole texts --------------------------------------------------------

    def _known(self, chunk: bytes) -> tuple[bytes, bytes, int]:
        """One chunk's ids in decimal, its decoded text, its number of ids."""
        got = self._chunks.get(chunk)
        if got is None:
            # ASCII letters alone are one word and stand for themselves
            plain = chunk.isalpha() and not self._special.search(chunk.decode())
            ids = self.word(chunk.lower()) if plain else self.encode(chunk.decode())
            got = (" ".join(map(str, ids)).encode(), self.decode(ids).encode(), len(ids))
            if len(chunk) <= 64:
                if len(self._chunks) >= CACHED_CHUNKS:
                    self._chunks.clear()
                self._chunks[chunk] = got
        return got

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes, int]:
        """The same; a plain word with marks behind it is looked up as two."""
        word = chunk.rstrip(MARKS)
        if word and len(word) < len(chunk) and word.isalpha() and not self._special.search(chunk.decode()):
            a, b = self._known(word), self._known(chunk[len(word):])
            return a[0] + b" " + b[0], a[1] + b" " + b[1], a[2] + b[2]
        return self._known(chunk)

    def round_trip(self, text: str) -> tuple[bytes, bytes, int]:
        """A text's ids in decimal, joined by blanks; the text decoded from
        them; their number."""
        data = text.encode()
        folded = data.lower()
        if not any([s in data or s in folded for s in self._specials]):
            try:    # no combining characters: case may be folded before composing
                text.encode("latin-1")
                data = folded
            except UnicodeEncodeError:
                pass
        chunks = data.split()               # white space in ASCII only
        known = list(map(self._chunks.get, chunks))
        if None in known:
            known = [k or self._chunk(c) for k, c in zip(known, chunks)]
        known = [k for k in known if k[2]]
        if not known:
            return b"", b"", 0
        ids, decoded, n = zip(*known)
        return b" ".join(ids), b" ".join(decoded), sum(n)


_CODECS: dict[str, Codec] = {}


def codec(file_text: str) -> Codec:
    """One codec per worker and file, with its caches."""
    own_caches("bpe", _CODECS.clear)
    key = hashlib.sha1(file_text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(file_text)
    return _CODECS[key]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text."""
    session(docs)
    file_text = open(tokenizer_path, encoding="utf-8").read()

    def run(frames):
        own = codec(file_text)
        for frame in frames:
            trips = [own.round_trip(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"],
                                "ids": [list(map(int, t[0].split())) for t in trips],
                                "decoded": [t[1].decode() for t in trips]})

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(rows, run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of what
    :func:`encode_documents` returns, taken where the ids are made."""
    session(docs)
    file_text = open(tokenizer_path, encoding="utf-8").read()

    def run(frames):
        own = codec(file_text)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for frame in frames:
            trips = [own.round_trip(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [t[2] for t in trips],
                                "ids_sha256": [sha(t[0]) for t in trips],
                                "decoded_sha256": [sha(t[1]) for t in trips]})

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(
        rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
