"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1.  A letter trigram is bound by
multiplying its letters' vectors, the first permuted twice and the second once
(a cyclic shift).  A text is the bundle (sum) of its trigrams' vectors, a
language the bundle of its training texts, and a text is compared with every
language's prototype by cosine.

Texts are lower-cased; each run of characters that are no letters counts as
one blank, and so do the two ends of the text.

Defined results: a null text, or one without a letter, gets ``und`` and score
0; equal cosines go to the language that sorts first; without training rows
everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import own_caches, session, stage

DIMENSIONS = 512
SEED = 9
#: prototypes compared in one pass; more languages take more passes
LANGUAGES_PER_PASS = 1024
#: texts whose trigrams are bundled together, and the characters after which a chunk closes
CHUNK_DOCS, CHUNK_CHARS = 128, 1_500_000
#: trigrams that a chunk's texts are counted by, and whose vectors are held, at once
COUNTED, VECTORS = 16_384, 2048
#: above this many distinct characters, trigrams are numbered by sorting
DENSE_LETTERS = 96

UNKNOWN = "und"


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random vector of a code point (0 is the blank)."""
    draw = np.random.default_rng((SEED, code)).integers(0, 2, dimensions, dtype=np.int8)
    return draw * np.int8(2) - np.int8(1)


class _Letters:
    """Per-process tables: which characters are letters, and their vectors."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.kind = np.full(0x110000, -1, np.int8)      # 1 letter, 0 not, -1 not asked yet
        self.vectors: dict[int, np.ndarray] = {}

    def is_letter(self, codes: np.ndarray) -> np.ndarray:
        got = self.kind[codes]
        if (got < 0).any():
            for c in np.unique(codes[got < 0]):
                self.kind[c] = chr(c).isalpha()
            got = self.kind[codes]
        return got > 0

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        if len(self.vectors) > 50_000:
            self.vectors.clear()
        for c in codes.tolist():
            if c not in self.vectors:
                self.vectors[c] = letter_vector(c, self.dimensions)
        return np.stack([self.vectors[c] for c in codes.tolist()])


_TABLES: dict[int, _Letters] = {}


def _letters(dimensions: int) -> _Letters:
    own_caches("language_id", _TABLES.clear)
    return _TABLES.setdefault(dimensions, _Letters(dimensions))


def _trigrams(texts: list[str], letters: _Letters):
    """(text number of each trigram, its id, the alphabet, the id base) of a chunk."""
    ended = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(ended).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in ended])
    codes = np.where(letters.is_letter(codes), codes, 0)
    stay = np.ones(len(codes), bool)        # one blank for a run, within one text
    stay[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[stay], owner[stay]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), 1
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    r, base = rank[codes], len(alphabet)
    gram = (r[:-2] * base + r[1:-1]) * base + r[2:]
    ok = (owner[:-2] == owner[2:]) & (codes[1:-1] != 0) | (
        (owner[:-2] == owner[2:]) & (codes[:-2] != 0) & (codes[2:] != 0))
    return owner[:-2][ok], gram[ok], alphabet, base


def _numbered(gram: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a chunk, and for every trigram its number among them."""
    if base > DENSE_LETTERS:
        return np.unique(gram, return_inverse=True)
    there = np.zeros(base ** 3, bool)
    there[gram] = True
    distinct = np.flatnonzero(there)
    number = np.zeros(base ** 3, np.int64)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[gram]


def _vectors(distinct, alphabet, base, letters) -> np.ndarray:
    """The bound vector of each distinct trigram."""
    rows = letters.matrix(alphabet)
    once, twice = np.roll(rows, 1, axis=1), np.roll(rows, 2, axis=1)
    return twice[distinct // (base * base)] * once[distinct // base % base] * rows[distinct % base]


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One bundle (float32, exact integers below 2**24) for each text."""
    letters = _letters(dimensions)
    owner, gram, alphabet, base = _trigrams(texts, letters)
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(gram):
        return out
    distinct, number = _numbered(gram, base)
    for at in range(0, len(distinct), COUNTED):
        n = min(COUNTED, len(distinct) - at)
        own = (number >= at) & (number < at + n) if n < len(distinct) else slice(None)
        counts = np.bincount(owner[own] * n + number[own] - at, minlength=len(texts) * n).reshape(len(texts), n)
        for some in range(0, n, VECTORS):
            vectors = _vectors(distinct[at + some:at + min(some + VECTORS, n)], alphabet, base, letters)
            out += counts[:, some:some + VECTORS].astype(np.float32) @ vectors.astype(np.float32)
    return out


def _chunks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        size = frame["text"].str.len().fillna(0).to_numpy()
        start, chars = 0, 0
        for i in range(len(frame)):
            chars += size[i]
            if i + 1 - start >= CHUNK_DOCS or chars >= CHUNK_CHARS or i + 1 == len(frame):
                yield frame.iloc[start:i + 1]
                start, chars = i + 1, 0


def _profile(dimensions: int):
    """Training texts of a task -> one partial bundle for each language."""
    def run(frames):
        letters = _letters(dimensions)
        total: dict[str, np.ndarray] = {}
        for frame in _chunks(frames):
            for lang, own in frame.groupby("lang")["text"]:
                _, gram, alphabet, base = _trigrams(own.tolist(), letters)
                if not len(gram):
                    continue
                distinct, number = _numbered(gram, base)
                counts = np.bincount(number)
                sums = np.zeros(dimensions)
                for at in range(0, len(distinct), VECTORS):
                    part = slice(at, at + VECTORS)
                    sums += counts[part].astype(np.float64) @ _vectors(
                        distinct[part], alphabet, base, letters).astype(np.float64)
                total[lang] = total.get(lang, 0) + sums.astype(np.int64)
        for lang, sums in total.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(dimensions), "value": sums})
    return run


def train_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, prototype array<long>) from rows (text, lang) with both present.

    Every task sends one partial bundle a language; sums of integers do not
    depend on the order in which tasks end.
    """
    session(docs)
    known = docs.select("lang", "text").where("lang is not null and text is not null")
    partial = known.mapInPandas(_profile(dimensions), "lang string, at int, value long")
    return (partial.groupBy("lang", "at").agg(F.sum("value").alias("value"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))),
                                             lambda x: x["value"]).alias("prototype")))


def _compare(names: list[str], prototypes: np.ndarray, dimensions: int):
    """Texts -> the nearest of some prototypes and its cosine."""
    unit = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)

    def nearest(text: pd.Series) -> pd.DataFrame:
        parts = []
        for chunk in _chunks([text.to_frame("text")]):
            bundle = bundles(chunk["text"].fillna("").tolist(), dimensions).astype(np.float64)
            norm = np.linalg.norm(bundle, axis=1)
            cosine = (bundle / np.maximum(norm, 1e-300)[:, None]) @ unit.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            parts.append(pd.DataFrame({
                "lang_pred": np.where(norm > 0, np.array(names, object)[best], UNKNOWN),
                "score": np.where(norm > 0, score, 0.0)}))
        if not parts:
            return pd.DataFrame({"lang_pred": [], "score": []})
        return pd.concat(parts, ignore_index=True)
    return F.pandas_udf(nearest, "lang_pred string, score double")


def predict_languages(docs: DataFrame, prototypes: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with a struct _language (lang_pred, score: the best cosine, 0 to 1).

    Prototypes reach the tasks ``LANGUAGES_PER_PASS`` at a time (4 MB with 512
    dimensions); with more languages, each pass is compared with the best so far.
    """
    session(docs)
    names = [r[0] for r in prototypes.select("lang").orderBy("lang").toLocalIterator()]
    best = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = docs.withColumn("_language", best)
    for at in range(0, len(names), LANGUAGES_PER_PASS):
        some = names[at:at + LANGUAGES_PER_PASS]
        own = dict(prototypes.where(F.col("lang").between(some[0], some[-1])).collect())
        matrix = np.array([own[n] for n in some], np.float64)
        out = out.withColumn("_pass", _compare(some, matrix, dimensions)(F.col("text")))
        if at:
            out = out.withColumn("_pass", F.when(
                F.col("_pass.score") > F.col("_language.score"), F.col("_pass"))
                .otherwise(F.col("_language")))
        out = out.withColumn("_language", F.col("_pass")).drop("_pass")
    return out


def is_training(doc_id: Column, folds: int = 3, held_out: int = 1) -> Column:
    """True for documents whose crc32(doc_id as text) mod ``folds`` is not ``held_out``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held_out, F.lit(False))


def learned(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes learned from the training fold of (doc_id, text, lang)."""
    train = docs.where(is_training(F.col("doc_id"))).select("text", "lang")
    return stage(train_prototypes(train, dimensions), "prototypes")


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the training fold, predicts all.

    Rows without a doc_id are not learned from; their held_out is null.
    """
    rows = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
                       .alias("held_out"))
    return predict_languages(rows, learned(docs, dimensions), dimensions).select(
        "doc_id", "held_out", "_language.lang_pred", "_language.score")


def keep_identified(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` in some language, all columns: rejected are texts without a letter
    and texts no nearer to any language than random vectors are to one another
    (a cosine below one over the root of the dimensions)."""
    found = predict_languages(docs, learned(docs, dimensions), dimensions)
    return found.where((F.col("_language.lang_pred") != UNKNOWN)
                       & (F.col("_language.score") >= dimensions ** -0.5)).select(docs.columns)
