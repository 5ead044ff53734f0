"""Paragraph dedup: MinHash banding, exact Jaccard, components, removal.

Passages are copied as whole paragraphs, but also into the middle of other
ones.  So a text's paragraphs are its lines and, in lines of several
sentences, each sentence too; those of ``SHINGLE`` words or more count.
Shorter neighbours are merged: from each of them on, as many as make
``MERGED`` words are a paragraph, which only equals or does not.

1. A paragraph's 5-word shingles are hashed and min-hashed.  Signatures are
   cut into bands (``BANDS``: all get 4 of 2 values, which finds a pair of
   similarity 0.8 with probability 0.98, also a line and a sentence; lines get
   9 of 3 values too, so two lines are found with 0.998 or more; equal
   paragraphs always meet).  Paragraphs that share a band collide.  A bit map of
   64 bits of a paragraph's shingles bounds from below how many two of them do
   not share; who is too far from all others of its band leaves it, and bands
   left with the same paragraphs are one.
2. Colliding paragraphs are compared by the Jaccard similarity of their
   shingles; 0.8 or more links them.
3. Connected components of equal and linked paragraphs are the groups.  The
   occurrence with the smallest (doc_id, place) stays, all others are repeats.
   A line and a sentence in it are one passage: they are neither linked nor
   repeats of one another.
4. Runs of repeats side by side go if they hold ``RUN_WORDS`` words, so a
   short line that many documents share stays where it stands alone.  A text
   that is repeats from end to end goes whatever its length.

Of equal texts only the one with the smallest doc_id takes part; the others
are repeats from end to end.  A band with many members is split into blocks of
``BLOCK``, whose pairs are separate groups of rows; a group sends on a
spanning forest of its links, never all pairs.

Defined results: null text counts as empty; texts without a paragraph of five
words stay whole unless they are copies; rows equal in doc_id and text are one
document, judged alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import connected_components, drop_stage, map_frames, session, stage, texts
from blocklens.llm.suffix_dedup import _listed

SHINGLE, SIMILARITY = 5, 0.8
#: (bands, values a band) of all units, and those that lines have besides
BANDS = {"all": (4, 2), "line": (9, 3)}
RUN_WORDS = 28
#: least words of short neighbouring pieces that make one paragraph
MERGED = 14
BLOCK = 1024
SEED = 1
#: characters of texts that are cut, and tokens whose signatures are taken, at once
CHUNK_CHARS, CHUNK_TOKENS = 1 << 20, 500_000
#: rows of sorted keys looked at together, and of groups with their shingles
ROWS, LINK_ROWS = 1 << 16, 1 << 12
#: members from which on a group is compared by arrays
FEW = 8

#: of each byte, whether it is one of these
_SPACE, _STOP = (bytes(b in own for b in range(256)) for own in (b" \t\n\v\f\r", b".!?"))


def _mix(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """Mixes ``x`` in place; ``spare`` is room of its size."""
    spare = np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint64(0x7FB5D329728EA185), out=x)
    np.right_shift(x, np.uint64(27), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def _word_hashes(low: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of the words that begin ``at``: those under 32 bytes, which take one
    pass over their bytes, by arrays, all others one by one."""
    from xxhash import xxh64_intdigest
    one, two, three, four, five = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    room = low + bytes(8)
    eight, quad = (np.ndarray((len(low) + 1,), t, room, strides=(1,)) for t in ("<u8", "<u4"))
    raw = np.frombuffer(room, np.uint8)

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    out = np.uint64(SEED) + five + size.astype(np.uint64)
    for i in range(3):
        some = np.flatnonzero((size >= 8 * (i + 1)) & (size < 32))
        if not len(some):
            break
        lane = turned(eight[at[some] + 8 * i] * two, 31) * one
        out[some] = turned(out[some] ^ lane, 27) * one + four
    some = np.flatnonzero(size & 4)
    out[some] = turned(out[some] ^ (quad[at[some] + (size[some] & ~7)].astype(np.uint64) * one), 23) * two + three
    for i in range(3):
        some = np.flatnonzero((size & 3) > i)
        out[some] = turned(out[some] ^ (raw[at[some] + (size[some] & ~3) + i].astype(np.uint64) * five), 11) * one
    out = (out ^ (out >> np.uint64(33))) * two
    out = (out ^ (out >> np.uint64(29))) * three
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxh64_intdigest(low[at[i]:at[i] + size[i]], SEED)
    return out


def _cut(texts: list[str], hashes: bool = True):
    """(size, words, their hashes, pieces, units) of each of some texts, cut
    together: one space stands between them."""
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    since = np.cumsum(sizes + 1) - sizes - 1            # each text's first byte
    low, full = b" ".join(data).lower(), sizes > 0
    raw = np.frombuffer(low, np.uint8)
    space, stop = (np.frombuffer(low.translate(table), bool) for table in (_SPACE, _STOP))
    # pieces end after .!? before white space, or after a line feed: never in a word
    close = raw == 10
    close[:-1] |= stop[:-1] & space[1:]
    close[(since + sizes)[full] - 1] = True
    ends = np.sort(np.concatenate((np.flatnonzero(close) + 1, since[~full])))
    of = np.searchsorted(since, ends, "right") - 1      # each piece's text
    new = np.append(True, of[1:] != of[:-1])
    starts = np.append(0, ends[:-1])
    starts[new] = since
    begin = ~space
    begin[1:] &= space[:-1]
    at = np.flatnonzero(begin)                          # each word's first byte
    last = np.searchsorted(at, ends)
    first = np.append(0, last[:-1])
    words = last - first
    fed = full[of]
    fed[fed] = raw[ends[fed] - 1] == 10
    head = np.flatnonzero(new | np.append(True, fed[:-1]))      # each line's first piece
    tail = np.append(head[1:], len(ends)) - 1
    line = np.repeat(np.arange(len(head)), tail - head + 1)
    own = np.add.reduceat((words > 0).astype(np.int64), head)
    # units: every piece of enough words, then every line of several pieces with
    # words; a line's only piece with words is the line, its end included
    long = np.flatnonzero(words >= SHINGLE)
    sole = own[line[long]] == 1
    whole = np.flatnonzero((own > 1) & (last[tail] - first[head] >= SHINGLE))
    # runs of pieces too short to be units: from each piece on, merged
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    to = np.searchsorted(last, first[short] + MERGED)
    bound = np.append(np.flatnonzero(new)[1:], len(ends))[of[short]]
    ok = to < np.minimum(np.append(long, len(ends))[np.searchsorted(long, short)], bound)
    short, to = short[ok], to[ok]
    x = np.concatenate((np.where(sole, head[line[long]], long), head[whole], short))
    y = np.concatenate((np.where(sole, tail[line[long]], long), tail[whole], to))
    a = np.concatenate((first[long], first[head[whole]], first[short]))
    b = np.concatenate((last[long], last[tail[whole]], last[to]))
    kind = np.concatenate((np.where(sole, 0, 1), np.zeros(len(whole), np.int64), np.full(len(short), 2)))
    order = np.argsort(of[x], kind="stable")
    x, y, a, b, kind = (c[order] for c in (x, y, a, b, kind))
    piece_at = np.append(np.flatnonzero(new), len(ends))
    unit_at = np.searchsorted(of[x], np.arange(len(data) + 1))
    word_at = np.append(first[piece_at[:-1]], len(at))
    back, ahead, down = since[of], word_at[of], word_at[of[x]]
    pieces = list(zip(*(c.tolist() for c in (starts - back, ends - back, first - ahead, last - ahead))))
    kinds = np.array(["line", "sentence", "merged"], object)[kind]
    units = list(zip(*(c.tolist() for c in (x - piece_at[of[x]], y - piece_at[of[x]], a - down, b - down, kinds))))
    hashed = None
    if hashes:
        over = ~space
        over[:-1] &= space[1:]
        hashed = _word_hashes(low, at, np.flatnonzero(over) + 1 - at)
    bounds = (c.tolist() for c in (sizes, word_at, word_at[1:], piece_at, piece_at[1:], unit_at, unit_at[1:]))
    for size, w, w_end, p, p_end, u, u_end in zip(*bounds):
        yield size, w_end - w, hashed[w:w_end] if hashes else None, pieces[p:p_end], units[u:u_end]


class Paragraphs:
    """Lines and sentences of one text, as ranges of bytes and of words."""

    def __init__(self, text: str, parts=None):
        #: pieces: (first byte, end, first word, end);
        #: units: (first piece, last, first word, end, kind)
        self.size, self.n_words, self.words, self.pieces, self.units = parts or next(_cut([text]))

    @classmethod
    def of(cls, texts: list[str], hashes: bool = True) -> list[Paragraphs]:
        """Those of some texts, ``CHUNK_CHARS`` characters cut together; words are
        hashed if ``hashes``."""
        out, held, chars = [], [], 0
        for i, text in enumerate(texts):
            held.append(text)
            chars += len(text)
            if chars >= CHUNK_CHARS or i + 1 == len(texts):
                out += [cls(t, parts) for t, parts in zip(held, _cut(held, hashes))]
                held, chars = [], 0
        return out

    def overlap(self, u: int, v: int) -> bool:
        """Whether two units have a piece in common."""
        return self.units[u][0] <= self.units[v][1] and self.units[v][0] <= self.units[u][1]

    def names(self) -> np.ndarray:
        """One hash for each unit's words."""
        from xxhash import xxh64_intdigest
        raw = self.words.tobytes()
        return np.fromiter((xxh64_intdigest(raw[8 * a:8 * b], SEED) for _, _, a, b, _ in self.units),
                           np.uint64, len(self.units)).view(np.int64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each run of ``SHINGLE`` word hashes."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n])
    return out


def bit_maps(own: list[Paragraphs]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text's units: one bit for each shingle's hash modulo 64, and the
    number of shingles, repeats included."""
    grams = shingles(np.concatenate([p.words for p in own] + [np.zeros(SHINGLE, np.uint64)]))
    bits = np.append(np.uint64(1) << (grams & np.uint64(63)), np.uint64(0))
    first, end, count = _ranges(own)
    sizes, held = np.maximum(end - first, 0), np.zeros(len(first), np.uint64)
    some = sizes > 0
    if some.any():
        held[some] = np.bitwise_or.reduceat(bits, np.stack((first, end), axis=1)[some].ravel())[::2]
    cuts = np.cumsum(count)[:-1]
    return np.split(held.view(np.int64), cuts), np.split(sizes, cuts)


def _ranges(own: list[Paragraphs]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First shingle and end of all units, in the texts' words side by side, and
    the number of units of each text."""
    count = np.array([len(p.units) for p in own], np.int64)
    size = np.array([len(p.words) for p in own], np.int64)
    at = np.array([(u[2], u[3]) for p in own for u in p.units], np.int64).reshape(-1, 2)
    at += np.repeat(np.cumsum(size) - size, count)[:, None]
    return at[:, 0], at[:, 1] - SHINGLE + 1, count


def band_keys(own: list[Paragraphs]) -> tuple[np.ndarray, np.ndarray]:
    """(band key, unit name) of every unit of some texts, each once."""
    words = np.concatenate([p.words for p in own] + [np.zeros(SHINGLE, np.uint64)])
    first, end, _ = _ranges(own)
    kinds = np.array([u[4] for p in own for u in p.units])
    # merged paragraphs of neighbouring offsets are alike: no near copies of them
    banded = np.flatnonzero(kinds != "merged") if len(kinds) else []
    if not len(banded):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    name, line = np.concatenate([p.names() for p in own])[banded], kinds[banded] == "line"
    # a name that stands several times, as a line if it is one anywhere
    name, one, number = np.unique(name, return_index=True, return_inverse=True)
    line = np.bincount(number, line) > 0
    first, end = first[banded][one], end[banded][one]
    grams = shingles(words)
    draw = np.random.default_rng(SEED)
    keys, of = [], []
    values = max(b * r for b, r in BANDS.values())
    factors = draw.integers(0, 1 << 63, (values, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = np.argsort(first, kind="stable")
    name, line = name[order], line[order]
    ranges = np.stack((first[order], end[order]), axis=1)
    needed = np.ones(len(name), bool)
    wide = BANDS["all"][0] * BANDS["all"][1]
    hashed, spare = np.zeros(len(grams) + 1, np.uint64), np.empty(len(grams), np.uint64)
    mixed = hashed[:-1]
    low = []                # minima by value; those that only lines need stand beside them
    for i in range(values):
        if i == wide:
            needed = line
            if not needed.any():
                break
        mul, add = factors[i]
        np.multiply(grams, mul, out=mixed)
        np.add(mixed, add, out=mixed)
        _mix(mixed, spare)
        low.append(np.minimum.reduceat(hashed, ranges[needed].ravel())[::2])
    for kind, (bands, rows) in BANDS.items():
        own = line if kind == "line" else np.ones(len(name), bool)
        if not own.any():
            continue
        for band in range(bands):
            key = np.full(int(own.sum()), band, np.uint64)
            for i in range(band * rows, (band + 1) * rows):
                value = low[i][own] if i < wide else low[i]
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
            keys.append(key.view(np.int64))
            of.append(name[own])
    return np.concatenate(keys), np.concatenate(of)


def _bands(batches):
    for batch in batches:
        held, tokens = [], 0
        every = Paragraphs.of(batch.column(0).to_pylist())
        for i, own in enumerate(every):
            held.append(own)
            tokens += len(own.words)
            if tokens >= CHUNK_TOKENS or i + 1 == len(every):
                key, name = band_keys(held)
                yield _batch(key=key, name=name)
                held, tokens = [], 0


def _runs(batches):
    """Arrow batches sorted by key, the name second -> the columns of whole keys,
    some ``ROWS`` rows at a time; of a key that goes on a name is held once."""
    held, rows, wait = [], 0, ROWS
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < wait:
            continue
        every = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(every[0], every[0][-1]))
        if cut:
            yield [c[:cut] for c in every]
        once = cut + np.unique(every[1][cut:], return_index=True)[1]
        held, rows = [[c[once] for c in every]], len(once)
        wait = max(ROWS, 2 * rows)
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal keys."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return edge, np.diff(np.append(edge, len(key)))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _collisions(batches):
    """Rows sorted by key -> the rows of keys that several names share, each once."""
    for key, name in _runs(batches):
        edge, size = _edges(key)
        mixed = np.minimum.reduceat(name, edge) != np.maximum.reduceat(name, edge)
        some = np.repeat(mixed, size)
        key, name = key[some], name[some]
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        yield _batch(key=key[new], name=name[new])


def _near(batches):
    """(key, name, bits, grams) sorted by key -> (group, name) of the names that
    may be alike another one of their key.

    Every bit that two maps do not share stands for a shingle that one of them
    lacks.  Keys left with the same names are one group, named by the sum of
    their hashes; a key of more than ``BLOCK`` names stays as it is.
    """
    most = (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9     # of all shingles, that two do not share
    for key, name, bits, grams in _runs(batches):
        bits = bits.view(np.uint64)
        edge, size = _edges(key)
        left = np.repeat(np.arange(len(key))[edge] + size, size) - np.arange(len(key)) - 1
        large = np.repeat(size > BLOCK, size)
        near, apart = large.copy(), 1
        one = np.flatnonzero((left >= apart) & ~large)
        while len(one):
            other = one + apart
            alike = np.bitwise_count(bits[one] ^ bits[other]) <= most * (grams[one] + grams[other])
            near[one[alike]] = near[other[alike]] = True
            apart += 1
            one = one[left[one] >= apart]
        key, name, large = key[near], name[near], large[near]
        if len(key):
            edge, size = _edges(key)
            group = np.repeat(np.add.reduceat(_mix(name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                              edge).view(np.int64), size)
            yield _batch(key=np.where(large, key, group), name=name)


def _link(names: np.ndarray, grams: list[np.ndarray], home: np.ndarray, first: np.ndarray,
          last: np.ndarray) -> list[tuple[int, int]]:
    """Links at the similarity among the members of one group, as a forest.

    Names that stand once, in the same text (``home``, 0 for others) and on
    common pieces, are the same passage and not linked.
    """
    size = np.array([len(g) for g in grams])
    left, out = np.arange(len(names)), []
    every, start = None, None
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            node = queue.pop()
            if len(left) < 8:
                own = set(grams[node].tolist())
                common = np.array([len(own.intersection(grams[i].tolist())) for i in left])
            else:
                if every is None:
                    every, start = np.concatenate(grams), np.cumsum(size) - size
                common = np.add.reduceat(np.isin(every, grams[node]), start, dtype=np.int64)[left]
            near = common >= SIMILARITY * (size[node] + size[left] - common) - 1e-9
            near &= ~((home[node] != 0) & (home[left] == home[node])
                      & (first[left] <= last[node]) & (first[node] <= last[left]))
            out += [(names[node], names[i]) for i in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def _link_few(names: list, grams: list[set], home: list, first: list, last: list) -> list[tuple[int, int]]:
    """``_link`` for a few members, each other pair looked at by sets."""
    left, out = list(range(len(names))), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and left:
            node, apart = queue.pop(), []
            own, n = grams[node], len(grams[node])
            for i in left:
                common = len(own & grams[i])
                if common >= SIMILARITY * (n + len(grams[i]) - common) - 1e-9 and not (
                        home[node] != 0 and home[i] == home[node]
                        and first[i] <= last[node] and first[node] <= last[i]):
                    out.append((names[node], names[i]))
                    queue.append(i)
                else:
                    apart.append(i)
            left = apart
    return out


def _links(batches):
    """Arrow batches sorted by group -> links; many small groups share a call."""
    def edges(table: pa.Table) -> np.ndarray:
        new = np.append(True, np.zeros(len(table) - 1, bool))
        for c in ("key", "x", "y"):
            column = table[c].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    def of(table: pa.Table) -> pa.RecordBatch:
        edge = np.append(edges(table), len(table)).tolist()
        lists = table["grams"].combine_chunks()
        at, values = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
        name, home, first, last = (table[c].to_numpy() for c in ("name", "home", "first", "last"))
        rows = [c.tolist() for c in (name, home, first, last)]
        found = set()
        for a, b in zip(edge, edge[1:]):
            if 1 < b - a < FEW:
                few = values[at[a]:at[b]].tolist()
                grams = [set(few[at[i] - at[a]:at[i + 1] - at[a]]) for i in range(a, b)]
                found.update(_link_few(rows[0][a:b], grams, *(r[a:b] for r in rows[1:])))
            elif b - a > 1:
                grams = [values[at[i]:at[i + 1]] for i in range(a, b)]
                found.update((int(x), int(y)) for x, y in _link(
                    name[a:b], grams, home[a:b], first[a:b], last[a:b]))
        return _batch(a=[x for x, _ in found], b=[y for _, y in found])

    held, rows, wait = [], 0, LINK_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wait:
            continue
        table = pa.Table.from_batches(held)
        cut = int(edges(table)[-1])         # the last group may go on in the next batch
        if cut:
            yield of(table.slice(0, cut))
        rest = table.slice(cut)
        held, rows = rest.to_batches(), len(rest)
        wait = max(LINK_ROWS, 2 * rows)
    if rows:
        yield of(pa.Table.from_batches(held))


def link_paragraphs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b): links between names of different paragraphs.

    ``docs``: (doc_id, kind, text); ``places``: (name, doc_id, place, bits, grams)
    of all.
    """
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    banded = docs.select("text").mapInArrow(_bands, "key long, name long")
    met = stage(banded.repartition(parts, "key").sortWithinPartitions("key")
                .mapInArrow(_collisions, "key long, name long"), "collisions")
    asked = stage(met.select("name").distinct(), "colliding")
    # of a name all places have the same words
    one = stage(places.join(asked.hint("merge"), "name").groupBy("name").agg(
        F.min(F.struct("doc_id", "place")).alias("one"), F.count(F.lit(1)).alias("n"),
        F.min("bits").alias("bits"), F.min("grams").alias("grams")), "colliding-places")
    near = met.join(one.select("name", "bits", "grams").hint("merge"), "name").select(
        "key", "name", "bits", "grams")
    near = stage(near.repartition(parts, "key").sortWithinPartitions("key")
                 .mapInArrow(_near, "key long, name long").distinct(), "near")
    drop_stage(met)
    met = near
    one = one.select("name", "n", "one.*").join(met.select("name").distinct().hint("merge"), "name")
    kind = F.shiftright("place", 32).cast("int")
    lists = stage(one.groupBy("doc_id", kind.alias("kind")).agg(
        F.collect_list(F.struct(
            "name", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("unit"),
            F.when(F.col("n") == 1, F.xxhash64("doc_id", kind)).otherwise(F.lit(0)).alias("home")
        )).alias("wanted")), "wanted")
    entries = lists.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]

    def grams(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, wanted = Paragraphs.of(batch.column(0).to_pylist()), batch.column(1)
            count = np.diff(wanted.offsets.to_numpy())
            name, unit, home = (c.to_numpy() for c in wanted.flatten().flatten())
            text = np.repeat(np.arange(len(own)), count)
            rows = np.array([own[t].units[u][:4] for t, u in zip(text.tolist(), unit.tolist())],
                            np.int64).reshape(-1, 4)
            # shingles of each unit, sorted, each once
            size = np.array([len(p.words) for p in own], np.int64)
            every = shingles(np.concatenate([p.words for p in own] + [np.zeros(SHINGLE, np.uint64)])).view(np.int64)
            held = np.maximum(rows[:, 3] - rows[:, 2] - SHINGLE + 1, 0)
            at = (np.cumsum(size) - size)[text] + rows[:, 2] - (np.cumsum(held) - held)
            row = np.repeat(np.arange(len(rows)), held)
            value = every[np.arange(len(row)) + at[row]]
            order = np.lexsort((value, row))
            value = value[order]
            new = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1]))[:len(value)]
            offsets = np.append(0, np.cumsum(np.bincount(row[new], minlength=len(rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[new])),
                 pa.array(home), pa.array(rows[:, 0], pa.int32()), pa.array(rows[:, 1], pa.int32())],
                ["name", "grams", "home", "first", "last"])

    found = _listed(docs, lists, entries, "inner").select("text", "wanted").mapInArrow(
        grams, "name long, grams array<long>, home long, first int, last int")
    found = found.dropDuplicates(["name"])      # dealt by name, as the join below needs it
    # a key's members in blocks: every pair of blocks is one group
    size = stage(met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")),
                 "key-sizes")
    rows = met.join(size.hint("merge"), "key").withColumn(
        "own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).select(
        "key", "name", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                       "name").join(found.hint("merge"), "name")
    return rows.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(
        _links, "a long, b long").distinct()


def repeats(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, kind, units) of texts with repeated paragraphs, -1 for a whole
    text, and the number of entries; kind is hash(text).  A unit whose keeper is
    in the same text has the keeper's number + 1 in its upper 32 bits."""
    rows = texts(docs).withColumn("kind", F.hash("text"))
    ids = stage(rows.select("doc_id", "kind", F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    groups = stage(ids.groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "kind")).alias("one"))
        .where("n > 1").select("sha", "one"), "copies")
    copies = stage(ids.join(groups.hint("merge"), "sha").where(
        ~F.struct("doc_id", "kind").eqNullSafe(F.col("one"))).select("doc_id", "kind").distinct(), "skipped")
    search = _listed(rows, copies.withColumn("skip", F.lit(True)), copies.count(), "left") \
        .where("skip is null").select("doc_id", "kind", "text")

    def named(frames):
        for frame in frames:
            if not len(frame):
                continue
            own = Paragraphs.of(frame["text"].tolist())
            bits, grams = bit_maps(own)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "kind": frame["kind"],
                                "names": [p.names() for p in own], "bits": bits, "grams": grams})

    id_type = rows.schema["doc_id"].dataType.simpleString()
    listed = stage(map_frames(search, named, f"doc_id {id_type}, kind int, names array<long>, "
                              "bits array<long>, grams array<long>")
                   .dropDuplicates(["doc_id", "kind"]), "paragraphs")
    places = listed.select("doc_id", "kind", "bits", "grams",
                           F.posexplode("names").alias("unit", "name")).select(
        "name", "doc_id", F.shiftleft(F.col("kind").cast("long"), 32).bitwiseOR(
            F.col("unit").cast("long")).alias("place"),
        F.col("bits")[F.col("unit")].alias("bits"), F.col("grams")[F.col("unit")].alias("grams"))
    links = stage(link_paragraphs(search, places), "links")
    parts = stage(connected_components(links), "components")
    known = places.groupBy("name").agg(F.count(F.lit(1)).alias("n"),
                                       F.min(F.struct("doc_id", "place")).alias("first"))
    known = known.join(parts, F.col("name") == F.col("node"), "left").where(
        "n > 1 or component is not null").select(
        "name", "n", "first", F.coalesce("component", "name").alias("component"))
    known = stage(known, "repeated")
    first = stage(known.groupBy("component").agg(F.min("first").alias("keep")), "firsts")
    known = stage(known.join(first.hint("merge"), "component").select("name", "keep"), "keepers")
    again = places.join(known.hint("merge"), "name").where(
        ~F.struct("doc_id", "place").eqNullSafe(F.col("keep")))
    kind = F.shiftright("place", 32).cast("int")
    low = F.lit(0xFFFFFFFF)
    at_home = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (
        kind == F.shiftright("keep.place", 32).cast("int"))
    unit = F.col("place").bitwiseAND(low).bitwiseOR(F.when(at_home, F.shiftleft(
        F.col("keep.place").bitwiseAND(low) + 1, 32)).otherwise(F.lit(0)))
    units = again.groupBy("doc_id", kind.alias("kind")).agg(F.collect_list(unit).alias("units"))
    lists = stage(units.unionByName(copies.withColumn("units", F.array(F.lit(-1).cast("long")))),
                  "repeats")
    drop_stage(listed)
    return lists, lists.agg(F.coalesce(F.sum(F.size("units")), F.lit(0))).first()[0]


def repeated_units(own: Paragraphs, units) -> list[int]:
    """Units as ``repeats`` lists them, without those that overlap their keeper."""
    pairs = [(int(u) & 0xFFFFFFFF, int(u) >> 32) for u in units]
    return [u for u, keeper in pairs if not keeper or not own.overlap(u, keeper - 1)]


def removed_spans(own: Paragraphs, units, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Byte spans of runs of repeated paragraphs with enough words.

    Pieces too short to be a paragraph, less than ``MERGED`` words in all, go
    along when repeats stand on both sides.  A text whose words are all in the
    run goes whatever its length.
    """
    if len(units) and min(units) < 0:
        return [(0, own.size)] if own.size else []
    repeated = np.zeros(len(own.pieces), bool)
    for u in units:
        a, b, *_ = own.units[u]
        repeated[a:b + 1] = True
    spans, run, gap = [], [], 0

    def close():
        while run and not repeated[run[-1]]:
            run.pop()
        words = sum(own.pieces[i][3] - own.pieces[i][2] for i in run)
        if run and (words >= run_words or words == own.n_words):
            spans.append((own.pieces[run[0]][0], own.pieces[run[-1]][1]))
        run.clear()

    for i, (_, _, a, b) in enumerate(own.pieces):
        gap = 0 if repeated[i] else gap + b - a
        if repeated[i] or (run and b - a < SHINGLE and gap < MERGED):
            run.append(i)
        else:
            close()
    close()
    return spans


def paragraph_dedup(docs: DataFrame, run_words: int = RUN_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_paragraphs, n_repeated),
    one row per document; ``with_text`` adds kept (the text that stays) and spans."""
    session(docs)
    lists, entries = repeats(docs)
    rows = texts(docs).withColumn("kind", F.hash("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            out, every = [], Paragraphs.of(frame["text"].tolist(), hashes=False)
            for doc_id, text, units, own in zip(frame["doc_id"], frame["text"], frame["units"], every):
                data, spans = text.encode(), []
                if units is not None and len(units):
                    units = units if min(units) < 0 else repeated_units(own, units)
                    spans = removed_spans(own, units, run_words)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join(kept) + data[at:]
                several = 0 if units is None else (
                    len(own.units) if len(units) and min(units) < 0 else len(units))
                out.append((doc_id, len(data), len(data) - len(kept), len(spans),
                            hashlib.sha256(kept).hexdigest(), len(own.units), several,
                            kept.decode(), [{"a": a, "b": b} for a, b in spans]))
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_paragraphs",
                       "n_repeated", "kept", "spans"]
            frame = pd.DataFrame(out, columns=columns)
            yield frame if with_text else frame[columns[:7]]

    schema = (f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "n_paragraphs long, n_repeated long"
              + ", kept string, spans array<struct<a:long,b:long>>" * with_text)
    return map_frames(_listed(rows, lists, entries, "left").select("doc_id", "text", "units"), run, schema)
