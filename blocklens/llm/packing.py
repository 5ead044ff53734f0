"""Best-fit packing of token sequences by bin completion.

Documents are encoded, closed by the end id and cut at the sequence length;
the pieces' lengths are all that packing needs, and there are at most
``capacity`` different ones.  So the corpus is packed through its length
histogram: Spark counts lengths, the driver solves the histogram (a few
thousand numbers whatever the corpus), and Spark deals the pieces, ranked
within their length, to the places of the solution.

The solver is bin completion with branch and bound.  A node takes the largest
length left and enumerates the undominated fillings of the room beside it,
least waste first; a filling is applied as often as the counts allow.  A branch
is pruned when its waste exceeds what an improvement on the incumbent may
waste.  The incumbent starts as best-fit decreasing, and the search ends at the
lower bound or after a stated number of nodes.

Defined results: null text counts as empty (a piece of the end id alone);
repeated rows are packed each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import map_frames, own_caches, session, stage, texts

CAPACITY = 2048
END_ID = 0
#: nodes that the search may open beside those of its first dive
NODES = 2000
#: fillings looked at and kept for one node
FILLINGS_SEEN, FILLINGS_KEPT = 400, 6
#: what a worker's cache of chunks may hold, and what an entry takes beside its bytes
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: pieces of one length that one task ranks
RANKED_ROWS = 50_000

Pattern = tuple[tuple[int, ...], int]      # lengths in one sequence, number of such sequences


# --- the solver -----------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of bins: the best over all splits into large and small."""
    total = sum(n * c for n, c in counts.items())
    best = math.ceil(total / capacity)
    lengths = sorted(counts)
    for small in [0, *[n for n in lengths if n <= capacity // 2]]:
        alone = sum(counts[n] for n in lengths if n > capacity - small)
        pair = [n for n in lengths if capacity // 2 < n <= capacity - small]
        middle = sum(counts[n] * n for n in lengths if small <= n <= capacity // 2)
        room = sum(counts[n] * (capacity - n) for n in pair)
        best = max(best, alone + sum(counts[n] for n in pair)
                   + max(0, math.ceil((middle - room) / capacity)))
    return best


def _take(counts: dict[int, int], bin_: tuple[int, ...]) -> int:
    """Apply ``bin_`` as often as the counts allow; returns how often."""
    need = {n: bin_.count(n) for n in set(bin_)}
    times = min(counts[n] // k for n, k in need.items())
    for n, k in need.items():
        counts[n] -= k * times
        if not counts[n]:
            del counts[n]
    return times


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: the fullest open bin that still fits."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                filled = (length,) * (capacity // length)
                times, rest = divmod(left, len(filled))
                for bin_, k in ((filled, times), ((length,) * rest, 1 if rest else 0)):
                    if k:
                        own = open_bins.setdefault(capacity - sum(bin_), {})
                        own[bin_] = own.get(bin_, 0) + k
                break
            bin_, k = next(iter(open_bins[room].items()))
            each = min(room // length, left)
            times = min(k, left // each)
            own = open_bins[room]
            own[bin_] = k - times
            if not own[bin_]:
                del own[bin_]
            if not own:
                del open_bins[room]
            grown = open_bins.setdefault(room - each * length, {})
            made = bin_ + (length,) * each
            grown[made] = grown.get(made, 0) + times
            left -= each * times
    return [(b, k) for own in open_bins.values() for b, k in own.items()]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into bins of the sizes ``a``."""
    if not b:
        return True
    tried = set()
    for i, room in enumerate(a):
        if room >= b[0] and room not in tried:
            tried.add(room)
            rest = tuple(sorted(a[:i] + a[i + 1:] + (room - b[0],), reverse=True))
            if _dominates(rest, b[1:]):
                return True
    return False


def fillings(counts: dict[int, int], largest: int, capacity: int) -> list[tuple[int, ...]]:
    """Undominated fillings beside ``largest``, least waste first."""
    room = capacity - largest
    left = dict(counts)
    left[largest] -= 1
    lengths = sorted((n for n, c in left.items() if c and n <= room), reverse=True)
    if not lengths:
        return [()]
    if lengths[0] == room:
        return [(room,)]        # one item that fills the room dominates all else
    negative = [-n for n in lengths]        # ascending, for bisection
    found: list[tuple[int, ...]] = []
    seen = 0

    def extend(chosen: tuple[int, ...], start: int, free: int) -> bool:
        """Depth first, longest first; False once enough were seen."""
        nonlocal seen
        grew, fits = False, bisect_left(negative, -free)
        for i in range(max(start, fits), len(lengths)):
            n = lengths[i]
            if chosen.count(n) >= left[n]:
                continue
            grew = True
            if not extend(chosen + (n,), i, free - n):
                return False
        if not grew and not any(chosen.count(n) < left[n] for n in lengths[fits:start]):
            seen += 1
            found.append(chosen)
            if free == 0 and len(chosen) <= 2:
                return False
        return seen < FILLINGS_SEEN

    extend((), 0, room)
    found.sort(key=lambda f: (room - sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if len(f) > 6 or not any(len(k) <= 6 and _dominates(k, f) for k in kept):
            kept.append(f)
            if len(kept) == FILLINGS_KEPT:
                break
    return kept


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that use every length as often as it is counted."""
    counts = {n: c for n, c in counts.items() if c}
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    bins = sum(k for _, k in incumbent)
    total = sum(n * c for n, c in counts.items())
    opened, most = 0, nodes + 2 * len(counts)       # one dive takes a node a pattern
    # depth first: (counts left, patterns so far, waste so far, fillings still to try)
    path: list[tuple[dict[int, int], int, list[tuple[int, ...]]]] = []
    used: list[Pattern] = []
    state, waste = dict(counts), 0
    while bins > bound and opened < most:
        allowed = (bins - 1) * capacity - total      # an improvement may waste no more
        if not state:
            incumbent, bins = list(used), sum(k for _, k in used)
        elif waste <= allowed:
            opened += 1
            choices = fillings(state, max(state), capacity)
            path.append((state, waste, choices[::-1]))
        while path and not path[-1][2]:
            path.pop()
        if not path or bins <= bound:
            break
        before, so_far, choices = path[-1]
        del used[len(path) - 1:]
        bin_ = (max(before), *choices.pop())
        state = dict(before)
        times = _take(state, bin_)
        used.append((bin_, times))
        waste = so_far + times * (capacity - sum(bin_))
    return incumbent


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, copies in a sequence):
    a piece of ``length`` with rank r in the interval has its place in sequence
    ``first sequence + (r - first rank) div copies``."""
    out, next_rank, sequence = [], {}, 0
    for bin_, times in patterns:
        offset = 0
        for n in sorted(set(bin_), reverse=True):
            copies = bin_.count(n)
            at = next_rank.get(n, 0)
            out.append((n, at, at + copies * times, sequence, offset, copies))
            next_rank[n] = at + copies * times
            offset += copies * n
        sequence += times
    return out


# --- pieces and their places ------------------------------------------------------


def _encoder(file_text: str):
    """text -> little-endian 32-bit ids, by the library's own steps and a cache.

    White space separates tokens, so chunks are encoded one by one: normalised,
    cut into words and merged by the library.  A plain word with marks behind
    it is two chunks to the cache, and case in ASCII is folded beforehand where
    it cannot matter (the library folds it too, after composing characters).
    """
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(file_text)
    library.no_truncation()
    library.no_padding()
    shape, cut, merge = library.normalizer, library.pre_tokenizer, library.model
    special = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
    cache: dict[bytes, bytes] = {}
    held = 0

    def pack(ids) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def plain(word: bytes) -> bytes:
        """A chunk without special tokens."""
        if word.isalpha():      # ASCII letters, which stand for themselves
            return pack([t.id for t in merge.tokenize(word.lower().decode())])
        pieces = cut.pre_tokenize_str(shape.normalize_str(word.decode()))
        return pack([t.id for w, _ in pieces for t in merge.tokenize(w)])

    def known(chunk: bytes) -> bytes:
        got = cache.get(chunk)
        if got is None:
            got = plain(chunk)
            if len(chunk) <= 64:
                nonlocal held
                held += ENTRY_BYTES + len(chunk) + len(got)
                if held > CACHE_BYTES:
                    cache.clear()
                    held = ENTRY_BYTES + len(chunk) + len(got)
                cache[chunk] = got
        return got

    def miss(chunk: bytes) -> bytes:
        word = chunk.rstrip(b".,;:!?")
        if word and word != chunk and word.isalpha() and word.islower():
            return known(word) + known(chunk[len(word):])
        return known(chunk)

    def encode(text: str) -> bytes:
        data = text.encode()
        if any(s in data for s in special):
            return pack(library.encode(text, add_special_tokens=False).ids)
        try:        # no combining characters: folding before composing is the same
            text.encode("latin-1")
            data = data.lower()
        except UnicodeEncodeError:
            pass
        chunks = data.split()
        return b"".join([cache.get(c) or miss(c) for c in chunks])
    return encode


_ENCODERS: dict[int, object] = {}


def encoder(file_text: str):
    """One encoder per worker and file, with its cache."""
    own_caches("packing", _ENCODERS.clear)
    key = zlib.crc32(file_text.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = _encoder(file_text)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut at the capacity."""
    session(docs)
    file_text = open(tokenizer_path, encoding="utf-8").read()
    end = end_id.to_bytes(4, "little")

    def run(frames):
        encode = encoder(file_text)
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(
        rows, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         nodes: int = NODES) -> DataFrame:
    """The pieces with sequence_id and offset, one row per piece."""
    spark = session(docs)
    cut = stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    # one row per length: at most ``capacity`` rows reach the driver
    histogram = {r["length"]: r["n"] for r in
                 cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = places(solve(histogram, capacity, nodes))
    salts = max(64, sum(histogram.values()) // RANKED_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    per = stage(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "per-salt")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1)
    base = stage(per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0))
                            .alias("base")), "bases")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(
        base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    # at most (lengths x different lengths in a sequence) rows: broadcast within that bound
    table = F.broadcast(spark.createDataFrame(
        dealt, "of long, low long, high long, sequence long, at long, copies long"))
    hit = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (
        F.col("rank") < F.col("high"))
    turn = F.col("rank") - F.col("low")
    return ranked.join(table, hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(rank - low) div copies")).alias("sequence_id"),
        (F.col("at") + turn % F.col("copies") * F.col("length")).alias("offset"))
