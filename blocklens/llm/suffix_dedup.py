"""Suffix dedup: bytes covered by a 200-byte string that starts twice go.

External induced sorting, laid out for Spark:

1. *Sampled suffixes.*  Each window of ``LENGTH`` bytes elects the smallest of
   its ``GRAM``-byte substrings (by hash); the elected positions are the
   sampled suffixes.  Equal windows elect the same place, so a window that
   starts twice has a sampled suffix whose gram stands elsewhere too.  Grams
   that stand once end here, and with them most of the text.
2. *Names.*  A sampled suffix whose whole reach (all windows that elect it)
   stands elsewhere is settled by that name alone.
3. *Sorting.*  The rest are suffix tuples (gram, text behind it).  Spark's
   external sort, which spills sorted runs to disk and merges them through a
   priority queue, puts them in suffix order, each with the length of the
   prefix that it shares with its neighbour.
4. *Induction.*  The order of the suffixes that start one byte earlier follows
   from that of the sampled ones: tuples are ordered by the byte before, ties
   keep their order, and a common prefix is one longer than the least on the
   way between the two.  The step repeats to the start of the earliest window;
   a window stands twice where a neighbour's common prefix reaches ``LENGTH``.

Suffixes longer than ``LENGTH`` bytes never matter, so the recursion of the
general algorithm ends after one level.  Equal texts are settled beforehand:
all but one representative leave the search, so a group of copies is one text.
A gram that stands in more than ``HOT`` unsettled places is not sorted in one
task.  What all places of such a group have in common before and behind the gram
follows from the least and the greatest context; the windows within it stand
twice, as one range a place.  The other windows have more bytes before the gram
or more behind it than all have in common, so the tuples are dealt by the gram
with the one and by the gram with the other, and again until groups are small.
Names of reaches and groups have 128 bits.

Defined results: null text counts as empty; texts below ``LENGTH`` bytes stay
whole; rows equal in text are copies of one another, whatever their doc_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import BROADCAST_IDS, drop_stage, map_frames, own_caches, session, stage, texts

LENGTH = 200
GRAM = 100
#: unsettled places of a gram up to which one task sorts them
HOT = 1024
#: window starts worked on at once
CHUNK = 1 << 20
#: lists by text are broadcast up to this many entries (about 50 bytes each)
BROADCAST_ENTRIES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the rolling hash's base and of its inverse modulo 2**64."""

    def __init__(self, n: int):
        self.up = _powers(_BASE, n)
        self.down = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n)


_TABLES: list[_Tables] = []


def _tables(n: int) -> _Tables:
    """At least ``n`` powers; as many as the longest texts of the worker's tasks need."""
    own_caches("suffix_dedup", _TABLES.clear)
    if not _TABLES or len(_TABLES[0].up) < n:
        _TABLES[:] = [_Tables(max(n, min(CHUNK + 4096, max(1 << 14, 1 << n.bit_length()))))]
    return _TABLES[0]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of every ``gram``-byte substring."""
    t = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * t.up[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * t.down[:len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` successive values (two running minima a block)."""
    n = len(values) - width + 1
    pad = -len(values) % width
    block = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def elected(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): sampled positions, and the starts of the first
    and last window that elect each."""
    size = len(data)
    out = []
    width = length - gram + 1
    for at in range(0, max(0, size - length + 1), CHUNK):
        part = np.frombuffer(data, np.uint8, offset=at, count=min(CHUNK + length - 1, size - at))
        h = gram_hashes(part, gram)
        low = np.uint64(0xFFFFFFFF)
        tagged = (h & ~low) | np.arange(len(h), dtype=np.uint64)      # ties: leftmost
        best = (_window_minima(tagged, width) & low).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        last = np.concatenate((edge[1:], [len(best)])) - 1
        out.append((best[edge] + at, edge + at, last + at))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _sampled(length: int, gram: int):
    """Texts -> their sampled suffixes: gram name, name of the whole reach, place."""
    from xxhash import xxh3_64_intdigest as name
    from xxhash import xxh3_128_digest as digest

    def run(frames):
        for frame in frames:
            names, reaches, others, places = [], [], [], []
            for text in frame["text"]:
                data = text.encode()
                at, first, last = elected(data, length, gram)
                n = len(at)
                names.append(np.fromiter((name(data[p:p + gram]) for p in at.tolist()), np.uint64, n)
                             .view(np.int64))
                both = np.frombuffer(b"".join(
                    [digest(data[a:b + length], b - a) for a, b in zip(first.tolist(), last.tolist())]),
                    "<i8").reshape(n, 2)
                reaches.append(both[:, 0])
                others.append(both[:, 1])
                places.append((at << 16) | ((at - first) << 8) | (at - last))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "kind": frame["kind"], "name": names,
                                "reach": reaches, "other": others, "place": places})
    return run


#: a suffix tuple: its group (a digest of the gram and of the bytes before and
#: behind it that all of the group have), how many those are, and its text
_TUPLE = ["key", "left", "right", "num", "place", "before", "behind"]
_TUPLE_SCHEMA = ("key binary, left int, right int, num long, place long, before binary, behind binary")


def _contexts(length: int, gram: int):
    """Texts with listed places -> the bytes before and behind each gram."""
    from xxhash import xxh3_128_digest as digest

    def run(frames):
        for frame in frames:
            rows = []
            for text, num, places in zip(frame["text"], frame["num"], frame["places"]):
                data = text.encode()
                for p in places:
                    place = int(p["place"])
                    at, back, least = place >> 16, place >> 8 & 0xFF, place & 0xFF
                    rows.append((digest(data[at:at + gram]), 0, 0, num, place, data[at - back:at],
                                 data[at + gram:at - least + length]))
            yield pd.DataFrame(rows, columns=_TUPLE)
    return run


def _common_prefix(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shared prefix of each row with the one above (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def induce(before: list[bytes], behind: list[bytes], back: np.ndarray, least: np.ndarray,
           group: np.ndarray, need: int) -> list[tuple[int, int]]:
    """(row, steps back) of every window that stands twice.

    Rows are suffix tuples in the order of (group, text behind).  ``need`` is
    how many bytes a window has besides its gram.
    """
    n = len(behind)
    sizes = np.array([len(b) for b in behind])
    width = max(1, int(sizes.max(initial=0)))
    rows = np.frombuffer(b"".join([b.ljust(width, b"\0") for b in behind]), np.uint8).reshape(n, width)
    shared = _common_prefix(rows, sizes)
    shared[np.concatenate(([True], group[1:] != group[:-1]))] = -1      # -1: another class
    reach = max(1, int(back.max(initial=0)))
    left = np.frombuffer(b"".join([b[::-1].ljust(reach, b"\0") for b in before]),
                         np.uint8).reshape(n, reach)
    order, found = np.arange(n), []
    for step in range(reach + 1):
        # here: tuples in the order of the suffixes that start ``step`` before their grams
        near = np.maximum(shared, np.concatenate((shared[1:], [-1])))
        twice = (near >= need - step) & (back[order] >= step) & (least[order] <= step)
        found.append((order[twice], np.full(twice.sum(), step)))
        # one byte earlier: by class and byte before, ties in order
        stay = back[order] > step
        kind = np.cumsum(shared < 0)
        # a tuple that leaves passes its shared prefix on to the next of its class
        kept = np.flatnonzero(stay)
        if len(kept) < 2:
            break
        key = kind[kept] * 256 + left[order[kept], step]
        turn = np.argsort(key, kind="stable")
        at, key = kept[turn], key[turn]
        same = key[1:] == key[:-1]
        new = np.full(len(at), -1)
        if same.any():
            ends = np.stack((at[:-1][same] + 1, at[1:][same] + 1), axis=1).ravel()
            padded = np.append(shared, np.iinfo(np.int64).max)
            new[1:][same] = np.minimum.reduceat(padded, ends)[::2]
        # classes of one tuple can share nothing with any other
        alone = (new < 0) & np.concatenate((new[1:] < 0, [True]))
        order, shared = order[at][~alone], new[~alone]
        if not len(order):
            break
    return [np.concatenate(x) for x in zip(*found)]


def _sorted_runs(length: int, gram: int):
    """Frames of suffix tuples in order -> window starts that stand twice."""
    need = length - gram

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        place = frame["place"].to_numpy(np.int64)
        at, back, least = place >> 16, place >> 8 & 0xFF, place & 0xFF
        key = frame["key"].to_numpy()
        row, step = induce(frame["before"].tolist(), frame["behind"].tolist(), back, least,
                           np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))), need)
        return pd.DataFrame({"num": frame["num"].to_numpy()[row], "start": at[row] - step})

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            if not len(held):
                continue
            key = held["key"].to_numpy()
            cut = int((key == key[-1]).argmax())        # the last group may go on
            if cut:
                yield of(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield of(held)
    return run


def _narrowed(need: int):
    """Suffix tuples of crowded groups -> the same under finer keys.

    Windows start between ``left`` and ``need`` - ``right`` bytes before their
    grams; all of a group have ``l`` bytes before the gram and ``r`` behind it
    in common.  Windows within that are settled; those that start earlier go
    under a key with one byte more before the gram, those that start later
    under one with a byte more behind it.  If no window lies within, the earlier
    and the later half of them part.
    """
    from xxhash import xxh3_128_digest as digest

    def run(frames):
        for frame in frames:
            rows = []
            for key, left, right, num, place, before, behind, l, r in frame[
                    _TUPLE + ["l", "r"]].itertuples(index=False):
                back, least = place >> 8 & 0xFF, place & 0xFF
                low, high = max(least, left), min(back, need - right)
                if need - r <= l:
                    upper, more = l + 1, r + 1
                else:
                    upper = left + (need - left - right + 1) // 2
                    more = need - upper + 1
                if high >= upper:
                    rows.append((digest(key + b"<" + before[len(before) - upper:]), upper, right,
                                 num, place, before, behind))
                if low <= need - more:
                    rows.append((digest(key + b">" + behind[:more]), left, more,
                                 num, place, before, behind))
            yield pd.DataFrame(rows, columns=_TUPLE)
    return run


def _common(a: Column, b: Column) -> Column:
    """Bytes that two hexadecimal strings share at their beginnings."""
    upto = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    same = F.filter(upto, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.floor(F.array_max(same) / 2).cast("int")


def crowded_groups(around: DataFrame, hot: int) -> DataFrame:
    """(key, l, r) of groups with more than ``hot`` tuples: the bytes that all
    have in common before and behind the gram (what the least and the greatest
    of some strings share, all share)."""
    before, behind = F.reverse(F.hex("before")), F.hex("behind")
    sizes = around.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(before).alias("b0"), F.max(before).alias("b1"),
        F.min(behind).alias("a0"), F.max(behind).alias("a1")).where(F.col("n") > hot)
    return sizes.select("key", _common(F.col("b0"), F.col("b1")).alias("l"),
                        _common(F.col("a0"), F.col("a1")).alias("r"))


def _listed(docs: DataFrame, lists: DataFrame, entries: int, how: str,
            kind: str = "kind") -> DataFrame:
    """Texts with their row of ``lists`` (doc_id, kind, ...); the lists are
    broadcast while they hold few entries, else Spark shuffles both sides."""
    lists = lists.withColumnsRenamed({"doc_id": "_id", "kind": "_kind"})
    if entries <= BROADCAST_ENTRIES and lists.count() <= BROADCAST_IDS:
        lists = F.broadcast(lists)
    on = docs["doc_id"].eqNullSafe(lists["_id"]) & (docs[kind] == lists["_kind"])
    return docs.join(lists, on, how).drop("_id", "_kind")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                    hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kind, num) of the texts searched and (num, first, last): ranges
    of starts whose ``length`` bytes stand twice among the texts.

    ``docs`` is (doc_id, kind, text).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sampled = map_frames(
        docs, _sampled(length, gram),
        f"doc_id {id_type}, kind long, name array<long>, reach array<long>, other array<long>, "
        "place array<long>")
    sampled = stage(sampled.withColumn("num", F.monotonically_increasing_id()), "sampled")
    places = sampled.select("num", F.explode(F.arrays_zip("name", "reach", "other", "place")).alias("s")) \
        .select("num", "s.name", "s.reach", "s.other", "s.place")
    twice = stage(places.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select("name"), "grams")
    texts_of = stage(sampled.select("doc_id", "kind", "num"), "searched")
    shared = stage(places.join(twice.hint("merge"), "name"), "shared")
    drop_stage(sampled)
    # distinct reaches of each gram: one place stands for all with the same bytes
    reaches = stage(shared.groupBy("name", "reach", "other").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("num", "place")).alias("one")), "reaches")
    settled = shared.join(reaches.where("n > 1").select("name", "reach", "other").hint("merge"),
                          ["name", "reach", "other"])
    several = stage(reaches.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1"), "several")
    at = F.shiftright("place", 16)
    settled = stage(settled.select(
        "num", (at - F.shiftright("place", 8).bitwiseAND(F.lit(0xFF))).alias("first"),
        (at - F.col("place").bitwiseAND(F.lit(0xFF))).alias("last")), "settled")
    # suffix tuples: one place of each reach, where a gram has several
    tuples = reaches.join(several.select("name").hint("merge"), "name").select(
        "name", "one.num", "one.place")
    listed = stage(tuples.groupBy("num").agg(
        F.collect_list(F.struct("name", "place")).alias("places")).join(texts_of, "num"), "tuples")
    entries = listed.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    around = stage(_listed(docs, listed, entries, "inner").select("text", "num", "places").mapInPandas(
        _contexts(length, gram), _TUPLE_SCHEMA), "contexts")
    for table in (shared, reaches):
        drop_stage(table)
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    need, ranges = length - gram, [settled]
    while True:     # every turn leaves each crowded group fewer windows
        many = stage(crowded_groups(around, hot), "hot-groups")
        crowded = many.count() > 0
        cool = around.join(many.hint("merge"), "key", "left_anti") if crowded else around
        found = cool.repartition(parts, "key").sortWithinPartitions("key", "behind").mapInPandas(
            _sorted_runs(length, gram), "num long, start long")
        ranges.append(stage(found.select(
            "num", F.col("start").alias("first"), F.col("start").alias("last")), "starts"))
        if not crowded:
            break
        rest = stage(around.join(many.hint("merge"), "key"), "hot-rows")
        at, back, least = (F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(0xFF)),
                           F.col("place").bitwiseAND(F.lit(0xFF)))
        low = F.greatest(least, F.col("left"), need - F.col("r"))
        high = F.least(back, need - F.col("right"), F.col("l"))
        ranges.append(rest.where(low <= high).select("num", (at - high).alias("first"), (at - low).alias("last")))
        old, around = around, stage(rest.mapInPandas(_narrowed(need), _TUPLE_SCHEMA), "narrowed")
        drop_stage(old)
    out = ranges[0]
    for more in ranges[1:]:
        out = out.unionByName(more)
    return texts_of, out


def spans_of(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows that start in the ranges."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    edge = np.flatnonzero(new)
    return list(zip(begin[edge].tolist(), end[np.append(edge[1:], len(end)) - 1].tolist()))


def _merged(length: int):
    """Starts and ends of ranges -> those of the maximal runs of removed bytes."""
    def run(frames):
        for frame in frames:
            spans = [spans_of(a, b, length) for a, b in zip(frame["first"], frame["last"])]
            frame["first"] = [[a for a, _ in own] for own in spans]
            frame["last"] = [[b - length for _, b in own] for own in spans]
            yield frame
    return run


def _without(text: str, ranges, length: int) -> tuple[bytes, list[tuple[int, int]], int]:
    """(bytes left, removed spans, bytes there were)."""
    data = text.encode()
    if ranges is None or not len(ranges):
        return data, [], len(data)
    spans = spans_of(np.array([r["first"] for r in ranges]), np.array([r["last"] for r in ranges]),
                     length)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), spans, len(data)


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
             hot: int = HOT) -> tuple[DataFrame, int]:
    """(doc_id, kind, ranges) of all texts that lose bytes, and the number of
    ranges; kind is xxhash64(text)."""
    rows = texts(docs).withColumn("kind", F.xxhash64("text"))
    ids = stage(rows.select("doc_id", "kind", F.octet_length("text").alias("n_bytes"),
                            F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    groups = stage(ids.where(F.col("n_bytes") >= length).groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "kind")).alias("one"))
        .where("n > 1").select("sha", "one"), "copies")
    copies = stage(ids.join(groups.hint("merge"), "sha").select("doc_id", "kind", "n_bytes", "one"),
                   "copy-rows")
    # copies are wholly repeated; one of each group stays in the search for the others' sake
    skip = copies.where(~F.struct("doc_id", "kind").eqNullSafe(F.col("one"))).select(
        "doc_id", "kind").distinct()
    skip = stage(skip, "skipped").withColumn("skip", F.lit(True))
    search = _listed(rows.where(F.octet_length("text") >= length), skip, skip.count(), "left") \
        .where("skip is null").select("doc_id", "kind", "text")
    texts_of, ranges = repeated_starts(search, length, gram, hot)
    found = ranges.groupBy("num").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    found = map_frames(found.join(texts_of, "num").select(
        "doc_id", "kind", F.transform("ranges", lambda r: r["first"]).alias("first"),
        F.transform("ranges", lambda r: r["last"]).alias("last")),
        _merged(length), "doc_id {}, kind long, first array<long>, last array<long>".format(
            rows.schema["doc_id"].dataType.simpleString()))
    found = found.select("doc_id", "kind", F.arrays_zip("first", "last").alias("ranges"))
    whole = copies.select("doc_id", "kind", F.array(F.struct(
        F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - length).cast("long")
        .alias("last"))).alias("ranges")).distinct()
    lists = found.unionByName(whole).groupBy("doc_id", "kind").agg(
        F.flatten(F.collect_list("ranges")).alias("ranges"))
    lists = stage(lists, "ranges")
    return lists, lists.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                 with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document;
    ``with_bytes`` adds kept (binary) and spans."""
    session(docs)
    lists, entries = removals(docs, length, gram, hot)
    rows = texts(docs).withColumn("kind", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            got = [_without(t, r, length) for t, r in zip(frame["text"], frame["ranges"])]
            out = pd.DataFrame({
                "doc_id": frame["doc_id"], "n_bytes": [g[2] for g in got],
                "n_removed": [g[2] - len(g[0]) for g in got], "n_spans": [len(g[1]) for g in got],
                "kept_sha256": [hashlib.sha256(g[0]).hexdigest() for g in got]})
            if with_bytes:
                out["kept"] = [g[0] for g in got]
                out["spans"] = [[{"a": a, "b": b} for a, b in g[1]] for g in got]
            yield out

    schema = (f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
              + ", kept binary, spans array<struct<a:long,b:long>>" * with_bytes)
    return map_frames(_listed(rows, lists, entries, "left").select("doc_id", "text", "ranges"),
                      run, schema)


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated bytes cut out of text, all columns; texts that
    lose their last word go, and characters cut in two go with their bytes."""
    session(docs)
    lists, entries = removals(docs, length, gram)

    @F.pandas_udf("string")
    def cut(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([_without(t, r, length)[0].decode("utf-8", "ignore")
                          for t, r in zip(text, ranges)])

    rows = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    lists = lists.withColumnRenamed("ranges", "_ranges")
    rows = _listed(rows, lists, entries, "left", "_hash")
    rows = rows.withColumn("_cut", F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(
        cut(F.coalesce("text", F.lit("")), "_ranges")))
    rows = rows.where(F.col("_ranges").isNull() | F.col("_cut").rlike(r"[^\x20\x09-\x0D]"))
    out = [F.col("_cut").alias("text") if c == "text"
           else F.when(F.col("_ranges").isNull(), F.col(c)).otherwise(
               F.char_length("_cut").cast("long")).alias(c) if c == "n_chars" else F.col(c)
           for c in docs.columns]
    return rows.select(*out)
