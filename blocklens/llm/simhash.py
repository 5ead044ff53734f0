"""SimHash near-dedup with a pigeonring filter.

A text's words (lower-cased A-Z, split at ASCII white space) form 3-word
shingles; bit b of the fingerprint is set where over half of the shingles'
XXH64 hashes have it set.  Fingerprints link at ``MAX_BITS`` or fewer
differing bits.

The 64 bits are a ring of eight 8-bit boxes.  By the pigeonring principle a
pair within 3 bits has a box from which every chain of L consecutive boxes
differs in at most floor(3 L / 8) bits: 0, 0, 1, 1, 1, 2, 2, 3.  So two boxes
are equal, and of the 24 bits that follow one half of 12 is equal too: every
fingerprint goes to 8 starts x 2 halves under a 28-bit key, and only pairs
that share a key are looked at.  Pairs are pruned by the rest of the chain
budgets before the whole distance is taken.

Equal fingerprints are one class before any of this.  A key that holds more
than ``BUCKET`` classes is split again by nine more bits (three differing bits
cannot touch all four quarters of the rest), so no bucket meets one task whole.
A bucket sends on a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; texts without words have
fingerprint zero and link like any other; rows that share a doc_id are judged
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import connected_components, keep_rows, map_frames, session, stage, texts

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: classes of a key from which the key is split further
BUCKET = 4096
#: runs of up to this length are compared pairwise at once
SMALL_RUN = 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    join = b" ".join
    shifted = [words[i:] for i in range(shingle)]
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(join(s), SEED) for s in zip(*shifted)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    session(docs)

    def run(frames):
        for frame in frames:
            fp = np.fromiter((fingerprint(t, shingle) for t in frame["text"]), np.uint64, len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": fp.view(np.int64)})

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(rows, run, f"doc_id {kind}, fp long")


def _keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint, each with the bits that it leaves open."""
    out = []
    for start in range(8):
        ring = fp if start == 0 else F.shiftleft(fp, 8 * start).bitwiseOR(
            F.shiftrightunsigned(fp, 64 - 8 * start))
        equal = F.shiftrightunsigned(ring, 48)
        first = F.shiftrightunsigned(ring, 36).bitwiseAND(F.lit(0xFFF))
        second = F.shiftrightunsigned(ring, 24).bitwiseAND(F.lit(0xFFF))
        last = ring.bitwiseAND(F.lit(0xFFFFFF))
        for half, (held, other) in enumerate(((first, second), (second, first))):
            tag = F.lit(2 * start + half).cast("long")
            key = F.shiftleft(F.shiftleft(tag, 16).bitwiseOR(equal), 12).bitwiseOR(held)
            out.append(F.struct(key.alias("key"),
                                F.shiftleft(other, 24).bitwiseOR(last).alias("rest")))
    return F.array(*out)


def _finer(key: Column, rest: Column) -> Column:
    """Four finer keys: each holds another nine of the 36 open bits."""
    return F.array(*[
        F.shiftleft(F.shiftleft(key, 2).bitwiseOR(F.lit(q)), 9).bitwiseOR(
            F.shiftrightunsigned(rest, 9 * q).bitwiseAND(F.lit(0x1FF))) for q in range(4)])


def chain_distance(a: np.ndarray, b: np.ndarray, start: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Hamming distance where the chain budgets from box ``start`` hold, else 65."""
    x = a ^ b
    turn = (start * 8).astype(np.uint64)
    x = np.where(turn == 0, x, (x << turn) | (x >> ((np.uint64(64) - turn) % np.uint64(64))))
    chain = np.bitwise_count(x >> np.uint64(24))
    ok = chain <= 5 * limit // 8            # five boxes
    chain = np.bitwise_count(x >> np.uint64(8))
    ok &= chain <= 7 * limit // 8           # seven boxes
    return np.where(ok, np.bitwise_count(x), 65)


def _forest(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of one run that connect all that is within reach of one another."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[node]) <= limit
            if near.any():
                found = left[near]
                left = left[~near]
                out.extend((node, f) for f in found.tolist())
                queue.extend(found.tolist())
    return out


def _links(limit: int, finer: bool):
    """Frames sorted by key -> links (a, b) within each key's run."""
    shift = 32 - 4 + 11 * finer     # where the tag of start and half begins

    def of(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame | None:
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        found = []
        long = np.repeat(size > SMALL_RUN, size)
        k, f = key[~long], fp[~long]
        at = np.arange(len(k))
        for d in range(1, SMALL_RUN):
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if not len(at):
                break
            start = (k[at] >> shift) // 2
            near = chain_distance(f[at], f[at + d], start, limit) <= limit
            found.append(np.stack([f[at[near]], f[at[near] + d]]))
        for r in np.flatnonzero(size > SMALL_RUN):
            own = fp[edge[r]:edge[r + 1]]
            if pairs := _forest(own, limit):
                found.append(own[np.array(pairs).T])
        if found and (both := np.concatenate(found, axis=1)).size:
            return pd.DataFrame({"a": both[0].view(np.int64), "b": both[1].view(np.int64)})

    def run(frames):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for frame in frames:
            key = np.concatenate((key, frame["key"].to_numpy(np.int64)))
            fp = np.concatenate((fp, frame["fp"].to_numpy(np.int64).view(np.uint64)))
            last = np.searchsorted(key, key[-1]) if len(key) else 0
            if last:        # the last run may go on in the next frame
                if (out := of(key[:last], fp[:last])) is not None:
                    yield out
                key, fp = key[last:], fp[last:]
        if len(key) and (out := of(key, fp)) is not None:
            yield out
    return run


def link_fingerprints(classes: DataFrame, limit: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct ``fp`` within ``limit`` (up to 3) bits."""
    if not 0 <= limit <= 3:
        raise ValueError("the keys hold for distances up to 3")
    keyed = classes.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select(
        "fp", "k.key", "k.rest")

    def linked(rows: DataFrame, finer: bool) -> DataFrame:
        parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return rows.select("key", "fp").repartition(parts, "key").sortWithinPartitions(
            "key").mapInPandas(_links(limit, finer), "a long, b long")

    hot = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > bucket).select("key"), "hot-keys")
    if not hot.count():
        return linked(keyed, False)
    again = keyed.join(F.broadcast(hot) if hot.count() < 100_000 else hot, "key", "left_semi")
    plain = keyed.join(F.broadcast(hot) if hot.count() < 100_000 else hot, "key", "left_anti")
    finer = again.select("fp", F.explode(_finer(F.col("key"), F.col("rest"))).alias("key"))
    return linked(plain, False).union(linked(finer, True))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS,
                    bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, kept), one row per document.

    component_id is the smallest doc_id that links reach; of a component, the
    row with the smallest (doc_id, fp) is kept.
    """
    session(docs)
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = stage(link_fingerprints(classes.select("fp"), limit, bucket).distinct(), "links")
    parts = stage(connected_components(links), "components")
    named = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    named = stage(named, "named")
    least = stage(named.groupBy("component").agg(
        F.min("first").alias("component_id"),
        F.min(F.struct(F.col("first").alias("doc_id"), "fp")).alias("keep")), "least")
    final = stage(named.join(least.hint("merge"), "component").select(
        "fp", "component_id", "keep"), "final")
    return rows.join(final.hint("merge"), "fp").select(
        "doc_id", "fp", "component_id",
        F.struct("doc_id", "fp").eqNullSafe(F.col("keep")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, all columns."""
    found = stage(near_duplicates(docs, shingle, limit), "verdicts")

    def with_key(some: DataFrame) -> DataFrame:
        @F.pandas_udf("long")
        def fp(text: pd.Series) -> pd.Series:
            return pd.Series(np.fromiter((fingerprint(t, shingle) for t in text), np.uint64,
                                         len(text)).view(np.int64))
        return some.withColumn("_key", fp(F.coalesce("text", F.lit(""))))

    return keep_rows(docs, found.select("doc_id", F.col("fp").alias("key"), "kept"), with_key)
