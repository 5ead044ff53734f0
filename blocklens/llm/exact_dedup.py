"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every task cuts its documents into parts, sorts each part's distinct
   fingerprints by owner (a range of the hash space), and sends every owner
   one message: the sorted fingerprints as Rice-coded gaps.
2. An owner decodes the messages of its range, finds the fingerprints that
   occur twice, and answers every part with a bitmap over its message.
3. Only documents whose bit is set are suspects.  Their texts alone are
   shuffled, grouped by content byte for byte, and the largest doc_id stays.

A copy repeated within a part is sent once with its own flag, so a third of
all rows being one text adds one fingerprint a part.

Defined results: null text counts as empty; rows equal in doc_id and text are
copies of one another and one of them stays; null doc_id sorts below any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocklens.llm.common import by_ids, keep_rows, map_frames, session, stage, texts

#: documents of a part: bounds a message and a task's buffer
PART_DOCS = 65_536
#: fingerprints that one owner should receive
OWNER_FINGERPRINTS = 500_000

_PASS = ("part long, owner int, slot int, doc_id long, sha binary, local_copy boolean, row long, "
         "message binary")


def rice_encode(values: np.ndarray, span_bits: int) -> bytes:
    """Sorted unsigned ``values`` below 2**span_bits as Rice-coded gaps.

    Layout: count (4 bytes), Rice parameter (1 byte), then for every gap its
    quotient in unary (ones ended by a zero) and its remainder, bit by bit.
    """
    n = len(values)
    k = max(0, min(span_bits - 1, span_bits - max(n, 1).bit_length()))
    head = n.to_bytes(4, "little") + bytes([k])
    if not n:
        return head
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(quotient + 1 + k)))
    bits = np.zeros(start[-1], np.uint8)
    ones = np.repeat(start[:-1] - np.concatenate(([0], np.cumsum(quotient)[:-1])), quotient)
    bits[ones + np.arange(len(ones))] = 1
    at = start[:-1] + quotient + 1
    for b in range(k):
        bits[at + b] = (gaps >> np.uint64(k - 1 - b)).astype(np.uint8) & 1
    return head + np.packbits(bits).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    """The values that :func:`rice_encode` was given."""
    n, k = int.from_bytes(data[:4], "little"), data[4]
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=5))
    zeros = np.flatnonzero(bits == 0)
    out, at = np.empty(n, np.uint64), 0
    cursor = 0
    starts, quotients = np.empty(n, np.int64), np.empty(n, np.uint64)
    for i in range(n):
        while zeros[cursor] < at:       # zeros inside the last remainder
            cursor += 1
        quotients[i] = zeros[cursor] - at
        at = int(zeros[cursor]) + 1
        starts[i] = at
        at += k
    remainder = np.zeros(n, np.uint64)
    for b in range(k):
        remainder = (remainder << np.uint64(1)) | bits[starts + b].astype(np.uint64)
    np.cumsum((quotients << np.uint64(k)) | remainder, out=out)
    return out


def _messages(owners: int):
    """A task's documents -> their slots and one message for each part and owner."""
    shift = np.uint64(64 - (owners - 1).bit_length()) if owners > 1 else None
    span = int(shift) if owners > 1 else 64

    def part_rows(frame: pd.DataFrame, part: int):
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        distinct, slot, count = np.unique(fp, return_inverse=True, return_counts=True)
        owner = (distinct >> shift).astype(np.int64) if owners > 1 else np.zeros(len(distinct), np.int64)
        first = np.searchsorted(owner, owner)
        yield pd.DataFrame({
            "part": part, "owner": owner[slot].astype(np.int32),
            "slot": (slot - first[slot]).astype(np.int32),
            "doc_id": frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
            "sha": frame["sha"].to_numpy(), "local_copy": count[slot] > 1,
            "row": np.arange(len(frame), dtype=np.int64), "message": None})
        for o in np.unique(owner):
            own = distinct[owner == o]
            low = own & np.uint64((1 << span) - 1) if span < 64 else own
            yield pd.DataFrame({
                "part": [part], "owner": np.array([o], np.int32), "slot": [None], "doc_id": [None],
                "sha": [None], "local_copy": [None], "row": [None],
                "message": [rice_encode(low, span)]})

    def run(batches):
        from pyspark import TaskContext
        held, n, part = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, len(batch), PART_DOCS):
                piece = batch.iloc[at:at + PART_DOCS]
                if n and n + len(piece) > PART_DOCS:
                    yield from part_rows(pd.concat(held, ignore_index=True), part)
                    held, n, part = [], 0, part + 1
                held.append(piece)
                n += len(piece)
        if n:
            yield from part_rows(pd.concat(held, ignore_index=True), part)
    return run


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """One owner's messages -> a bitmap of the shared fingerprints for each."""
    values = [rice_decode(m) for m in frame["message"]]
    distinct, count = np.unique(np.concatenate(values), return_counts=True)
    shared = distinct[count > 1]
    maps = [np.packbits(np.isin(v, shared, assume_unique=True), bitorder="little").tobytes()
            for v in values]
    return pd.DataFrame({"part": frame["part"], "owner": frame["owner"], "bitmap": maps})


def exact_dedup(docs: DataFrame, owners: int | None = None, fingerprint_bits: int = 64,
                key_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, part, row), one row per document.

    ``owners`` defaults to a power of two that gives each about
    ``OWNER_FINGERPRINTS``, so an owner's work does not grow with the corpus.
    Shorter fingerprints or keys (bytes of the digest by which verified groups
    are looked up) only cost time: results never rest on them.
    """
    session(docs)
    rows = texts(docs)
    if owners is None:
        owners = 16 * max(1, -(-rows.count() // (16 * OWNER_FINGERPRINTS)))
    owners = 1 << (owners - 1).bit_length()
    fp = F.shiftleft(F.xxhash64("text"), 64 - fingerprint_bits)
    hashed = rows.select("doc_id", fp.alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"))
    sent = stage(map_frames(hashed, _messages(owners), _PASS), "golomb")
    ids = sent.where("message is null").select("part", "owner", "slot", "doc_id", "sha",
                                               "local_copy", "row")
    answers = stage(sent.where("message is not null").select("part", "owner", "message")
                    .groupBy("owner").applyInPandas(
                        _answer, "part long, owner int, bitmap binary"), "bitmaps")
    byte = F.conv(F.hex(F.expr("substring(bitmap, slot div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, slot % 8)")
    judged = stage(ids.join(answers, ["part", "owner"]).select(
        "doc_id", "sha", "part", "row",
        (F.col("local_copy") | (byte.bitwiseAND(bit) != 0)).alias("suspect")), "judged")

    # byte verification: equal texts meet in one group, pre-aggregated in each task
    def key(sha):
        return F.substring(sha, 1, key_bytes)

    me = F.struct("doc_id", "part", "row")
    asked = judged.where("suspect").withColumn("key", key(F.col("sha")))
    own = by_ids(rows, stage(asked.select("doc_id").distinct(), "ids"), "left_semi")
    contents = (own.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
                .select(key(F.unhex(F.sha2("text", 256))).alias("key"))
                .groupBy("key").agg(F.count(F.lit(1)).alias("contents")))
    clash = stage(contents.where("contents > 1").select("key"), "clash")
    groups = asked.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"),
                                      F.max(me).alias("last"))
    groups = stage(groups.where("group_size > 1").join(clash, "key", "left_anti"), "groups")
    out = judged.where("not suspect").withColumn(
        "group_size", F.lit(None).cast("long")).withColumn("last", F.lit(None).cast(
            T.StructType(groups.schema["last"].dataType.fields)))
    if clash.count():       # one key, several contents: judge those rows by their text
        out = out.unionByName(_by_content(
            asked.join(clash, "key", "left_semi"), own, clash, key).select(out.columns))
        asked = asked.join(clash, "key", "left_anti")
    out = out.unionByName(asked.join(groups.hint("merge"), "key", "left").select(out.columns))
    last = F.coalesce("last", me)
    return out.select(
        "doc_id", last["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (last == me).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "part", "row")


def _by_content(asked: DataFrame, own: DataFrame, clash: DataFrame, key) -> DataFrame:
    """Rows whose key stands for several contents, grouped by the text itself."""
    own = own.withColumn("_sha", F.unhex(F.sha2("text", 256)))
    own = own.join(clash, key(F.col("_sha")) == clash["key"], "left_semi").select(
        F.col("doc_id").alias("_id"), "_sha", "text").distinct()
    both = asked.join(own, asked["doc_id"].eqNullSafe(own["_id"]) & (asked["sha"] == own["_sha"]))
    size = both.groupBy("text").agg(F.count(F.lit(1)).alias("group_size"),
                                    F.max(F.struct("doc_id", "part", "row")).alias("last"))
    return both.join(size, "text")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep, all columns."""
    session(docs)
    found = stage(exact_dedup(docs), "verdicts")
    return keep_rows(docs, found.select("doc_id", F.col("text_sha256").alias("key"), "kept"),
                     lambda some: some.withColumn(
                         "_key", F.sha2(F.coalesce("text", F.lit("")), 256)))
