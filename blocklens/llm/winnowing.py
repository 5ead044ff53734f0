"""Document fingerprints by winnowing, with DataFrame functions alone.

1. *Rolling hashes.*  Every ``GRAM`` successive code points have the polynomial
   (Karp-Rabin) hash modulo ``PRIME``.  The recurrence is rolled by doubling:
   the hash of 2 m code points is that of the first m times a power of the
   base plus that of the next m, for all places at once, so no state is
   carried from place to place.
2. *Windows.*  Of every ``WINDOW`` successive hashes the least is kept, of
   equal ones the rightmost, with its position.  Any passage of ``GRAM`` +
   ``WINDOW`` - 1 code points that two texts share gives them a common hash.
   A text with fewer hashes has one window; a text shorter than ``GRAM`` is
   one gram as a whole; an empty text has no fingerprint.
3. *Pieces.*  Long texts are worked on in pieces of ``PIECE`` window starts, so
   that what is held beside a text is bounded by a piece and what was selected.

A selected entry is one long, hash * 2**32 + (2**32 - 1 - position), so the
least entry of a window is the rightmost of the least hashes.

Positions tell which window elected an entry first, so the fingerprint of a
text that is spliced from the beginnings of two others (:func:`spliced`) is
taken from theirs, with new hashes only around the seam; it equals that of
winnowing the spliced text.

Neighbours in the order of doc_id are found without a global window: distinct
(doc_id, text hash) keys get dense ordinals by a range sort of small rows;
texts move once, to buckets of ``BUCKET`` successive documents.

Defined results: null text counts as empty; a null doc_id comes after all
others; rows equal in doc_id are ordered by a hash of their texts, rows equal
in both follow one another; a table of one row has itself as next; an empty
table gives an empty result; two empty fingerprints are alike (1), an empty
and another are not (0); other columns are ignored; doc_ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens.llm.common import session, stage, texts
from blocklens.operators.ordinals import dense_ordinal

GRAM, WINDOW = 16, 16
#: code points that a shared passage must have for a common hash to be sure
GUARANTEE = GRAM + WINDOW - 1
PRIME, BASE = 2_147_483_629, 1_000_003
#: window starts of a piece
PIECE = 2048
#: documents of a bucket
BUCKET = 512
#: order keys are broadcast up to this many rows (about 50 bytes each: 50 MB)
BROADCAST_KEYS = 1_000_000
HIGH = 1 << 32


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _doubled(values: Column, stride: int, both) -> Column:
    """``both`` of every value and the one ``stride`` behind it (null beyond the last)."""
    return F.zip_with(values, F.slice(values, F.lit(stride + 1), F.size(values)), both)


def _rolled(codes: Column, grams: Column) -> Column:
    """Hashes of all grams: those of 2 m code points from those of m, until ``GRAM``."""
    def level(values: Column, m: int) -> Column:
        if m == GRAM:
            return F.slice(values, F.lit(1), grams)
        power = F.lit(pow(BASE, m, PRIME)).cast("long")
        twice = _doubled(values, m, lambda a, b: (a * power + b) % F.lit(PRIME).cast("long"))
        return _let(twice, lambda v: level(v, 2 * m))
    return level(codes, 1)


def _least(entries: Column, windows: Column) -> Column:
    """Least entry of every window, from those of half its size."""
    def level(values: Column, m: int) -> Column:
        if m == WINDOW:
            return F.slice(values, F.lit(1), windows)
        return _let(_doubled(values, m, lambda a, b: F.least(a, b)), lambda v: level(v, 2 * m))
    return level(entries, 1)


def _selected(text: Column, offset: Column, whole: Column) -> Column:
    """Selected entries of a piece that starts ``offset`` code points into its
    text; only a ``whole`` text may have fewer code points than a full window."""
    def of(codes: Column) -> Column:
        n = F.size(codes)
        grams = n - (GRAM - 1)

        # as entries, but for a number that is the same in all of the piece
        def keys() -> Column:
            return F.transform(_rolled(codes, grams), lambda h, i: h * F.lit(HIGH) - i)

        def entries(chosen: Column) -> Column:
            return F.transform(chosen, lambda k: k + (F.lit(HIGH - 1) - offset))

        short = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * F.lit(BASE) + c) % F.lit(PRIME))
        return F.when(n >= GUARANTEE, entries(F.array_distinct(_let(keys(), lambda k: _least(
            k, grams - (WINDOW - 1)))))) \
            .when((n == 0) | ~whole, F.array().cast("array<bigint>")) \
            .when(n >= GRAM, entries(F.array(F.array_min(keys())))) \
            .otherwise(F.array(short * F.lit(HIGH) + F.lit(HIGH - 1)))
    # an empty text is split into one empty string
    return _let(F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")),
                            lambda c: F.ascii(c).cast("long")), of)


def winnow(text: Column) -> Column:
    """Selected entries of a whole text (array<long>), in the order of positions."""
    piece = f"(?s)(?=(.{{1,{PIECE + GUARANTEE - 1}}})).{{1,{PIECE}}}"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda part, i: _selected(
        part, i.cast("long") * F.lit(PIECE), i == 0))))


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, 32)


def position_of(entry: Column) -> Column:
    return F.lit(HIGH - 1) - entry.bitwiseAND(F.lit(HIGH - 1))


def _from_windows_below(entries: Column, limit: Column) -> Column:
    """The entries that a window elects which starts below ``limit``."""
    def elected(entry: Column, i: Column) -> Column:
        before = F.get(entries, i - 1)
        # a new least enters with the last gram of a window, else the one before left
        first = F.when(i == 0, F.lit(0).cast("long")).when(
            hash_of(entry) <= hash_of(before), position_of(entry) - (WINDOW - 1)).otherwise(
            position_of(before) + 1)
        # the window starts at the entry or up to a window before it
        at = position_of(entry)
        return F.when(at < limit, F.lit(True)).when(at - (WINDOW - 1) >= limit, F.lit(False)) \
            .otherwise(first < limit)
    return F.filter(entries, elected)


def spliced(text: Column, entries: Column, kept: Column, other: Column, other_entries: Column,
            taken: Column) -> Column:
    """Entries of the first ``kept`` code points of ``text`` followed by the first
    ``taken`` of ``other``, from the entries of both whole texts."""
    edge = GUARANTEE - 1
    left = F.substring(text, F.greatest(kept - edge, F.lit(0)) + 1, F.least(kept, F.lit(edge)))
    right = F.substring(other, F.lit(1), F.least(taken, F.lit(edge)))
    seam = F.when((taken > 0) | (kept <= edge), F.concat(left, right)).otherwise(F.lit(""))
    start = F.greatest(kept - edge, F.lit(0)).cast("long")
    return F.array_distinct(F.concat(
        _from_windows_below(entries, kept - edge),
        _selected(seam, start, kept + taken < GUARANTEE),
        F.transform(_from_windows_below(other_entries, taken - edge), lambda e: e - kept)))


def hashes(entries: Column) -> Column:
    """The set of an entry list's hashes."""
    return F.array_distinct(F.transform(entries, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes (0 to 1)."""
    def of(common: Column) -> Column:
        union = F.size(a) + F.size(b) - common
        return F.when(union == 0, F.lit(1.0)).otherwise(common / union)
    return _let(F.size(F.array_intersect(a, b)), of)


def digest(entries: Column) -> Column:
    """SHA-256 of the entries as position:hash, joined by commas."""
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(
        position_of(e).cast("string"), F.lit(":"), hash_of(e).cast("string"))), ","), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint array<struct<position, hash>>) of every whole text."""
    session(docs)
    return texts(docs).select("doc_id", F.transform(winnow(F.col("text")), lambda e: F.struct(
        position_of(e).alias("position"), hash_of(e).alias("hash"))).alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key of their place in the order."""
    return texts(docs).select(
        F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("down"),
        F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "doc_id", "text")


def with_next(docs: DataFrame, derive=None, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text, own, copies, next): every document with the text of the next
    in descending doc_id, and the first after the last.

    ``derive`` gives columns of a text that are wanted beside it (struct ``own``,
    and in next); rows equal in id and text are one row with their number of
    ``copies``, but for the last of them, whose next is another.
    """
    session(docs)
    rows, key = _keyed(docs), ["last", "down", "h1", "h2"]
    counted = stage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), "order-keys")
    total = counted.count()
    order = dense_ordinal(counted, key, "ord").select(
        *[F.col(c).alias(f"_{c}") for c in key], "m", (F.col("ord") - 1).alias("ord"))
    order = stage(order, "order")
    if total <= BROADCAST_KEYS:
        order = F.broadcast(order)
    same = F.lit(True)
    for c in key:
        same = same & rows[c].eqNullSafe(F.col(f"_{c}"))
    placed = rows.join(order, same).select("doc_id", "text", "ord", "m")
    several = placed.where("m > 1").groupBy("doc_id", "ord", "m").agg(F.first("text").alias("text"))
    # of m equal rows m - 1 have their like as next, and one another
    several = several.select("doc_id", "text", "ord", F.explode(F.array(
        F.struct(F.lit(0).alias("i"), (F.col("m") - 1).alias("copies")),
        F.struct(F.lit(1).alias("i"), F.lit(1).cast("long").alias("copies")))).alias("c")).select(
        "doc_id", "text", "ord", "c.i", "c.copies")
    placed = placed.where("m = 1").select("doc_id", "text", "ord", F.lit(0).alias("i"),
                                          F.lit(1).cast("long").alias("copies")).union(several)
    # the first of a bucket stands in the bucket before as well, for the last one there
    own = F.floor(F.col("ord") / bucket)
    before = F.when(F.col("ord") == 0, F.lit((max(total, 1) - 1) // bucket)).otherwise(own - 1)
    shown = F.when(F.col("ord") == 0, F.lit(total)).otherwise(F.col("ord"))
    at = F.struct(own.alias("bucket"), F.col("ord").alias("ord"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("bucket"), shown.alias("ord"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("at", F.explode(F.when(
        (F.col("ord") % bucket == 0) & (F.col("i") == 0), F.array(at, guest)).otherwise(F.array(at))))
    dealt = dealt.select("doc_id", "text", "copies", "i", "at.*").repartition("bucket")
    dealt = dealt.withColumn("own", derive(F.col("text")) if derive else F.struct(F.lit(0)))
    follow = Window.partitionBy("bucket").orderBy("ord", "i")
    return dealt.withColumn("next", F.lead(F.struct("text", "own")).over(follow)) \
        .where("not guest").select("doc_id", "text", "own", "copies", "next")


def winnow_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one row per document."""
    paired = with_next(docs, lambda text: _let(winnow(text), lambda entries: F.struct(
        entries.alias("entries"), hashes(entries).alias("hashes"), F.char_length(text).alias("n"))))
    half = F.floor(F.col("own.n") / 2).cast("int")
    sized = paired.withColumn("kept", F.col("own.n") - half).withColumn(
        "taken", F.least(half, F.col("next.own.n")))
    edited = sized.withColumn("edited", spliced(
        F.col("text"), F.col("own.entries"), F.col("kept"), F.col("next.text"),
        F.col("next.own.entries"), F.col("taken")))
    out = edited.select(
        "doc_id", F.col("own.n").cast("long").alias("n_chars"),
        F.sha2(F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")),
                        F.substring(F.col("next.text"), F.lit(1), F.col("taken"))), 256)
        .alias("edited_sha256"),
        digest(F.col("own.entries")).alias("fingerprint"),
        digest(F.col("edited")).alias("edited_fingerprint"),
        _let(hashes(F.col("edited")), lambda e: likeness(F.col("own.hashes"), e)).alias("near_edited"),
        likeness(F.col("own.hashes"), F.col("next.own.hashes")).alias("near_next"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))) \
        .drop("copies", "copy")
