"""Per-block event sequences (G1/G2), label join (J1), positions, text.

The ordered sequence of a block is built in two levels so that no task sorts
an unbounded group: first per (block, line-range chunk) -- each piece holds at
most ``2**chunk_bits`` line ids -- then the sorted pieces of a block are
concatenated in chunk order.  Only the final concatenation touches a whole
block, and that is the output row itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.operators.parse import drop_unkeyed

CHUNK_BITS = 20


def block_events(assigned: DataFrame) -> DataFrame:
    """Long form ``(block_id, line_id, event_id)`` of keyed lines."""
    return drop_unkeyed(assigned).select("block_id", "line_id", "event_id")


def sequence_chunks(assigned: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """G1 for blocks of any size: ``(block_id, chunk, first_position, events)``.

    A chunk holds the events of a block within ``2**chunk_bits`` successive line
    ids, in line order; ``first_position`` is the 1-based position of its first
    event in the block, a prefix sum over the sizes of the block's chunks.  No
    row and no task holds a whole block.
    """
    pieces = block_events(assigned).groupBy("block_id", F.shiftright("line_id", chunk_bits).alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_id", "event_id"))),
                    lambda e: e["event_id"]).alias("events"))
    before = Window.partitionBy("block_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("first_position", F.coalesce(
        F.sum(F.size("events")).over(before), F.lit(0)) + 1).select(
        "block_id", "chunk", "first_position", "events")


def chunk_positions(chunks: DataFrame) -> DataFrame:
    """``(block_id, position, event_id)`` from chunks (narrow)."""
    return chunks.select("block_id", "first_position", F.posexplode("events").alias("_at", "event_id")).select(
        "block_id", (F.col("first_position") + F.col("_at")).alias("position"), "event_id")


def text_chunks(chunks: DataFrame, templates: DataFrame, unknown: str | None = None) -> DataFrame:
    """F5 for blocks of any size: ``(block_id, chunk, first_position, text)``, the
    numbered template lines of each chunk; a block's text is its chunks' in order."""
    rows = chunks.select("block_id", "chunk", "first_position", F.posexplode("events").alias("_at", "event_id"))
    named = rows.join(templates.select("event_id", "event_template"), "event_id", "left")
    line = F.concat(F.lit("Event "), (F.col("first_position") + F.col("_at")).cast("string"), F.lit(": "),
                    F.coalesce(F.col("event_template"), F.lit(unknown or UNKNOWN_TEMPLATE)))
    return named.groupBy("block_id", "chunk", "first_position").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def block_sequences(assigned: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The export of :func:`sequence_chunks`, one row a block: ``(block_id,
    events array<int>, sequence_length int)``, events in line order."""
    chunks = sequence_chunks(assigned, chunk_bits).drop("first_position")
    blocks = chunks.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "events"))).alias("_ps"))
    return blocks.select("block_id", F.flatten(F.transform("_ps", lambda p: p["events"])).alias("events")) \
        .withColumn("sequence_length", F.size("events"))


def ordered_sequences(rows: DataFrame, key: str, order: list[str], value: str,
                      chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """G1 for any table: per ``key`` the ``value`` column in ``order`` order.

    ``order`` must make rows unique within a key (ties would be resolved by
    the remaining struct fields only); its first column must be integral --
    it defines the bounded pieces (``order[0] >> chunk_bits``)."""
    fields = [F.col(c) for c in order] + [F.col(value).alias("_v")]
    pieces = rows.groupBy(key, F.shiftright(F.col(order[0]), chunk_bits).alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_p"))
    blocks = pieces.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_p"))).alias("_ps"))
    values = F.flatten(F.transform("_ps", lambda piece: F.transform(
        piece["_p"], lambda e: e["_v"])))
    return blocks.select(key, values.alias("values")).withColumn("n", F.size("values"))


def with_sequence_text(seqs: DataFrame) -> DataFrame:
    """Export edge: the space-separated ``event_sequence`` string."""
    return seqs.withColumn("event_sequence", F.array_join(F.col("events"), " "))


def sequences_labeled(seqs: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on block id; unlabelled blocks keep a NULL label."""
    return seqs.join(labels.select("block_id", "label"), "block_id", "left")


def unlabeled_count(labeled: DataFrame) -> DataFrame:
    return labeled.agg(F.count_if(F.col("label").isNull()).alias("n_unlabeled"),
                       F.count(F.lit(1)).alias("n_blocks"))


def event_positions(seqs: DataFrame) -> DataFrame:
    """``(block_id, position, event_id)`` with 1-based positions (narrow)."""
    return seqs.select("block_id", F.posexplode("events").alias("_pos", "event_id")) \
        .select("block_id", (F.col("_pos") + 1).alias("position"), "event_id")


# --- fixed value: line format of the text representation ---------------------
TEXT_LINE = "Event {i}: {template}"
UNKNOWN_TEMPLATE = "<unknown template>"
# -----------------------------------------------------------------------------


def text_sequences(seqs: DataFrame, templates: DataFrame,
                   unknown: str = UNKNOWN_TEMPLATE) -> DataFrame:
    """numbered template lines per block, newline-joined.

    ``templates`` = (event_id, event_template).  Positions are exploded, joined
    to the (small) template table and re-collected in position order.
    """
    pos = event_positions(seqs)
    named = pos.join(templates.select("event_id", "event_template"), "event_id", "left")
    line = F.concat(F.lit("Event "), F.col("position").cast("string"), F.lit(": "),
                    F.coalesce(F.col("event_template"), F.lit(unknown)))
    # two levels, as for sequences: bounded pieces, then ordered concatenation
    pieces = named.groupBy("block_id", F.shiftright("position", CHUNK_BITS).alias("_chunk")) \
        .agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("_ls"))
    pieces = pieces.select("block_id", "_chunk", F.array_join(
        F.transform("_ls", lambda x: x["l"]), "\n").alias("_t"))
    blocks = pieces.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_t"))).alias("_ps"))
    return blocks.select("block_id", F.array_join(
        F.transform("_ps", lambda x: x["_t"]), "\n").alias("text_sequence"))
