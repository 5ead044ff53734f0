"""Template mining and line -> event assignment.

Spark-first reading of the miner: mask every line with native regexes, reduce
the lines to their *distinct* masks with a partial (map-side) aggregation, and
only then run anything order-dependent.  Two miners share that front end:

* :func:`mask_templates` -- the masked string itself is the template (T3).
* :func:`mined_masks` -- masks grouped by token count and first token, groups
  that agree in too little split place by place; a place in which a group does
  not agree becomes a wildcard (T2).

Event ids are the rank of the template's first line (``first_line_id``),
computed with :func:`blocklens.operators.ordinals.dense_ordinal`.  Lines get
their event through an equi-join on the mask (T5); the template side is small
and AQE turns the join into a broadcast from its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions import parsing as P
from blocklens.operators.ordinals import dense_ordinal
from blocklens.session import drop_written, written

# --- fixed values: the miner's defaults ---------------------------------------
SHARE_THRESHOLD = 0.4
# ------------------------------------------------------------------------------
#: different tokens for each mask beyond which a place is a variable
WORDS_PER_MASK = 0.5
#: masks of a group up to which one row holds them all
TOGETHER = 1024


def with_masks(parsed: DataFrame, masks=P.MASKS) -> DataFrame:
    """Add ``template`` = whitespace-normalised masked content."""
    return parsed.withColumn(
        "template", P.normalize_tokens(P.mask(F.col("content"), masks)))


def distinct_masks(masked: DataFrame) -> DataFrame:
    """``(template, first_line_id, occurrences)`` -- partial aggregation first."""
    return masked.groupBy("template").agg(
        F.min("line_id").alias("first_line_id"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def mask_templates(masked: DataFrame) -> DataFrame:
    """template = the mask; ``event_id`` = rank of first appearance."""
    ranked = dense_ordinal(distinct_masks(masked), ["first_line_id"], "event_id")
    return ranked.select(F.col("event_id").cast("int"), F.col("template").alias("event_template"),
                         "occurrences", "first_line_id")


def template_counts(assigned: DataFrame) -> DataFrame:
    """T4: per event id its (final) template and number of lines."""
    return assigned.groupBy("event_id").agg(
        F.first("event_template").alias("event_template"),
        F.count(F.lit(1)).alias("occurrences"))


def assign_events(masked: DataFrame, mask_to_event: DataFrame) -> DataFrame:
    """T5: attach ``event_id``/``event_template`` to every line via its mask.

    ``mask_to_event`` has columns (template, event_id, event_template).
    """
    return masked.join(mask_to_event, "template", "inner")


# ----------------------------------------------------------------------------
# Mined templates over distinct masks
# ----------------------------------------------------------------------------


def _tokens() -> Column:
    return F.when(F.col("template") == "", F.array().cast("array<string>")) \
        .otherwise(F.split("template", " "))


def _token_groups(masks: DataFrame) -> DataFrame:
    """Distinct masks with their first group: the token count and the first token
    (one wildcard group for first tokens that hold a digit)."""
    toks = _tokens()
    first = F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit(""))
    key = F.when(first.rlike(P.java_regex(r"\d")), F.lit(P.WILDCARD)).otherwise(first)
    return masks.select("template", "first_line_id", "occurrences", F.unhex(F.md5(
        F.concat(F.size(toks).cast("string"), F.lit(" "), key).cast("binary"))).alias("group"))


def _places(groups: DataFrame) -> DataFrame:
    """(group, place, words, masks, token): distinct tokens of a group at a place,
    how many masks the group has, and the token where it is the only one."""
    long = groups.select("group", F.posexplode(_tokens()).alias("place", "token"))
    counts = long.groupBy("group", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group", "place").agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("masks"), F.min("token").alias("token"))


def _sized(masks: DataFrame, least: Column) -> DataFrame:
    """The masks whose group fits ``least``, with the size of the group."""
    sizes = masks.groupBy("group").agg(F.count(F.lit(1)).alias("masks")).where(least)
    return masks.join(sizes, "group")


def _rows(sized: DataFrame, together: int) -> DataFrame:
    """(group, masks, rows): the tokens of all masks of each group of a bounded size."""
    small = sized.where(F.col("masks") <= together).select("group", "template")
    return small.groupBy("group").agg(F.collect_list(_tokens()).alias("rows")).withColumn(
        "masks", F.size("rows").cast("long"))


def _judged(sized: DataFrame, together: int) -> DataFrame:
    """(group, masks, n_tokens, fixed, best): places, those with one token, and the
    (words, place) of the fewest different tokens above one."""
    found = F.transform(F.sequence(F.lit(0), F.size(F.col("rows")[0]) - 1), lambda i: F.struct(
        F.size(F.array_distinct(F.transform("rows", lambda r: F.get(r, i)))).cast("long").alias("words"),
        i.alias("place")))
    near = _rows(sized, together).select("group", "masks", found.alias("found")).select(
        "group", "masks", F.size("found").cast("long").alias("n_tokens"),
        F.size(F.filter("found", lambda x: x["words"] == 1)).cast("long").alias("fixed"),
        F.array_min(F.filter("found", lambda x: x["words"] > 1)).alias("best"))
    wide = _places(sized.where(F.col("masks") > together)).groupBy("group").agg(
        F.max("masks").alias("masks"), F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(F.col("words") == 1).alias("fixed"),
        F.min(F.when(F.col("words") > 1, F.struct("words", "place"))).alias("best"))
    return near.unionByName(wide)


def _named(sized: DataFrame, together: int) -> DataFrame:
    """(group, event_template): the tokens in which a group agrees, else wildcards."""
    wild = F.lit(P.WILDCARD)
    agreed = F.aggregate("rows", F.col("rows")[0], lambda one, row: F.zip_with(
        one, row, lambda a, b: F.when(a == b, a).otherwise(wild)))
    near = _rows(sized, together).select("group", F.array_join(agreed, " ").alias("event_template"))
    words = F.struct("place", F.when(F.col("words") == 1, F.col("token")).otherwise(wild).alias("word"))
    wide = _places(sized.where(F.col("masks") > together)).groupBy("group").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(words)), lambda x: x["word"]), " ").alias("event_template"))
    return near.unionByName(wide)


def mined_masks(masked: DataFrame, share: float = SHARE_THRESHOLD,
                words_per_mask: float = WORDS_PER_MASK, together: int = TOGETHER) -> DataFrame:
    """``(template, first_line_id, occurrences, event_template)`` for every
    distinct mask, by iterative partitioning.

    Masks start in groups by token count and first token.  A group whose masks
    agree in at least ``share`` of their places is one template: the tokens they
    agree in, wildcards elsewhere.  Any other group is split by the tokens of
    the place that has the fewest different ones (of several the leftmost), so
    that a rare kind of line keeps a template of its own beside a frequent one.
    A place with more different tokens than ``words_per_mask`` for each mask is
    a variable; a group with no other places to split by is a template as well.

    A split needs a place of two tokens, so groups too small for that are settled
    by their size alone.  Groups of up to ``together`` masks are judged in one row
    each, no token is shuffled by itself; a level of the larger ones is one partial
    aggregation over (group, place, token), and none of them meets in one task.
    There are at most as many levels as tokens in a line.  A mask is written once
    when it settles, and a level's table goes when the next one stands.
    """
    live, settled = written(_token_groups(distinct_masks(masked)), "mask-groups"), []
    while True:
        judged = _judged(_sized(live, F.lit(2) <= F.lit(words_per_mask) * F.col("masks")), together)
        split = judged.where(F.col("fixed") < F.lit(share) * F.col("n_tokens")).where(
            F.col("best.words") <= F.lit(words_per_mask) * F.col("masks")).select("group", "best.place")
        split = written(split, "mask-splits")
        if split.limit(1).count() == 0:
            settled.append(live)
            break
        settled.append(written(live.join(split, "group", "left_anti"), "mask-clusters"))
        token = F.get(_tokens(), F.col("place"))
        parted = live.join(split, "group").withColumn("group", F.unhex(F.md5(F.concat_ws(
            " ", F.hex("group"), F.col("place").cast("string"), token).cast("binary")))).drop("place")
        old, live = live, written(parted, "mask-groups")
        drop_written(old)
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    # a mask alone in its group is its template
    named = written(_named(_sized(done, F.col("masks") > 1), together), "mask-names")
    return done.join(named, "group", "left").select(
        "template", "first_line_id", "occurrences",
        F.coalesce("event_template", "template", F.lit("")).alias("event_template"))


def mined_from_masks(mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(templates, mask_to_event)`` from (staged) :func:`mined_masks`.

    templates = (event_id, event_template, occurrences, first_line_id), ids by
    first appearance; mask_to_event = (template, event_id, event_template).
    """
    per = mined.groupBy("event_template").agg(F.min("first_line_id").alias("first_line_id"),
                                              F.sum("occurrences").alias("occurrences"))
    templates = dense_ordinal(per, ["first_line_id"], "event_id").select(
        F.col("event_id").cast("int"), "event_template", "occurrences", "first_line_id")
    mask_to_event = mined.select("template", "event_template").join(
        templates.select("event_template", "event_id"), "event_template").select(
        "template", "event_id", "event_template")
    return templates, mask_to_event


def mask_to_event_from(templates: DataFrame) -> DataFrame:
    """Mapping table for T3 templates (the mask *is* the template)."""
    return templates.select(F.col("event_template").alias("template"), "event_id",
                            "event_template")
