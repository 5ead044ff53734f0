"""A template dictionary that grows over mining runs under stable ids.

Every run adds a version.  Templates that are known keep their ids; templates
that are new get the next ids in the order of their first lines; a template
that mining over all masks no longer gives (its masks went into a more general
one) keeps its row and points on to the template of its first mask.  Runs over
parts of a log therefore give the ids of one run over all of it, as long as no
template is replaced.

The dictionary is two tables: distinct masks, which is all that mining needs of
earlier lines, and templates.  A version is a folder that is written once; the
last complete one counts, so a run that dies leaves the version before it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.operators import templates as tpl
from blocklens.operators.ordinals import dense_ordinal
from blocklens.session import written

MASKS = "template string, first_line_id long, occurrences long, event_template string"
TEMPLATES = ("event_id int, event_template string, since_version int, replaced_by int, "
             "first_line_id long, occurrences long")


def merge_masks(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct masks of all runs: first lines and occurrences of both sides."""
    own = ["template", "first_line_id", "occurrences"]
    return known.select(*own).unionByName(seen.select(*own)).groupBy("template").agg(
        F.min("first_line_id").alias("first_line_id"), F.sum("occurrences").alias("occurrences"))


def merge_templates(known: DataFrame, mined: DataFrame, version: int) -> DataFrame:
    """The next version of the templates, from all (staged) ``mined`` masks.

    ``known`` and ``mined`` are tables; ids of ``known`` never change.
    """
    now = written(mined.groupBy("event_template").agg(
        F.min("first_line_id").alias("first_line_id"), F.sum("occurrences").alias("occurrences")), "templates-now")
    old = known.select("event_id", "event_template", "since_version")
    # a dictionary of templates, one row in all
    top = known.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("top")).first()["top"]
    fresh = now.join(old, "event_template", "left_anti")
    fresh = dense_ordinal(fresh, ["first_line_id", "event_template"], "rank").select(
        (F.col("rank") + top).cast("int").alias("event_id"), "event_template",
        F.lit(version).alias("since_version"))
    live = written(old.join(now.select("event_template"), "event_template", "left_semi").unionByName(fresh), "live")
    # a replaced template goes to where its first mask is now
    gone = known.join(now, "event_template", "left_anti").select(
        "event_id", "event_template", "since_version", "first_line_id", "occurrences")
    heirs = mined.select(F.col("first_line_id"), "event_template").join(
        live.select("event_template", F.col("event_id").alias("replaced_by")), "event_template")
    gone = gone.join(heirs.select("first_line_id", "replaced_by"), "first_line_id", "left")
    return live.join(now, "event_template").select(
        "event_id", "event_template", "since_version", F.lit(None).cast("int").alias("replaced_by"),
        "first_line_id", "occurrences").unionByName(gone.select(
            "event_id", "event_template", "since_version", "replaced_by", "first_line_id", "occurrences"))


class TemplateDictionary:
    """The versions below ``path``.

    ``mine`` makes ``event_template`` of distinct masks (template,
    first_line_id, occurrences); by default the mask is the template.
    """

    def __init__(self, spark: SparkSession, path: str, mine=None):
        self.spark, self.path = spark, path
        self.mine = mine or (lambda masks: masks.withColumn("event_template", F.col("template")))

    def version(self) -> int:
        """The last complete version; 0 before any run."""
        from blocklens.plans.stages import is_complete
        n = 0
        while is_complete(self.spark, self._folder(n + 1, "templates")):
            n += 1
        return n

    def _folder(self, version: int, table: str) -> str:
        return os.path.join(self.path, f"version={version}", table)

    def _read(self, version: int, table: str, schema: str) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder(version, table))

    def masks(self) -> DataFrame:
        return self._read(self.version(), "masks", MASKS)

    def templates(self) -> DataFrame:
        return self._read(self.version(), "templates", TEMPLATES)

    def add_run(self, masked: DataFrame) -> int:
        """Merge a run's lines (line_id, template); the new version's number."""
        return self.add_masks(tpl.distinct_masks(masked))

    def add_masks(self, seen: DataFrame) -> int:
        """Merge distinct masks, such as a stream's side table of unseen ones."""
        last = self.version()
        known = self._read(last, "templates", TEMPLATES)
        masks = written(merge_masks(self._read(last, "masks", MASKS), seen), "masks-all")
        mined = self.mine(masks).select("template", "first_line_id", "occurrences", "event_template")
        mined.write.mode("overwrite").parquet(self._folder(last + 1, "masks"))
        mined = self.spark.read.schema(MASKS).parquet(self._folder(last + 1, "masks"))
        # the templates complete the version
        merge_templates(known, mined, last + 1).write.mode("overwrite").parquet(
            self._folder(last + 1, "templates"))
        return last + 1

    def mask_to_event(self) -> DataFrame:
        """(template, event_id, event_template) for the line -> event join."""
        live = self.templates().where(F.col("replaced_by").isNull())
        return self.masks().join(live.select("event_template", "event_id"), "event_template").select(
            "template", "event_id", "event_template")

    def resolve(self, events: DataFrame, column: str = "event_id") -> DataFrame:
        """``events`` with ids that earlier runs gave replaced by those of today."""
        while True:
            moved = self.templates().where(F.col("replaced_by").isNotNull()).select(
                F.col("event_id").alias("_from"), F.col("replaced_by").alias("_to"))
            stale = events.join(moved, F.col(column) == F.col("_from"), "left_semi").limit(1).count()
            if not stale:
                return events
            events = written(events.join(moved, F.col(column) == F.col("_from"), "left").withColumn(
                column, F.coalesce("_to", column)).drop("_from", "_to"), "resolved")
