"""Column builders over event arrays and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: display formats -------------------------------------------
EVENT_PREFIX = "E"
CHAIN_ARROW = " → "
CHAIN_MAX_EVENTS = 15
CHAIN_MORE = " → ... (+{n} more)"
# -----------------------------------------------------------------------------


def event_labels(events: Column) -> Column:
    """every event id prefixed with ``E`` (array<string>)."""
    return F.transform(events, lambda x: F.concat(F.lit(EVENT_PREFIX), x.cast("string")))


def event_chain(events: Column, max_events: int = CHAIN_MAX_EVENTS) -> Column:
    """The first ``max_events`` labels joined by arrows, then "+n more"."""
    labels = event_labels(events)
    head = F.array_join(F.slice(labels, 1, max_events), CHAIN_ARROW)
    extra = F.size(events) - F.lit(max_events)
    more_prefix, more_suffix = CHAIN_MORE.split("{n}")
    return F.when(F.size(events) > max_events,
                  F.concat(head, F.lit(more_prefix), extra.cast("string"), F.lit(more_suffix))
                  ).otherwise(head)


def format_prompt(template: str, text: Column, slot: str = "{sequence}") -> Column:
    """fill the single ``slot`` of ``template`` with ``text``."""
    before, after = template.split(slot, 1)
    return F.concat(F.lit(before), text, F.lit(after))


def answer_fields(raw: Column) -> Column:
    """F11 + F12 on raw model answers: a struct (classification, confidence,
    explanation).

    The text from the first '{' to the last '}' must parse as exactly one
    JSON object (strict: no single quotes, nothing between two objects);
    keys are compared trimmed and lower-cased and the last of a key wins; the
    class is mapped by :func:`blocklens.functions.scores.normalize_class`.
    Numbers, arrays and objects arrive as their JSON text and never equal a
    class spelling.
    """
    from blocklens.functions.scores import normalize_class
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    as_list = F.from_json(F.concat(F.lit("["), body, F.lit("]")),
                          "array<map<string,string>>",
                          {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    one = F.when((body != "") & (F.size(as_list) == 1), as_list[0])

    def last(name: str) -> Column:
        own = F.filter(F.map_entries(one), lambda e: F.lower(F.trim(e["key"])) == name)
        return F.try_element_at(own, F.lit(-1))["value"]

    return F.struct(normalize_class(last("classification")).alias("classification"),
                    last("confidence").alias("confidence"),
                    last("explanation").alias("explanation"))


def answer_class(raw: Column) -> Column:
    """The class of a raw answer, NULL when there is none."""
    return answer_fields(raw)["classification"]
