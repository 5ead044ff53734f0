"""Column builders for header parsing, block-id extraction and masking.

All work here is native Spark expressions (java.util.regex under whole-stage
codegen); nothing leaves the JVM.  Python's ``re`` treats ``\\d \\w \\s \\b`` as
Unicode classes and lets ``.`` stop only at ``\\n``; the ``(?U)`` and ``(?d)``
flags give java.util.regex the same reading.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for identical results) --------
# Header layout: 6-digit date, 6-digit time, pid, level word, component up to
# the first colon (may contain spaces), then the message content.
HEADER_PATTERN = (
    r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([^:]+):\s+(.*)$"
)
HEADER_FIELDS = ("event_date", "event_time", "pid", "level", "component", "content")
# First block id in the content.
BLOCK_ID_PATTERN = r"(blk_-?\d+)"
# Ordered masking chain: (pattern, token).  The IP entry is the lookahead-free
# form of "IPv4[:port], optionally separated by commas/spaces, repeated":
# /?IP(:port)?([,\s]*IP(:port)?)*
MASKS = (
    (r"blk_-?\d+", "<BLOCK_ID>"),
    (r"/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?"
     r"(?:[,\s]*\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?)*", "<IP>"),
    (r"java\.[\w.]+(?:Exception|Error)(:.*)?$", "<EXCEPTION_DETAIL>"),
    (r"\b\d+\b", "<NUM>"),
)
WILDCARD = "<*>"
# -----------------------------------------------------------------------------

_JAVA_FLAGS = "(?U)(?d)"


def java_regex(pattern: str) -> str:
    """Python-``re`` reading of ``pattern`` for java.util.regex."""
    return _JAVA_FLAGS + pattern


def header_matches(raw: Column) -> Column:
    return raw.rlike(java_regex(HEADER_PATTERN))


def header_joined(raw: Column) -> Column:
    """The six header groups re-joined with ':' -- or ``raw`` unchanged when
    the header does not match.  A match always changes the string (the
    whitespace between date and time becomes ':'), so ``joined != raw`` is the
    match flag and the regex runs once per line."""
    return F.regexp_replace(raw, java_regex(HEADER_PATTERN), "$1:$2:$3:$4:$5:$6")


def header_fields(raw: Column) -> Column:
    """Array of the six header groups (one regex evaluation + one split).

    None of the first five groups can contain ':' (digits, a word, and a
    component that stops at the first colon), so the groups are re-joined with
    ':' and split with limit 6: the content keeps any colons of its own.
    Only meaningful where :func:`header_matches` is true.
    """
    return F.split(header_joined(raw), ":", 6)


def block_id(content: Column) -> Column:
    """First ``blk_-?digits`` in ``content``; NULL when there is none."""
    found = F.regexp_extract(content, java_regex(BLOCK_ID_PATTERN), 1)
    return F.when(found != F.lit(""), found)


def mask(content: Column, masks=MASKS) -> Column:
    """Apply the ordered masking chain (each step sees the previous output)."""
    out = content
    for pattern, token in masks:
        out = F.regexp_replace(out, java_regex(pattern), token.replace("$", "\\$"))
    return out


def normalize_tokens(text: Column) -> Column:
    """Whitespace tokenisation re-joined by one space (strip + split)."""
    stripped = F.regexp_replace(text, java_regex(r"^\s+|\s+$"), "")
    return F.regexp_replace(stripped, java_regex(r"\s+"), " ")


def event_timestamp(event_date: Column, event_time: Column) -> Column:
    """``yyMMdd`` + ``HHmmss`` read in the session time zone (NULL when not a
    valid date).  A zoned timestamp, because streaming watermarks need one;
    reports turn window bounds back into wall-clock values."""
    return F.try_to_timestamp(F.concat(event_date, event_time), F.lit("yyMMddHHmmss"))
