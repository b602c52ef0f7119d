"""Timestamps from text; whatever does not parse is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: accepted shapes -------------------------------------------
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
ZONELESS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?\z"
RFC1123Z = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})\z"
CARD_STAMP = r"^\d{2}:\d{2} \d{2}\.\d{2}\.\d{4}\z"
# --------------------------------------------------------------------------------


def _micro(text: Column) -> Column:
    """A comma or more than six fraction digits are fine on input."""
    text = F.replace(text, F.lit(","), F.lit("."))
    return F.regexp_replace(text, r"(\.\d{6})\d+", "$1")


def parse_rfc3339(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(RFC3339)), F.try_to_timestamp(_micro(text)))


def parse_zoneless(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` without a zone is UTC, whatever the session's zone."""
    stamp = F.concat(_micro(text), F.lit("Z"))
    return F.when(F.rlike(text, F.lit(ZONELESS)), F.try_to_timestamp(stamp))


def parse_rfc1123z(text: Column) -> Column:
    body = F.regexp_extract(text, RFC1123Z, 1)
    return F.when(body != "", F.try_to_timestamp(body, F.lit("dd MMM yyyy HH:mm:ss Z")))


def is_card_stamp(text: Column) -> Column:
    return F.rlike(text, F.lit(CARD_STAMP))


def parse_card_stamp(text: Column, zone: str = "Europe/Kyiv") -> Column:
    """``HH:mm dd.MM.yyyy``, written in the wall clock of ``zone``."""
    stamp = F.concat(text, F.lit(f" {zone}"))
    return F.when(is_card_stamp(text), F.try_to_timestamp(stamp, F.lit("HH:mm dd.MM.yyyy VV")))


def parse_epoch(seconds: Column) -> Column:
    return F.when(seconds > 0, F.timestamp_seconds(seconds))
