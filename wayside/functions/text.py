"""String tidying."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, functions as F

from wayside.functions.cases import first_match


def squeeze_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, r"\s+", " ")


def normalise_text(text: Column, operations: Collection[str]) -> Column:
    """Apply ``trim``, then ``upper`` or else ``lower``, then ``remove_extra_spaces``."""
    if "trim" in operations:
        text = F.trim(text)
    if "upper" in operations:
        text = F.upper(text)
    elif "lower" in operations:
        text = F.lower(text)
    return squeeze_spaces(text) if "remove_extra_spaces" in operations else text


def day_or_night(text: Column) -> Column:
    """Day and Night in their three usual spellings; anything else stays."""
    return F.coalesce(
        first_match(
            [(text.isin(w, w.lower(), w.upper()), w) for w in ("Day", "Night")], None
        ),
        text,
    )
