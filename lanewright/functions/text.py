"""Text as the task files need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def device_id(stem: Column) -> Column:
    """The leading ASCII letters and digits of a file stem, or all of it where there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"^([A-Za-z0-9]+)", 1), F.lit("")), stem)
