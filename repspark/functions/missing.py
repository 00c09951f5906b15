"""Missing strings: the tables write them as null, '' or 'NA'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "NA")


def present(col: Column | str) -> Column:
    """The string, or null where it is null, '' or 'NA'. No trimming: case and spaces matter."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~c.isin(*MISSING), c)


def na_text(col: Column | str) -> Column:
    """The string, or the text 'NA' where it is null (how pasted keys show a missing part)."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("NA"))
