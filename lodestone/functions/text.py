"""Column functions over file texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_CAP = 50_000


def nonblank_lines(text: Column, cap: int = LINE_CAP) -> Column:
    """Non-blank lines of a text; exactly cap if it has more lines than that, blank ones included; null counts 0."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")
    ended = F.element_at(lines, -1) == ""
    total = F.size(lines) - F.when(ended, 1).otherwise(0)
    return F.when(total > cap, F.lit(cap)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(r"\S")))).cast("long")
