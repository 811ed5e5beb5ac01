"""Numbers as other engines round them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """A double scaled in floating point, rounded half away from zero and scaled back, as C's round does; F.round takes the shortest decimal that reads as the double."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale, 0) / scale
