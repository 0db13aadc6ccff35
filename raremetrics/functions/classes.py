"""Class variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's class rules.
DAY_HOURS = (6, 18)          # hours 6..18 inclusive are "Day"
AUTUMN_WINTER_MONTHS = (3, 8)  # months 3..8 inclusive are "AuWin", else "SprSu"
EFFORT_CLASS_BREAKS = (2.0, 4.0)  # Short < 2 <= Standard < 4 <= Long


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_night(hour) -> Column:
    h = _c(hour)
    return F.when(h.between(*DAY_HOURS), F.lit("Day")).when(h.isNotNull(), F.lit("Night"))


def season(month) -> Column:
    m = _c(month)
    return F.when(m.between(*AUTUMN_WINTER_MONTHS), F.lit("AuWin")).when(m.isNotNull(), F.lit("SprSu"))


def effort_class(hours) -> Column:
    h = _c(hours)
    lo, hi = EFFORT_CLASS_BREAKS
    return (F.when(h < lo, F.lit("Short"))
            .when(h < hi, F.lit("Standard"))
            .when(h >= hi, F.lit("Long")))


def presence(count) -> Column:
    """1 when the count is positive, else 0 (null stays null)."""
    return (_c(count) > 0).cast("int")


def presence_label(count) -> Column:
    return F.when(_c(count) > 0, F.lit("yes")).when(_c(count).isNotNull(), F.lit("no"))


def missing_flag(c) -> Column:
    """P14: 'Y' when the value is missing, else 'N'."""
    return F.when(_c(c).isNull(), F.lit("Y")).otherwise(F.lit("N"))
