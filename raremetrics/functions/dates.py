"""Date and time parsing (P1-P4). Bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the shot log: day/month/year dates and hour:minute:second clock times.
DATE_FORMAT = "d/M/yyyy"
DATETIME_FORMAT = "d/M/yyyy H:m:s"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = DATE_FORMAT) -> Column:
    """Text date → DateType; unparsable → null (ANSI-safe ``try_to_date``)."""
    return F.try_to_date(_c(c), fmt)


def combine_datetime(date_text, time_text, fmt: str = DATETIME_FORMAT) -> Column:
    """Date text + clock text → timestamp without time zone; bad parts → null."""
    joined = F.concat_ws(" ", _c(date_text), _c(time_text))
    return F.try_to_timestamp(joined, F.lit(fmt)).cast("timestamp_ntz")


def hours_between(start, end) -> Column:
    """Elapsed hours end − start as double (negative when end precedes start)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end)) / F.lit(3600.0)


def calendar_parts(c, prefix: str, with_hour: bool = False) -> dict[str, Column]:
    """Year / month / day (and hour) columns of one date or datetime column."""
    col = _c(c)
    out = {f"{prefix}_yr": F.year(col).cast("int"),
           f"{prefix}_mn": F.month(col).cast("int"),
           f"{prefix}_dy": F.dayofmonth(col).cast("int")}
    if with_hour:
        out[f"{prefix}_hour"] = F.hour(col).cast("int")
    return out


def end_date(date, start_hour, hours) -> Column:
    """Day on which work of ``hours`` hours ends that starts at an hour of a day; null if a part is."""
    return F.date_add(_c(date), F.floor((_c(start_hour) + _c(hours)) / F.lit(24.0)).cast("int"))
