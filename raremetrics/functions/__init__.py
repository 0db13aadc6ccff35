"""Column-expression builders (JVM-side, codegen-friendly); no Python UDFs."""

from .classes import day_night, effort_class, missing_flag, presence, presence_label, season
from .dates import calendar_parts, combine_datetime, hours_between, parse_date
from .links import format_p, inv_cloglog, inv_logit, odds
from .numeric import (cell_centre_lat, cell_centre_lon, cut_equal_width, cut_fixed_width,
                      mean_ignoring_null, round_to, trunc_tenth)

__all__ = [
    "day_night", "effort_class", "missing_flag", "presence", "presence_label", "season",
    "calendar_parts", "combine_datetime", "hours_between", "parse_date",
    "format_p", "inv_cloglog", "inv_logit", "odds",
    "cell_centre_lat", "cell_centre_lon", "cut_equal_width", "cut_fixed_width",
    "mean_ignoring_null", "round_to", "trunc_tenth",
]
