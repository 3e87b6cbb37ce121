from gridmill.functions.calendar import (
    MONTH_LABELS,
    days_before_month_of_day,
    days_in_month,
    days_per_year,
    month_label,
    month_number,
    month_of_day,
)
from gridmill.functions.descriptions import stamp_year, valid_time, variable_name
from gridmill.functions.exact import exact_sums, mean_of, merge_sums, places, sum_of
from gridmill.functions.filenames import base_name, year_from_file_name
from gridmill.functions.measures import apply_nan_policy, grid_mean, nan_as_null
from gridmill.functions.naming import STATS, stat_column, stat_columns, year_column
from gridmill.functions.quoting import named, quoted

__all__ = [
    "MONTH_LABELS",
    "STATS",
    "apply_nan_policy",
    "base_name",
    "days_before_month_of_day",
    "days_in_month",
    "days_per_year",
    "exact_sums",
    "grid_mean",
    "mean_of",
    "merge_sums",
    "month_label",
    "month_number",
    "month_of_day",
    "named",
    "nan_as_null",
    "places",
    "quoted",
    "stamp_year",
    "stat_column",
    "stat_columns",
    "sum_of",
    "valid_time",
    "variable_name",
    "year_column",
    "year_from_file_name",
]
